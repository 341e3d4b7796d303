import hashlib
import random

from pyspark.sql import functions as F

from tabprobe.llm import chat as C

SIGNS = ["<", "|", "%", ">", "\n", "<|end|>\n", "<|user|>\n", "%25", "%3C", "%0A", "a", "é", "\\### Assistant: </turn> ok", "<|image:1|>", " "]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted int, t string").repartition(3)


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 12), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", None, "a|>\nb", "x%0A|", ""]),
             rng.choice([None, "".join(rng.choices(SIGNS, k=rng.randint(0, 12)))])) for _ in range(120)]
    rows += [(None, 0, "user", "no id"), (50, 0, "assistant", "again"), (50, 0, "assistant", "again"), (51, 0, "user", "long " * 50_000)]
    got = C.format_chat(table(spark, rows)).select("conv_id", C.parse("formatted").alias("turns"), "attachments")
    want = expected(rows)
    result = got.select("conv_id", "turns", C.loss_text(F.col("turns")).alias("loss"), "attachments").collect()
    assert len(result) == len(want)
    for r in result:
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert r["attachments"] == []


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    rows = [(1, 0, "user", [part("text", "look: <"), part("image", ref="a.png"), part("text", "|end|> and"), part("audio", ref="b.wav", size=1500)]),
            (1, 1, "assistant", [part("text", "ok"), part("document", ref="c.pdf", size=401), part(None, "tail")]), (2, 0, "user", None), (2, 1, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    out = {r["conv_id"]: r for r in C.format_chat(df, parts_col="parts", text_col=None).select("*", C.parse("formatted").alias("turns")).collect()}
    assert [t["text"] for t in out[1]["turns"]] == ["look: <<|image:1|>|end|> and<|audio:2|>", "ok<|document:3|>tail"]
    assert [tuple(a) for a in out[1]["attachments"]] == [(1, "image", "a.png", 256), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 101)]
    assert out[1]["attachment_tokens"] == 256 + 38 + 101
    assert [t["text"] for t in out[2]["turns"]] == ["", ""] and out[2]["attachment_tokens"] == 0


def test_plan_has_no_python_and_empty_table(spark):
    df = table(spark, [(1, 0, "user", "x")])
    out = C.format_chat(df).select("conv_id", C.parse("formatted"))
    assert "Python" not in out._jdf.queryExecution().toString() and C.format_chat(df.limit(0)).collect() == []


def test_query_reads_back_the_probe(spark):
    import __spark_entry__ as E
    row = E.queries()["op7_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
