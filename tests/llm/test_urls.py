import random
import re

from pyspark.sql import functions as F

from tabprobe.llm import urls as U

BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m or "://" not in (url or ""):
        return "", "", None
    host = re.sub("[A-Z]", lambda x: x.group().lower(), m.group(1))
    fits = [r for r in BLOCK + ALLOW if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and m.group(2).startswith(r[r.index("/"):])]
    return host, m.group(2), max(fits, key=len, default=None)


def some_urls(n=300):
    rng = random.Random(1)
    return [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.', 'WWW.'])}{rng.choice(['cheap-pills', 'news', 'x9', 'myexample'])}"
            f"{rng.choice(['.example', ''])}.{rng.choice(['com', 'net', 'org', 'NET'])}{rng.choice(['', '/', '/en', '/en/', '/de/', '/fr/'])}"
            f"{rng.choice(['', '12', 'a/b.html'])}{rng.choice(['', '?q=1&b=2', '#top', '?x://y/z'])}" for _ in range(n)]


ODD = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://a.net?x", "http://anet/", "ftp://x.org/fr/://b.net/", "x\ny://A.Org/fr/é", "http://" + "a" * 100_000 + ".net/"]


def test_rules_equal_brute_force(spark):
    rows = [(i, u, "clash", 1) for i, u in enumerate(some_urls() + ODD + ODD[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, depth int").repartition(3)
    out = U.judge(df, BLOCK, ALLOW)
    assert out.columns == ["page_id", "url", "depth", "host", "path", "rule", "block_score", "verdict"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == ("block" if rule in BLOCK else "allow")
        else:
            assert r["verdict"] == ("block" if r["block_score"] >= 0.5 else "allow")


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in U.judge(df, BLOCK, ALLOW).collect()} == {"allow"}
    only = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r["verdict"] for r in U.judge(only, BLOCK, ALLOW).collect()} == {"block"}
    assert U.judge(df.limit(0), BLOCK, ALLOW).collect() == []


def test_trees_learn_labelled_urls(spark):
    """Held-out accuracy on URLs whose label follows lexical signs."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.4
        name = "".join(rng.choices("abcdefghij", k=6)) if not bad else "-".join("".join(rng.choices("xyz0123456789", k=5)) for _ in range(3))
        rows.append((f"http://{name}.example.com/p{rng.randint(1, 99)}" + ("?" + "&".join(f"k{j}={rng.random()}" for j in range(4)) if bad else ""), int(bad)))
    model = U.train(spark.createDataFrame(rows[:600], "url string, block int"))
    scored = model.block_score(U.lexical(spark.createDataFrame(rows[600:], "url string, block int")))
    right = scored.where((F.col("block_score") >= 0.5) == (F.col("block") == 1)).count()
    assert right >= 0.97 * 300


def test_rates_leave_the_own_fold_out(spark):
    rows = [(f"http://h{i % 7}.example.com/{j}", int(i % 3 == 0), f"f{i % 2}") for i in range(60) for j in range(2)]
    df = spark.createDataFrame(rows, "url string, y int, fold string").dropDuplicates(["url"])
    keyed = U.lexical(df)
    names = ["suffix_1", "suffix_2", "suffix_host", "suffix_section"]
    counts = keyed.select(F.explode(F.array(*names)).alias("k"), "fold", "y").groupBy("k", "fold").agg(F.sum("y").alias("b"), F.count("y").alias("n"))
    keys = {r["url"]: r for r in keyed.collect()}
    for r in U.out_of_fold(keyed, counts, 0.3).collect():
        for x in names:
            other = [o["y"] for o in keys.values() if o["fold"] != r["fold"] and o[x] == keys[r["url"]][x]]
            assert abs(r[x] - (sum(other) + 0.6) / (len(other) + 2)) < 1e-9


def test_lexical_signs_decide_where_rules_give_the_labels(spark):
    """Rules block domains whose names look alike; undecided URLs that look so too get higher scores,
    and a rule left out is recognised by the others' signs."""
    rng = random.Random(5)
    bad = [f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-x.com" for _ in range(4)]
    good = ["morningpaper.com", "gardenhouse.org", "riverside.com", "openlibrary.org"]

    def url(domain, odd):
        tail = "&".join(f"k{j}={rng.randint(0, 99999)}" for j in range(5)) if odd else "story" + rng.choice("abcdef")
        return f"http://{rng.choice(['www.', 'm.', ''])}{domain}/{'?' if odd else ''}{tail}"
    rows = [(url(d, d in bad),) for d in bad + good for _ in range(40)]
    other = [(url(f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-z.net", True),) for _ in range(40)] + [(url("meadowlark.net", False),) for _ in range(40)]
    df = spark.createDataFrame(rows + other, "url string")
    got = U.judge(df, [d + "/" for d in bad], [d + "/" for d in good]).collect()
    score = {r["url"]: r["block_score"] for r in got}
    assert min(score[u] for u, in other[:40]) > max(score[u] for u, in other[40:])
    labelled = df.withColumn("fold", U.matched_rule(U.host(F.col("url")), U.path(F.col("url")), [d + "/" for d in bad + good]))
    labelled = labelled.withColumn("block", F.when(F.col("fold").isin([d + "/" for d in bad]), 1).when(F.col("fold").isNotNull(), 0))
    found = U.fold_accuracy(labelled.where(F.col("fold").isin(bad[0] + "/", bad[1] + "/", good[0] + "/", good[1] + "/")), "fold")
    assert sum(a for a, _ in found.values()) >= 0.9 * sum(n for _, n in found.values())


def test_every_host_has_its_statistics(spark):
    rows = [(f"http://h{i}.example.com/{j}", int(i % 3 == 0)) for i in range(400) for j in range(3)]
    df = spark.createDataFrame(rows, "url string, block int")
    model = U.train(df)
    got = model.features(U.lexical(df)).select("block", "suffix_host").collect()
    assert len(got) == len(rows) and abs(model.prior - 134 / 400) < 1e-9
    assert all(abs(r["suffix_host"] - (3 * r["block"] + 2 * model.prior) / 5) < 1e-9 for r in got)


def test_rule_labels_use_suffix_rates_of_other_rules(spark, monkeypatch):
    """The trees of ``judge`` see suffix rates, out of the folds of the rules."""
    seen = []
    real = U.out_of_fold

    def spy(sample, counts, prior):
        seen.append((sample, counts))
        return real(sample, counts, prior)
    monkeypatch.setattr(U, "out_of_fold", spy)
    df = spark.createDataFrame([(u,) for u in some_urls(600)], "url string")
    got = U.judge(df, BLOCK, ALLOW).collect()
    assert len(got) == 600 and len(seen) == 1
    assert {r["fold"] for r in seen[0][1].select("fold").distinct().collect()} == {r["rule"] for r in got if r["rule"]}
    assert len({r["block_score"] for r in got if r["rule"] is None}) > 1
