"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import chat, decontaminate, hashing, html, language, negatives, packing, quality, sigtree, topk, toxicity, trie, urls
from tabprobe.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


_WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op8_benchmark_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 13) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (
  SELECT rid, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT rid, i, n, item_id FROM dw JOIN bw USING (g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit
        FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document inside benchmark windows of 13 words."""
    out = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      decontaminate.is_contaminated().alias("contaminated"))


def vocabulary() -> tuple[str, str]:
    """(ranks file, pre-tokenization rule) of the public 50k byte-level BPE; the
    ranks hold the same vocabulary as ``byte_bpe_50k.json``."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame) -> DataFrame:
    out = packing.pack(docs, *vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


@register("op1_harmonic_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids (tested by exact round trip)."""
    return pieces(table(spark, sf, "documents"))


PROBE_TEXT = r"\### Assistant: </turn> ok"


def probed_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and conversation -7, whose texts imitate control strings."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE_TEXT).alias("text"))
    return turns.unionByName(probe)


@register("op7_chat_formatting", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<||>') + length('<|end|>') + 2 + length(replace(replace(role, '%', '%25'), '<', '%3C'))
      + length(replace(replace(text, '%', '%25'), '<', '%3C'))) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations formatted; every figure is read back from the formatted string."""
    out = chat.format_chat(probed_conversations(spark, sf))
    turns = chat.parse("formatted")
    out = out.select("conv_id", turns.alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@register("op10_quality_classifier")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Score and decision for every document (tested against the quality labels, which it never reads)."""
    return quality.judge(table(spark, sf, "documents"))


def held_out(col: str = "doc_id"):
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def toxicity_model(spark: SparkSession, sf: str, docs: DataFrame | None = None):
    """The model learned from the labels that are not held out."""
    labels = table(spark, sf, "labels").where(~held_out())
    return toxicity.train(table(spark, sf, "documents") if docs is None else docs, labels)


@register("op9_toxicity")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document (tested by held-out accuracy)."""
    out = toxicity.score(table(spark, sf, "documents"), toxicity_model(spark, sf))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


BLOCK_RULES = ["net/", "example.com/de/"]
ALLOW_RULES = ["example.net/en/", "org/fr/"]


@register("op2_url_filters")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict for every page's URL; the trees learn from the URLs that a rule
    decides (rules are tested against a brute-force version, trees by held-out accuracy)."""
    out = urls.judge(table(spark, sf, "pages").select("page_id", "url"), BLOCK_RULES, ALLOW_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")


@register("op6_html_extraction")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page (tested on pages whose article is known)."""
    return html.extract(table(spark, sf, "pages"), keep=["page_id", "url"])


@register("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document (tested by held-out accuracy and enumerated chains)."""
    docs = table(spark, sf, "documents")
    model = language.train(docs.where(~held_out()).select("text", "lang"))
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@register("op4_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all vectors."""
    v = table(spark, sf, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(v, v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")))


_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@register("op5_ngram_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 3) - 1) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
t AS (SELECT doc_id, n, hash(s) AS h FROM g JOIN n USING (doc_id)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON d.doc_id = reach.a LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of documents linked by 3-word shingles at a similarity of 0.9."""
    return sigtree.near_duplicates(table(spark, sf, "documents"), 3, 9, 10).select("doc_id", "n_shingles", "component_id")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(id, path, chars) of every conversation c: the first h turns of conversation c - c % 100, then
    its own after its first h; h: crc32 of c's decimal text modulo 6."""
    own = cut_lineage(trie.sequences(turns))
    heads = own.where("id % 100 = 0").select(F.col("id").alias("head"), F.substring("path", 1, 5 * trie.DIGEST).alias("hp"), F.slice("chars", 1, 5).alias("hc"))
    rows = own.withColumns({"head": F.expr("id - id % 100"), "h": (F.crc32(F.col("id").cast("string")) % 6).cast("int")}).join(heads, "head", "left")
    return rows.select("id", F.expr(f"concat(substring(coalesce(hp, ''), 1, {trie.DIGEST} * h), substring(path, {trie.DIGEST} * h + 1))").alias("path"),
                       F.expr("concat(slice(coalesce(hc, cast(array() AS array<int>)), 1, h), slice(chars, h + 1, greatest(size(chars), 1)))").alias("chars"))


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda k, i: xor(k >> 1, 3988292384 * (k & 1)))))"""


@register("op12_conversation_trie", f"""
WITH t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS t FROM t GROUP BY conv_id),
h AS (SELECT c.conv_id, c.t, CAST({_CRC} % 6 AS BIGINT) AS h, d.t AS first FROM o c LEFT JOIN o d ON d.conv_id = c.conv_id - c.conv_id % 100),
r AS (SELECT conv_id, list_concat(list_slice(coalesce(first, []), 1, h), list_slice(t, h + 1, len(t))) AS s FROM h),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r),
g AS (SELECT list_transform(list_slice(s, 1, d), lambda x: x.k) AS node, d, CASE WHEN d = 0 THEN 0 ELSE coalesce(s[d].n, 0) END AS n, conv_id, d = len(s) AS ends FROM p),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM g GROUP BY node, d),
k AS (SELECT list_slice(node, 1, d - 1) AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)),
u AS (SELECT list_slice(node, 1, up) AS node, up AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM a) GROUP BY 1, 2)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, f.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
  CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN u USING (node, d) LEFT JOIN n f ON f.d = a.d - 1 AND f.node = list_slice(a.node, 1, a.d - 1)""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    out = trie.with_ends_digest(trie.build(rebuilt(table(spark, sf, "conversations"))))
    return out.withColumnRenamed("saved", "saved_tokens")


@register("op11_nearest_neighbours")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector (recall is tested against brute force)."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return hashing.nearest(v, v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), 20)


@register("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE r <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every hundredth vector."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        topk.quantized(F.col("embedding"), 256).alias("v"))
    return negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))
