"""Registered modelling queries.

Preparation, splits, metrics computed from predictions, exact kNN, exact
silhouette and frequent itemsets have SQL twins; fitted models (iterative
algorithms) are checked by row counts here and by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.ml import classify, cluster, metrics, prepare, rules
from tabprobe.operators.scale_encode import scale_standard
from tabprobe.plans.fixtures import A_SQL, E_SQL, labeled_documents, lineitem_nulls, rounded
from tabprobe.plans.registry import r6, register
from tabprobe.session import table

FEATURES_E = ["doc_id", "n_chars", "text_len", "n_lines", "n_spaces", "toxic"]
MODEL_FEATURES = ["n_chars", "text_len", "n_lines", "n_spaces", "toxic"]

# ------------------------------------------------------------------ M1-M3


@register("index_labels_documents_lang", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_index FROM documents
WHERE lang IS NOT NULL""")
def index_labels_documents_lang(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    out, _ = prepare.index_labels(d, "lang", "lang_index")
    return out.select("doc_id", "lang_index")


def _std_sql(c):
    return (f"{r6(f'CASE WHEN min({c}) OVER () = max({c}) OVER () OR stddev_pop({c}) OVER () = 0 THEN 0.0 '
                  f'ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END')} AS {c}")


@register("prepare_features_quality",
          f"SELECT quality, {', '.join(_std_sql(c) for c in FEATURES_E)} FROM {E_SQL}")
def prepare_features_quality(spark, sf):
    out, _ = prepare.prepare_features(labeled_documents(spark, sf), "quality")
    return rounded(out)


SPLIT_SQL = f"""
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42')) - 1
  < round(count(*) OVER (PARTITION BY quality) * 0.3) AS is_test FROM {E_SQL}"""


@register("stratified_split_quality", SPLIT_SQL)
def stratified_split_quality(spark, sf):
    e = labeled_documents(spark, sf).select("doc_id", "quality")
    return prepare.stratified_split(e, "quality", ["doc_id"])


# ------------------------------------------------------------------ M9-M11 on a rule-based prediction

PRED_SQL = f"""(SELECT CAST(quality AS DOUBLE) AS label,
  CAST(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS DOUBLE) AS prediction FROM {E_SQL})"""

PER_CLASS_SQL = f"""
pc AS (SELECT label, prediction, count(*) AS n FROM {PRED_SQL} GROUP BY ALL),
cls AS (SELECT label AS c FROM pc UNION SELECT prediction FROM pc),
t AS (SELECT c, COALESCE((SELECT sum(n) FROM pc WHERE label = c), 0) AS support,
             COALESCE((SELECT sum(n) FROM pc WHERE prediction = c), 0) AS predicted,
             COALESCE((SELECT sum(n) FROM pc WHERE label = c AND prediction = c), 0) AS tp FROM cls),
m AS (SELECT c, tp, support, predicted,
             CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM t),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM m)"""


def _rule_predictions(spark, sf):
    e = labeled_documents(spark, sf)
    return e.select(F.col("quality").alias("label"),
                    F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("prediction"))


@register("classification_metrics_rule", f"""
WITH {PER_CLASS_SQL}
SELECT {r6('sum(tp) / sum(support)')} AS accuracy, {r6('sum(prec * support) / sum(support)')} AS precision,
  {r6('sum(rec * support) / sum(support)')} AS recall, {r6('sum(f1 * support) / sum(support)')} AS f1 FROM f""")
def classification_metrics_rule(spark, sf):
    return rounded(metrics.classification_metrics(_rule_predictions(spark, sf)))


@register("confusion_matrix_rule", f"""
WITH {PER_CLASS_SQL}
SELECT a.c AS label, b.c AS prediction, CAST(COALESCE(pc.n, 0) AS BIGINT) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN pc ON pc.label = a.c AND pc.prediction = b.c""")
def confusion_matrix_rule(spark, sf):
    return metrics.confusion_matrix(_rule_predictions(spark, sf))


@register("classification_report_rule", f"""
WITH {PER_CLASS_SQL}
SELECT row, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM (
  SELECT CAST(c AS VARCHAR) AS row, prec AS precision, rec AS recall, f1, CAST(support AS DOUBLE) AS support FROM f
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
    CAST(sum(support) AS DOUBLE) FROM f
  UNION ALL SELECT 'macro avg', avg(prec), avg(rec), avg(f1), CAST(sum(support) AS DOUBLE) FROM f
  UNION ALL SELECT 'weighted avg', sum(prec * support) / sum(support), sum(rec * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS DOUBLE) FROM f)""")
def classification_report_rule(spark, sf):
    return rounded(metrics.classification_report(_rule_predictions(spark, sf)))


# ------------------------------------------------------------------ M4-M7, M12 (fitted models)

def _fit_and_score(spark, sf, model_type, **params):
    """Stratified 70/30 split, features standardised over all rows (the
    reference's order), fit on the training rows, metrics on the test rows."""
    split = prepare.stratified_split(labeled_documents(spark, sf), "quality", ["doc_id"])
    scaled = scale_standard(split, MODEL_FEATURES)
    tr = scaled.where(~F.col("is_test"))
    te = scaled.where(F.col("is_test"))
    model = classify.train_classifier(tr, MODEL_FEATURES, "quality", model_type, **params)
    return metrics.classification_metrics(classify.predict(model, te, MODEL_FEATURES, "quality"))


@register("logistic_quality_metrics")
def logistic_quality_metrics(spark, sf):
    return rounded(_fit_and_score(spark, sf, "logistic"))


@register("decision_tree_quality_metrics")
def decision_tree_quality_metrics(spark, sf):
    return rounded(_fit_and_score(spark, sf, "decision_tree", max_depth=5))


@register("random_forest_quality_metrics")
def random_forest_quality_metrics(spark, sf):
    return rounded(_fit_and_score(spark, sf, "random_forest", n_estimators=20, max_depth=5))


@register("svc_quality_metrics")
def svc_quality_metrics(spark, sf):
    return rounded(_fit_and_score(spark, sf, "svc"))


@register("cross_validate_logistic_quality")
def cross_validate_logistic_quality(spark, sf):
    e = labeled_documents(spark, sf)
    return rounded(classify.cross_validate(e, MODEL_FEATURES, "quality", ["doc_id"], "logistic", folds=5))


# ------------------------------------------------------------------ M8 kNN (exact)

EMB_SQL = """(SELECT vec_id, label, CAST(v AS DOUBLE) AS v, i FROM (
  SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def _emb_points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("double").alias("label"))


@register("knn_loo_embeddings", f"""
WITH d AS (SELECT a.vec_id AS q, b.vec_id AS r, any_value(b.label) AS label, sum((a.v - b.v) * (a.v - b.v)) AS d2
           FROM {EMB_SQL} a JOIN {EMB_SQL} b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
nb AS (SELECT q, label FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY d2, r) AS rk FROM d)
       WHERE rk <= 5),
v AS (SELECT q, label, count(*) AS votes FROM nb GROUP BY q, label)
SELECT q AS id, CAST(label AS DOUBLE) AS prediction FROM (
  SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) AS rk FROM v) WHERE rk = 1""")
def knn_loo_embeddings(spark, sf):
    pts = _emb_points(spark, sf)
    return classify.knn_classify(pts.select("id", "features"), pts, k=5, exclude_self=True)


# ------------------------------------------------------------------ M13-M17

@register("prepare_clustering_lineitem_minmax", f"""
WITH s AS (SELECT l_quantity, l_discount, l_tax FROM {A_SQL}
           WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL)
SELECT {', '.join(r6(f'(s.{c} - f.a_{c}) / (f.b_{c} - f.a_{c})') + f' AS {c}' for c in ('l_quantity', 'l_discount', 'l_tax'))}
FROM s, (SELECT {', '.join(f'min({c}) AS a_{c}, max({c}) AS b_{c}' for c in ('l_quantity', 'l_discount', 'l_tax'))} FROM s) f""")
def prepare_clustering_lineitem_minmax(spark, sf):
    out, _ = prepare.prepare_clustering(lineitem_nulls(spark, sf), ["l_quantity", "l_discount", "l_tax"], "minmax")
    return rounded(out)


EMB_DIMS = 64


def _emb_wide(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIMS)])


@register("kmeans_embeddings_metrics")
def kmeans_embeddings_metrics(spark, sf):
    w = _emb_wide(spark, sf)
    feats = [f"e{i}" for i in range(EMB_DIMS)]
    model = cluster.train_kmeans(w, feats, 10)
    return cluster.clustering_metrics(model, w, feats).select("cluster", "size", "inertia")


@register("silhouette_embeddings_labels", f"""
WITH d AS (SELECT a.vec_id AS q, any_value(a.label) AS ql, any_value(b.label) AS rl,
                  sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist
           FROM {EMB_SQL} a JOIN {EMB_SQL} b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
c AS (SELECT q, ql, rl, avg(dist) AS md FROM d GROUP BY q, ql, rl),
p AS (SELECT q, max(CASE WHEN rl = ql THEN md END) AS a, min(CASE WHEN rl <> ql THEN md END) AS b FROM c GROUP BY q)
SELECT {r6('avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM p""")
def silhouette_embeddings_labels(spark, sf):
    e = table(spark, sf, "embeddings")
    pts = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                   F.col("label").cast("int").alias("cluster"))
    return rounded(cluster.silhouette(pts))


SILHOUETTE_SAMPLE = 100


@register("silhouette_interval_embeddings", f"""
WITH e AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS m, count(*) OVER () AS n,
                  row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42')) AS nth
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT * FROM e WHERE nth <= least(m, greatest(2, CAST(ceil({SILHOUETTE_SAMPLE} * m / n) AS BIGINT)))),
v AS {EMB_SQL},
d AS (SELECT a.vec_id AS q, any_value(s.label) AS ql, any_value(b.label) AS rl, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist
      FROM s JOIN v a ON a.vec_id = s.vec_id JOIN v b ON a.i = b.i AND a.vec_id <> b.vec_id
      WHERE b.label IS NOT NULL GROUP BY a.vec_id, b.vec_id),
c AS (SELECT q, ql, rl, avg(dist) AS md FROM d GROUP BY q, ql, rl),
p AS (SELECT q, ql, max(CASE WHEN rl = ql THEN md END) AS a, min(CASE WHEN rl <> ql THEN md END) AS b FROM c GROUP BY q, ql),
f AS (SELECT ql, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS sil FROM p),
h AS (SELECT f.ql, count(*) AS k, avg(sil) AS mean, coalesce(var_samp(sil), 0) AS var, any_value(s.m) AS m, any_value(s.n) AS n
      FROM f JOIN (SELECT DISTINCT label, m, n FROM s) s ON s.label = f.ql GROUP BY f.ql),
t AS (SELECT sum(mean * m / n) AS est, sqrt(sum((1.0 * m / n) * (1.0 * m / n) * var / k * (1 - 1.0 * k / m))) AS se,
             sum(k) AS sampled, any_value(n) AS n FROM h)
SELECT {r6('est')} AS silhouette, {r6('est - 1.959963984540054 * se')} AS low, {r6('est + 1.959963984540054 * se')} AS high,
  CAST(sampled AS BIGINT) AS sampled, CAST(n AS BIGINT) AS n FROM t""")
def silhouette_interval_embeddings(spark, sf):
    """M16 in linear time: about a hundred points, in proportion to the labels, each measured against all."""
    e = table(spark, sf, "embeddings")
    pts = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                   F.col("label").cast("int").alias("cluster"))
    return rounded(cluster.silhouette_interval(pts, SILHOUETTE_SAMPLE))


@register("choose_k_documents")
def choose_k_documents(spark, sf):
    data, feats = prepare.prepare_clustering(labeled_documents(spark, sf), MODEL_FEATURES)
    return rounded(cluster.choose_k(data, feats, ks=range(2, 5)))


@register("cluster_points_embeddings")
def cluster_points_embeddings(spark, sf):
    w = _emb_wide(spark, sf)
    feats = [f"e{i}" for i in range(EMB_DIMS)]
    model = cluster.train_kmeans(w, feats, 10)
    return rounded(cluster.cluster_points(model, w, feats, "e0", "e1"))


# ------------------------------------------------------------------ M18

BASKETS_SQL = """(SELECT DISTINCT l.l_orderkey AS b, p.p_brand AS item FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.1


def _baskets(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rules.baskets(li.join(p, "l_partkey"), "l_orderkey", "p_brand")


SETS_SQL = f"""
n AS (SELECT count(DISTINCT b) AS n FROM {BASKETS_SQL}),
s1 AS (SELECT item AS i1, count(*) AS freq FROM {BASKETS_SQL} GROUP BY item),
s2 AS (SELECT x.item AS i1, y.item AS i2, count(*) AS freq
       FROM {BASKETS_SQL} x JOIN {BASKETS_SQL} y ON x.b = y.b AND x.item < y.item GROUP BY 1, 2),
s3 AS (SELECT x.item AS i1, y.item AS i2, z.item AS i3, count(*) AS freq
       FROM {BASKETS_SQL} x JOIN {BASKETS_SQL} y ON x.b = y.b AND x.item < y.item
       JOIN {BASKETS_SQL} z ON z.b = x.b AND y.item < z.item GROUP BY 1, 2, 3),
f1 AS (SELECT s1.* FROM s1, n WHERE freq >= ceil({MIN_SUPPORT} * n.n)),
f2 AS (SELECT s2.* FROM s2, n WHERE freq >= ceil({MIN_SUPPORT} * n.n)),
f3 AS (SELECT s3.* FROM s3, n WHERE freq >= ceil({MIN_SUPPORT} * n.n))"""

ITEMSETS_SQL = f"""
WITH {SETS_SQL}
SELECT itemset, CAST(size AS INTEGER) AS size, CAST(freq AS BIGINT) AS freq, {r6('freq / n.n')} AS support
FROM (SELECT i1 AS itemset, 1 AS size, freq FROM f1
      UNION ALL SELECT i1 || ',' || i2, 2, freq FROM f2
      UNION ALL SELECT i1 || ',' || i2 || ',' || i3, 3, freq FROM f3), n"""


@register("frequent_itemsets_brands", ITEMSETS_SQL)
def frequent_itemsets_brands(spark, sf):
    fi, _ = rules.association_rules(_baskets(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE)
    return rounded(fi.withColumn("itemset", F.array_join("itemset", ",")))


@register("association_rules_brands", f"""
WITH {SETS_SQL},
p AS (SELECT i1 AS a, i2 AS c, freq FROM f2 UNION ALL SELECT i2, i1, freq FROM f2),
t AS (SELECT i1 || ',' || i2 AS a, i3 AS c, freq FROM f3 UNION ALL SELECT i1 || ',' || i3, i2, freq FROM f3
      UNION ALL SELECT i2 || ',' || i3, i1, freq FROM f3),
ante AS (SELECT i1 AS a, freq FROM f1 UNION ALL SELECT i1 || ',' || i2, freq FROM f2),
r AS (SELECT x.a, x.c, x.freq * 1.0 / ante.freq AS confidence,
             (x.freq * 1.0 / ante.freq) / (f1.freq * 1.0 / n.n) AS lift, x.freq * 1.0 / n.n AS support
      FROM (SELECT * FROM p UNION ALL SELECT * FROM t) x JOIN ante ON ante.a = x.a JOIN f1 ON f1.i1 = x.c, n)
SELECT a AS antecedent, c AS consequent, {r6('confidence')} AS confidence, {r6('lift')} AS lift,
  {r6('support')} AS support FROM r WHERE confidence >= {MIN_CONFIDENCE}""")
def association_rules_brands(spark, sf):
    _, ar = rules.association_rules(_baskets(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE)
    return rounded(ar.withColumns({c: F.array_join(c, ",") for c in ("antecedent", "consequent")}))


EMB_SPLIT_SQL = """(SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42')) - 1
  < round(count(*) OVER (PARTITION BY label) * 0.3) AS is_test FROM embeddings)"""


@register("knn_split_embeddings", f"""
WITH s AS {EMB_SPLIT_SQL},
e AS (SELECT x.vec_id, x.label, x.v, x.i, s.is_test FROM {EMB_SQL} x JOIN s ON x.vec_id = s.vec_id),
d AS (SELECT a.vec_id AS q, any_value(a.label) AS truth, b.vec_id AS r, any_value(b.label) AS label,
             sum((a.v - b.v) * (a.v - b.v)) AS d2
      FROM e a JOIN e b ON a.i = b.i AND a.is_test AND NOT b.is_test GROUP BY a.vec_id, b.vec_id),
nb AS (SELECT q, truth, label FROM (SELECT q, truth, label, row_number() OVER (PARTITION BY q ORDER BY d2, r) AS rk FROM d)
       WHERE rk <= 5),
v AS (SELECT q, truth, label, count(*) AS votes FROM nb GROUP BY q, truth, label)
SELECT q AS id, CAST(truth AS DOUBLE) AS label, CAST(label AS DOUBLE) AS prediction FROM (
  SELECT q, truth, label, row_number() OVER (PARTITION BY q ORDER BY votes DESC, label) AS rk FROM v) WHERE rk = 1""")
def knn_split_embeddings(spark, sf):
    """M3 + M8: stratified 70/30 split (md5 order), exact 5-NN of every test
    vector among the training vectors."""
    pts = _emb_points(spark, sf)
    split = prepare.stratified_split(pts, "label", ["id"])
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test"))
    pred = classify.knn_classify(test.select("id", "features"), train, k=5)
    return pred.join(test.select("id", "label"), "id").select("id", "label", "prediction")


@register("logistic_embeddings_report")
def logistic_embeddings_report(spark, sf):
    """M4 multi-class (10 labels) with M11's report on the stratified test split."""
    w = _emb_wide(spark, sf)
    feats = [f"e{i}" for i in range(EMB_DIMS)]
    split = prepare.stratified_split(w, "label", ["vec_id"])
    model = classify.train_classifier(split.where(~F.col("is_test")), feats, "label", "logistic")
    pred = classify.predict(model, split.where(F.col("is_test")), feats, "label")
    return rounded(metrics.classification_report(pred))
