"""Registered queries on awkward inputs derived from the tables -- missing and hot
order keys, late bytes, wide integers, typed fills, missing labels, maps, wide
tables -- and on properties of fitted models that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.ml import classify, cluster, metrics, prepare
from tabprobe.operators import clean, correlation, profile
from tabprobe.operators.ordering import with_row_id
from tabprobe.plans.correlation_queries import matrix_sql
from tabprobe.plans.fixtures import E_SQL, documents_labels, labeled_documents, price_lines_nulls, rounded
from tabprobe.plans.model_queries import EMB_DIMS, EMB_SPLIT_SQL, MODEL_FEATURES, SPLIT_SQL, _emb_wide
from tabprobe.plans.registry import r6, register
from tabprobe.plans.source_queries import reread, scratch_path
from tabprobe.operators.scale_encode import scale_standard
from tabprobe.sources import delimited
from tabprobe.session import table

# ------------------------------------------------------------------ positions


@register("row_id_orders_missing_keys", """
SELECT *, row_number() OVER (ORDER BY k NULLS FIRST, o_orderkey) - 1 AS row_id
FROM (SELECT *, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS k FROM orders)""")
def row_id_orders_missing_keys(spark, sf):
    """Whole rows; a quarter of the order keys is missing."""
    o = table(spark, sf, "orders").withColumn("k", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")))
    return with_row_id(o, ["k", "o_orderkey"])


@register("row_id_events_hot_key", """
SELECT *, row_number() OVER (ORDER BY k, event_id) - 1 AS row_id
FROM (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 0 ELSE user_id END AS k FROM events)""")
def row_id_events_hot_key(spark, sf):
    """Two thirds of the rows share one key."""
    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, F.lit(0)).otherwise(F.col("user_id")).alias("k"))
    return with_row_id(e, ["k", "event_id"])


# ------------------------------------------------------------------ reading

@register("read_delimited_late_latin1", """
SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'caf' || chr(233) ELSE o_orderstatus END AS label FROM orders""")
def read_delimited_late_latin1(spark, sf):
    """One Latin-1 byte in the last line of a file in order."""
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    label = F.when(F.col("o_orderkey") == last, F.lit("caf\u00e9")).otherwise(F.col("o_orderstatus"))
    path = scratch_path(spark, "orders-latin1")
    (o.select("o_orderkey", label.alias("label")).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
      .write.option("header", True).option("encoding", "ISO-8859-1").csv(path))
    return reread(delimited.read_delimited(spark, path))


@register("infer_types_wide_integers", f"""
SELECT o_orderkey, {r6("CAST('1' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS DOUBLE) / 1e20")} AS wide FROM orders""")
def infer_types_wide_integers(spark, sf):
    """21-digit integers make a double column."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit("1"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0")).alias("wide"))
    return rounded(delimited.infer_types(o).withColumn("wide", F.col("wide") / 1e20))


# ------------------------------------------------------------------ typed fills and replacements

TYPED_SQL = """(SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 7 <> 0 THEN 9007199254740993 + o_custkey % 3 END AS big,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus = 'F' END AS final FROM orders)"""


def _typed(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate")).alias("o_orderdate"),
                    F.when(F.col("o_orderkey") % 7 != 0, F.lit(9007199254740993) + F.col("o_custkey") % 3).alias("big"),
                    F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus") == "F").alias("final"))


def _mode_sql(c):
    return f"(SELECT {c} FROM {TYPED_SQL} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("fill_mode_orders_typed", f"""
SELECT o_orderkey, {', '.join(f'coalesce({c}, {_mode_sql(c)}) AS {c}' for c in ('o_orderdate', 'big', 'final'))} FROM {TYPED_SQL}""")
def fill_mode_orders_typed(spark, sf):
    """Timestamp, integer beyond 2**53 and boolean columns keep their types."""
    return clean.fill_mode(_typed(spark, sf))


@register("fill_zero_orders_typed", f"""
SELECT o_orderkey, coalesce(o_orderdate, {_mode_sql('o_orderdate')}) AS o_orderdate, coalesce(big, 0) AS big,
  coalesce(final, {_mode_sql('final')}) AS final FROM {TYPED_SQL}""")
def fill_zero_orders_typed(spark, sf):
    return clean.fill_zero(_typed(spark, sf))


@register("replace_values_part_by_missing", "SELECT p_partkey, CASE WHEN p_retailprice <> 901.0 THEN p_retailprice END AS p_retailprice, nullif(p_size, 7) AS p_size FROM part")
def replace_values_part_by_missing(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return clean.replace_values(clean.replace_values(p, "p_size", "7", None), "p_retailprice", "901.0", None)


# ------------------------------------------------------------------ profiling

@register("duplicate_count_event_maps", """
SELECT CAST(count(*) - count(DISTINCT (event_type, user_id % 10)) AS BIGINT) AS n_duplicates FROM events""")
def duplicate_count_event_maps(spark, sf):
    e = table(spark, sf, "events").select(F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("m"))
    return profile.duplicate_count(e)


# ------------------------------------------------------------------ correlation

WIDE = [f"w{i}" for i in range(30)]
WIDE_SQL = "(SELECT " + ", ".join(
    f"CAST((l_partkey * {2 * i + 3} + l_suppkey * {i + 1} + l_linenumber) % {97 + i} AS DOUBLE) + l_quantity * {i % 4} AS w{i}" for i in range(30)) + " FROM lineitem)"


@register("corr_pearson_wide30", matrix_sql("pearson", WIDE_SQL, WIDE))
def corr_pearson_wide30(spark, sf):
    """435 pairs of null-free columns: one pass."""
    li = table(spark, sf, "lineitem")
    cols = [(((F.col("l_partkey") * (2 * i + 3) + F.col("l_suppkey") * (i + 1) + F.col("l_linenumber")) % (97 + i)).cast("double")
             + F.col("l_quantity") * (i % 4)).alias(f"w{i}") for i in range(30)]
    return rounded(correlation.corr_pearson(li.select(*cols)))


KENDALL = ("l_quantity", "l_discount", "l_tax")
NULLS_SQL = """(SELECT l_quantity, CASE WHEN l_discount <> 0 THEN l_discount END AS l_discount, CASE WHEN l_tax <> 0 THEN l_tax END AS l_tax FROM lineitem)"""


def _kendall_sql(a, b):
    """tau-b from the counts of value pairs: cells meet, rows do not."""
    return f"""(WITH c AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM {NULLS_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
  SELECT sum(p.n * q.n * sign((p.x - q.x) * (p.y - q.y))) / sqrt(sum(CASE WHEN p.x <> q.x THEN p.n * q.n ELSE 0 END) * sum(CASE WHEN p.y <> q.y THEN p.n * q.n ELSE 0 END)) AS r
  FROM c p, c q)"""


@register("corr_kendall_rates_nulls", "\nUNION ALL\n".join(
    [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6('r')} AS r FROM {_kendall_sql(*sorted((a, b)))}" for a in KENDALL for b in KENDALL if a != b]
    + [f"SELECT '{c}' AS col_a, '{c}' AS col_b, 1.0 AS r" for c in KENDALL]))
def corr_kendall_rates_nulls(spark, sf):
    return rounded(correlation.corr_kendall(price_lines_nulls(spark, sf).select(*KENDALL)))


# ------------------------------------------------------------------ model input

@register("stratified_split_missing_labels", """
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42')) - 1
  < round(count(*) OVER (PARTITION BY quality) * 0.3) AS is_test
FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def stratified_split_missing_labels(spark, sf):
    """Rows without a label are kept and split like a class."""
    return prepare.stratified_split(documents_labels(spark, sf).select("doc_id", "quality"), "quality", ["doc_id"])


@register("index_labels_orders_numeric", "SELECT o_orderkey, o_orderkey * 2 AS label FROM orders")
def index_labels_orders_numeric(spark, sf):
    """A numeric target with more than 10,000 values stays as it is."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 2).alias("v"))
    out, _ = prepare.index_labels(o, "v", "label")
    return out.select("o_orderkey", "label")


@register("classification_report_named", """
WITH p AS (SELECT lang AS truth, CASE WHEN n_chars > 1000 THEN 'en' ELSE lang END AS guess FROM documents)
SELECT truth AS row, round(sum(CASE WHEN guess = truth THEN 1.0 ELSE 0 END) / count(*), 6) AS recall, CAST(count(*) AS DOUBLE) AS support FROM p GROUP BY truth""")
def classification_report_named(spark, sf):
    """Class names in the report."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    indexed, classes = prepare.index_labels(d, "lang", "label")
    en = classes.where("class_name = 'en'").select(F.col("class_index").alias("_en"))
    pred = indexed.crossJoin(F.broadcast(en)).withColumn("prediction", F.when(F.col("n_chars") > 1000, F.col("_en")).otherwise(F.col("label")))
    rep = metrics.classification_report(pred, target_names=classes)
    return rounded(rep.where(~F.col("row").isin("accuracy", "macro avg", "weighted avg")).select("row", "recall", "support"))


# ------------------------------------------------------------------ fitted models: what SQL can state

SUPPORT_SQL = f"""
SELECT CAST(quality AS DOUBLE) AS label, count(*) AS n_test, true AS known_classes FROM ({SPLIT_SQL}) WHERE is_test GROUP BY quality"""


def _split(spark, sf):
    scaled = scale_standard(prepare.stratified_split(labeled_documents(spark, sf), "quality", ["doc_id"]), MODEL_FEATURES)
    return scaled.where(~F.col("is_test")), scaled.where(F.col("is_test"))


def _support(spark, sf, model_type, **params):
    """Test rows by class, and whether every prediction is one of the classes."""
    train, test = _split(spark, sf)
    model = classify.train_classifier(train, MODEL_FEATURES, "quality", model_type, **params)
    return (classify.predict(model, test, MODEL_FEATURES, "quality").groupBy("label")
            .agg(F.count(F.lit(1)).alias("n_test"), F.bool_and(F.coalesce(F.col("prediction").isin(0.0, 1.0), F.lit(False))).alias("known_classes")))


def _register_support(model_type, **params):
    register(f"{model_type}_quality_support", SUPPORT_SQL)(lambda spark, sf: _support(spark, sf, model_type, **params))


_register_support("logistic")
_register_support("decision_tree", max_depth=4, min_samples_leaf=2, criterion="entropy")
_register_support("random_forest", n_estimators=10, max_depth=4)
_register_support("svc", kernel="linear", C=0.5)
_register_support("knn", n_neighbors=3, weights="distance")


@register("logistic_quality_optimum", "SELECT true AS gradient_is_small")
def logistic_quality_optimum(spark, sf):
    """The penalised loss has (nearly) no gradient at the fitted weights."""
    train, _ = _split(spark, sf)
    model = classify.train_classifier(train, MODEL_FEATURES, "quality", "logistic", max_iter=500, tol=1e-10)
    w, b = model.coefficients.toArray(), float(model.intercept)
    z = F.lit(b)
    for c, x in zip(MODEL_FEATURES, w):
        z = z + F.col(c) * float(x)
    off = (1 / (1 + F.exp(-z)) - F.col("quality")).alias("off")
    n = train.count()
    means = train.select(*MODEL_FEATURES, off).agg(F.avg("off").alias("b"), *[F.avg(F.col("off") * F.col(c)).alias(c) for c in MODEL_FEATURES])
    small = F.abs("b") < 1e-4
    for c, x in zip(MODEL_FEATURES, w):
        small = small & (F.abs(F.col(c) + float(x) / n) < 1e-4)
    return means.select(small.alias("gradient_is_small"))


STUMP_SQL = """(SELECT c_nationkey AS x, CASE WHEN (c_nationkey > 11) <> (c_custkey % 10 = 0) THEN 1 ELSE 0 END AS y FROM customer)"""


@register("decision_stump_customer", f"""
WITH t AS (SELECT DISTINCT x AS cut FROM {STUMP_SQL}),
g AS (SELECT cut, x <= cut AS side, count(*) AS n, avg(y) AS p FROM {STUMP_SQL}, t GROUP BY 1, 2),
s AS (SELECT cut, sum(n * 2 * p * (1 - p)) AS impurity FROM g GROUP BY cut HAVING count(*) = 2 ORDER BY impurity, cut LIMIT 1)
SELECT CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction, count(*) AS n, min(x) AS lo, max(x) AS hi
FROM {STUMP_SQL} d, g, s WHERE g.cut = s.cut AND g.side = (d.x <= s.cut) GROUP BY 1""")
def decision_stump_customer(spark, sf):
    """A tree of depth 1 splits where SQL finds the lowest impurity."""
    c = table(spark, sf, "customer")
    y = ((F.col("c_nationkey") > 11) != (F.col("c_custkey") % 10 == 0)).cast("int")
    d = c.select(F.col("c_nationkey").cast("double").alias("x"), y.alias("y"))
    model = classify.train_classifier(d, ["x"], "y", "decision_tree", max_depth=1)
    return (classify.predict(model, d, ["x"], "y").groupBy("prediction")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").cast("int").alias("lo"), F.max("x").cast("int").alias("hi")))


@register("cross_validate_folds_quality", f"""
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42')) - 1) % 5 AS INTEGER) AS fold
FROM {E_SQL}""")
def cross_validate_folds_quality(spark, sf):
    return prepare.fold_assignment(labeled_documents(spark, sf).select("doc_id", "quality"), "quality", ["doc_id"], 5)


@register("cross_validate_knn_bounds", "SELECT 5 AS folds, true AS in_bounds, true AS mean_fits")
def cross_validate_knn_bounds(spark, sf):
    """Five accuracies between 0 and 1 and their mean."""
    r = classify.cross_validate(labeled_documents(spark, sf), MODEL_FEATURES, "quality", ["doc_id"], "knn", folds=5)
    fold = F.when(F.col("fold") >= 0, F.col("accuracy"))
    return r.agg(F.count(fold).cast("int").alias("folds"), F.bool_and(fold.between(0, 1)).alias("in_bounds"),
                 (F.abs(F.avg(fold) - F.max(F.when(F.col("fold") == -1, F.col("accuracy")))) < 1e-9).alias("mean_fits"))


EMB = [f"e{i}" for i in range(EMB_DIMS)]


@register("kmeans_embeddings_invariants", "SELECT CAST(10 AS BIGINT) AS clusters, count(*) AS n, true AS centroids_are_means FROM embeddings")
def kmeans_embeddings_invariants(spark, sf):
    """Sizes add up, and every centroid is the mean of its cluster."""
    w = _emb_wide(spark, sf)
    model = cluster.train_kmeans(w, EMB, 10)
    got = cluster.clustering_metrics(model, w, EMB)
    means = cluster.assign_clusters(model, w, EMB).groupBy("cluster").agg(F.array(*[F.avg(c) for c in EMB]).alias("mean"))
    near = F.aggregate(F.zip_with("mean", "centroid", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b)) < 1e-2
    return got.join(means, "cluster").agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("n"), F.bool_and(near).alias("centroids_are_means"))


@register("choose_k_documents_shape", "SELECT k, true AS measured FROM (VALUES (2), (3), (4)) t(k)")
def choose_k_documents_shape(spark, sf):
    data, feats = prepare.prepare_clustering(labeled_documents(spark, sf), MODEL_FEATURES)
    r = cluster.choose_k(data, feats, ks=range(2, 5))
    return r.select("k", ((F.col("inertia") > 0) & F.col("silhouette_sq").between(-1, 1)).alias("measured"))


@register("cluster_points_embeddings_counts", "SELECT false AS is_centroid, count(*) AS n FROM embeddings UNION ALL SELECT true, 10")
def cluster_points_embeddings_counts(spark, sf):
    w = _emb_wide(spark, sf)
    model = cluster.train_kmeans(w, EMB, 10)
    return cluster.cluster_points(model, w, EMB, "e0", "e1").groupBy("is_centroid").agg(F.count(F.lit(1)).alias("n"))


@register("logistic_embeddings_support", f"SELECT CAST(CAST(label AS DOUBLE) AS VARCHAR) AS row, CAST(count(*) AS DOUBLE) AS support FROM {EMB_SPLIT_SQL} WHERE is_test GROUP BY label")
def logistic_embeddings_support(spark, sf):
    split = prepare.stratified_split(_emb_wide(spark, sf), "label", ["vec_id"])
    model = classify.train_classifier(split.where(~F.col("is_test")), EMB, "label", "logistic", max_iter=20)
    rep = metrics.classification_report(classify.predict(model, split.where(F.col("is_test")), EMB, "label"))
    return rep.where(F.col("row").rlike("^[0-9]")).select("row", "support")
