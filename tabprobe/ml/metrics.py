"""Classification metrics (M9-M11), all derived from one grouped count of
(label, prediction) pairs -- a table with at most k x k rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (pred.groupBy(F.col(label).cast("double").alias("label"),
                         F.col(prediction).cast("double").alias("prediction"))
                .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) over all class pairs, zeros included. The
    k x k grid is the result itself; Spark builds it from the class list."""
    pc = pair_counts(pred, label, prediction)
    classes = pc.select(F.col("label").alias("c")).union(pc.select(F.col("prediction").alias("c"))).distinct()
    grid = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))
    return (grid.join(pc, ["label", "prediction"], "left")
                .select("label", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
                .orderBy("label", "prediction"))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, tp, support, predicted, precision, recall, f1); empty
    denominators give 0, as in the reference's default."""
    pc = pair_counts(pred, label, prediction)
    sup = pc.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"))
    prd = pc.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    tp = pc.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("class"), F.col("n").alias("tp"))
    t = (sup.join(prd, "class", "full").join(tp, "class", "left")
            .fillna(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return t.withColumn("f1", f1).select(
        "class", F.col("tp").cast("long").alias("tp"), F.col("support").cast("long").alias("support"),
        F.col("predicted").cast("long").alias("predicted"), "precision", "recall", "f1")


def classification_metrics(pred: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """M9: one row -- accuracy and support-weighted precision, recall, F1."""
    pcl = per_class(pred, label, prediction)
    n = F.sum("support")
    return pcl.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"))


def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction",
                          target_names: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``
    -- (row, precision, recall, f1, support). ``target_names`` names the classes: the
    class table of ``index_labels``, or names by class number."""
    pcl = per_class(pred, label, prediction)
    named = pcl
    title = F.col("class").cast("string")
    if target_names is not None:
        table = target_names if isinstance(target_names, DataFrame) else pcl.sparkSession.createDataFrame(
            list(enumerate(target_names)), "class_index int, class_name string")
        named = pcl.join(table.select(F.col("class_index").cast("double").alias("class"), F.col("class_name").cast("string").alias("_name")),
                         "class", "left")
        title = F.coalesce("_name", title)
    rows = named.select(
        title.alias("row"), "precision", "recall", "f1",
        F.col("support").cast("double").alias("support"))
    labelled = pcl
    n = F.sum("support")
    macro = labelled.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                         F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                         n.cast("double").alias("support"))
    weighted = labelled.agg(F.lit("weighted avg").alias("row"),
                            (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                            (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                            (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"),
                            n.cast("double").alias("support"))
    acc = pcl.agg(F.lit("accuracy").alias("row"), (F.sum("tp") / n).alias("precision"),
                  (F.sum("tp") / n).alias("recall"), (F.sum("tp") / n).alias("f1"),
                  n.cast("double").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)
