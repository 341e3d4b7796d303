"""Association rules (M18): frequent itemsets and rules with FP-Growth.

FP-Growth finds the same itemsets and rules as Apriori for the same minimum
support and confidence, and is Spark's distributed implementation (PFP).
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.session import cut_lineage


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items) with each item once per basket."""
    return df.where(F.col(item).isNotNull()).groupBy(basket).agg(
        F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))


def association_rules(baskets_df: DataFrame, min_support: float = 0.01,
                      min_confidence: float = 0.1, items: str = "items"):
    """Returns (frequent itemsets, rules).

    itemsets: (itemset, size, freq, support); rules: (antecedent, consequent,
    confidence, lift, support). Item lists are sorted arrays."""
    # the baskets feed two counts and the FP-tree pass: materialise them once
    baskets_df = cut_lineage(baskets_df)
    model = FPGrowth(itemsCol=items, minSupport=min_support,
                     minConfidence=min_confidence).fit(baskets_df)
    n = baskets_df.count()
    fi = model.freqItemsets.select(
        F.array_sort("items").alias("itemset"),
        F.size("items").alias("size"), F.col("freq").cast("long").alias("freq"),
        (F.col("freq") / F.lit(n)).alias("support"))
    ar = model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.array_sort("consequent").alias("consequent"),
        "confidence", "lift", "support")
    return fi, ar
