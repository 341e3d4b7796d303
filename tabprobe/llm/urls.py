"""URL filters: domain rules first, gradient-boosted trees for the rest.

A rule names a domain and a path prefix and fits its host and all subdomains;
of several fitting rules the longest wins. URLs that no rule decides are judged
by gradient-boosted trees on lexical features (lengths, depth, digit ratio,
character entropy, parameter counts, host labels, suffix statistics), trained
from labelled URLs.

A suffix's rate says nothing about the very URLs it is counted over, so for training it is
taken out of fold: without the URLs of the row's own fold. Where rules give the labels, a rule's URLs are
one fold, as its suffixes would only spell out the rule (which names suffixes and sections): a URL sees the
rates of the other rules' URLs, as an undecided one does, and each rate for half of the URLs only, so that the
lexical signs count beside them. ``fold_accuracy`` measures it on rules left out.

Scale: everything is row-wise SQL but for training, which uses a bounded
sample (``SAMPLE_ROWS`` distinct labelled URLs, chosen by hash). Suffix
statistics are counted over all labelled URLs and kept, one row per suffix, as a
table that is joined to the URLs by key.

Defined results: a URL that is null or lacks ``://`` has an empty host and path
and is judged by the trees like any other; when only one kind of label exists,
all undecided URLs get it, without labels they are allowed; repeated rows get
the same verdict; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.session import cut_lineage

SAMPLE_ROWS = 4000  # documented bound of the training sample
TREES, DEPTH = 12, 4
FOLDS = 5
SEED = 11


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    """``example.net/en/`` -> (``example.net``, ``/en/``)."""
    domain, slash, rest = rule.partition("/")
    return domain, slash + rest


def matched_rule(host_col: Column, path_col: Column, rules: list[str]) -> Column:
    """The longest fitting rule (null: none); equally long ones in text order."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # later ones win
        domain, prefix = split_rule(rule)
        fits = ((host_col == domain) | F.endswith(host_col, F.lit("." + domain))) & F.startswith(path_col, F.lit(prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character of a text's own character distribution."""
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    signs = F.array_distinct(chars)
    def part(c):
        k = F.size(F.filter(chars, lambda x: x == c)).cast("double")
        return -(k / n) * F.log2(k / n)
    return F.coalesce(F.aggregate(F.transform(signs, part), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def _share(text: Column, chars: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, chars, ""))) / n).otherwise(0.0)


FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digits_host",
            "digits_path", "parameters", "fragment", "secure", "extension", "entropy_host", "entropy_path",
            "longest_label", "vowels_host", "section_length", "suffix_1", "suffix_2", "suffix_host", "suffix_section"]

LEXICAL = [f for f in FEATURES if not f.startswith("suffix_")]


def suffix_keys(host_col: Column, path_col: Column) -> dict[str, Column]:
    """Texts whose label statistics become features."""
    parts = F.split(host_col, r"\.")
    tail = lambda k: F.array_join(F.slice(parts, -F.least(F.lit(k), F.size(parts)), F.lit(k)), ".")
    section = F.regexp_extract(path_col, r"^/([^/]*)", 1)
    return {"suffix_1": F.concat(F.lit("1 "), tail(1)), "suffix_2": F.concat(F.lit("2 "), tail(2)),
            "suffix_host": F.concat(F.lit("h "), host_col), "suffix_section": F.concat(F.lit("s "), tail(1), F.lit(" "), section)}


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Append host, path and the lexical features (suffix keys as text)."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    h, p, q = F.col("host"), F.col("path"), F.regexp_extract(u, r"\?([^#]*)", 1)
    parts = F.split(h, r"\.")
    num = {
        "url_length": F.length(u), "host_length": F.length(h), "path_length": F.length(p), "query_length": F.length(q),
        "depth": F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))), "labels": F.size(parts),
        "hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))),
        "digits_host": _share(h, "[0-9]"), "digits_path": _share(p, "[0-9]"),
        "parameters": F.when(q == "", 0).otherwise(F.size(F.split(q, "&"))),
        "fragment": F.instr(u, "#") > 0, "secure": F.startswith(u, F.lit("https")),
        "extension": p.rlike(r"\.[a-z]{2,5}$"), "entropy_host": _entropy(h), "entropy_path": _entropy(p),
        "longest_label": F.array_max(F.transform(parts, F.length)), "vowels_host": _share(h, "[aeiou]"),
        "section_length": F.length(F.regexp_extract(p, r"^/([^/]*)", 1)),
    }
    df = df.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    return df.withColumns({k: v.cast("double") for k, v in num.items()} | suffix_keys(h, p))


class UrlModel:
    """Suffix statistics and boosted trees, or one constant verdict."""

    def __init__(self, prior: float, stats: DataFrame | None = None, trees=None):
        self.prior, self.stats, self.trees = prior, stats, trees
        self.names = FEATURES if stats is not None else LEXICAL

    def features(self, df: DataFrame) -> DataFrame:
        """Replace the suffix keys by their block rates."""
        names = [f for f in FEATURES if f.startswith("suffix_")]
        for n in names if self.stats is not None else []:
            rates = self.stats.select(F.col("k").alias("_k"), F.col("rate").alias("_rate"))  # a row per key
            df = df.join(rates, F.col(n) == F.col("_k"), "left").withColumn(n, F.coalesce("_rate", F.lit(self.prior))).drop("_k", "_rate")
        return df

    def block_score(self, df: DataFrame) -> DataFrame:
        """Append ``block_score``, the probability of "block"."""
        if self.trees is None:
            return df.withColumn("block_score", F.lit(float(self.prior)))
        data = VectorAssembler(inputCols=self.names, outputCol="_x").transform(self.features(df))
        out = self.trees.transform(data)
        return out.withColumn("block_score", vector_to_array("probability").getItem(1))


def out_of_fold(sample: DataFrame, counts: DataFrame, prior: float) -> DataFrame:
    """The sample's (url, y, fold) lexical rows with each suffix key replaced by its block rate among the other
    folds. ``counts``: k, fold, b, n."""
    names = [f for f in FEATURES if f.startswith("suffix_")]
    keys = sample.select("url", "fold", F.explode(F.array(*[F.struct(F.lit(x).alias("f"), F.col(x).alias("k")) for x in names])).alias("z"))
    keys = keys.select("url", "fold", "z.f", "z.k")
    every = counts.groupBy("k").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    own = counts.select("k", "fold", F.col("b").alias("own_b"), F.col("n").alias("own_n"))
    rates = (keys.join(every, "k").join(own, ["k", "fold"])
                 .withColumn("rate", (F.col("b") - F.col("own_b") + 2 * prior) / (F.col("n") - F.col("own_n") + 2))
                 .groupBy("url", "fold").agg(F.map_from_entries(F.collect_list(F.struct("f", "rate"))).alias("rates")))  # a few entries a URL
    return sample.join(rates, ["url", "fold"]).withColumns({x: F.col("rates")[x] for x in names}).drop("rates")


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "block", sample_rows: int = SAMPLE_ROWS, suffixes: bool = True,
          fold_col: str | None = None) -> UrlModel:
    """Fit on rows with a URL and a 0/1 label (null labels are ignored); without ``suffixes``
    on the features of the URL alone. ``fold_col``: the folds of the suffix rates (a URL is in one of
    them), by default ``FOLDS`` by hash."""
    by_hash = F.pmod(F.xxhash64(F.col(url_col), F.lit(SEED + 1)), F.lit(FOLDS))
    src = labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("y"),
                                                              (by_hash if fold_col is None else F.col(fold_col)).alias("fold"))
    total = src.agg(F.sum("y"), F.count("y")).first()
    if not total[1]:
        return UrlModel(0.0)
    prior = total[0] / total[1]
    if prior in (0.0, 1.0):
        return UrlModel(prior)
    sample = src.groupBy("url").agg(F.max("y").alias("y"), F.max("fold").alias("fold")).orderBy(F.xxhash64("url", F.lit(SEED)), "url").limit(sample_rows)
    if suffixes:
        # block rates of all suffixes, counted over all labelled URLs
        names = [f for f in FEATURES if f.startswith("suffix_")]
        counts = cut_lineage(lexical(src.where("url IS NOT NULL")).select(F.explode(F.array(*names)).alias("k"), "fold", "y").groupBy("k", "fold")
                             .agg(F.sum("y").alias("b"), F.count("y").alias("n")))
        stats = counts.groupBy("k").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).select("k", ((F.col("b") + 2 * prior) / (F.col("n") + 2)).alias("rate"))
        model = UrlModel(prior, cut_lineage(stats))
        rows = out_of_fold(cut_lineage(lexical(sample.where("url IS NOT NULL"))), counts, prior)
        if fold_col is not None:
            # URLs of one fold share their rates, which would tell the fold: a hash withholds half of each rate
            rows = rows.withColumns({x: F.when(F.pmod(F.xxhash64("url", F.lit(x)), F.lit(2)) == 0, F.col(x)).otherwise(prior) for x in names})
    else:
        model, rows = UrlModel(prior), lexical(sample)
    data = cut_lineage(VectorAssembler(inputCols=model.names, outputCol="_x").transform(rows).select("_x", "y").repartition(4))
    if data.select("y").distinct().count() == 2:
        model.trees = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3).fit(data)
    return model


def fold_accuracy(labelled: DataFrame, fold_col: str, url_col: str = "url", label_col: str = "block", suffixes: bool = True) -> dict[str, tuple[int, int]]:
    """(URLs judged right, URLs) of each fold by a model trained on the others, whose folds are those of its suffix
    rates; one fit a fold."""
    out = {}
    for r in labelled.where(F.col(label_col).isNotNull() & F.col(fold_col).isNotNull()).select(fold_col).distinct().orderBy(fold_col).collect():
        mine = F.col(fold_col) == r[0]
        model = train(labelled.where(~mine), url_col, label_col, suffixes=suffixes, fold_col=fold_col)
        rows = labelled.where(mine & F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).alias("_y"))
        got = model.block_score(lexical(rows)).agg(F.sum(((F.col("block_score") >= 0.5) == (F.col("_y") > 0)).cast("int")), F.count("*")).first()
        out[r[0]] = (got[0] or 0, got[1])
    return out


def judge(pages: DataFrame, block: list[str], allow: list[str], url_col: str = "url", label_col: str | None = None,
          model: UrlModel | None = None) -> DataFrame:
    """Append host, path, rule (null: none fits), block_score and verdict; input
    columns of these names are replaced.

    Without a model, one is trained from the labelled URLs: those with a 0/1
    value in ``label_col``, or else those that a rule decides."""
    blocked = set(block)
    if blocked & set(allow):
        raise ValueError("a rule both blocks and allows")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "block_score", "verdict")]
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(url_col).cast("string").alias("_url"))
    df = lexical(df, "_url")
    df = df.withColumn("rule", matched_rule(F.col("host"), F.col("path"), [*block, *allow]))
    by_rule = F.when(F.col("rule").isin(*blocked) if blocked else F.lit(False), "block").when(F.col("rule").isNotNull(), "allow")
    if model is None:
        label = F.col(f"_row.{label_col}") if label_col else F.when(by_rule == "block", 1).when(by_rule == "allow", 0)
        model = train(df.select(F.col("_url").alias("url"), label.alias("block"), "rule"), fold_col=None if label_col else "rule")
    out = model.block_score(df)
    verdict = F.coalesce(by_rule, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select("_row.*", "host", "path", "rule", "block_score", verdict.alias("verdict"))
