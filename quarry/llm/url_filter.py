"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule is (host, path, verdict); it fits its host and every subdomain where the
URL's path starts with the rule's, and the longest fitting rule wins.  URLs
that no rule decides are judged by boosted trees trained on those that one
does: lengths, depth, digit ratio, character entropy, parameter counts, and
statistics of the host's suffix (how common it is, and its smoothed share of
blocked URLs).  Everything is DataFrame functions and Spark ML; no Python runs
on executors.

Training uses a bounded sample: the ``per_class`` URLs of each verdict that
come first by hash.  Suffix statistics are computed over all rows; the share of
blocked URLs that a labelled row sees leaves out its own fold (equal URLs share
one), so that no row's label reaches its own features.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
PER_CLASS = 5000
TREES = 10
DEPTH = 4
FOLDS = 5                       # folds of the suffix statistics
_FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "hyphens", "params",
             "query_length", "has_fragment", "secure", "suffix_log_count", "suffix_blocked"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lowered, and the path up to ``?`` or ``#``; both empty for null or where ``://`` is missing."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule as host and path in one string, its verdict) of the longest fitting rule; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last applied wins: shortest first
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (url, host, path, rule_verdict) with its features."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    chars = F.split(url, "")
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - (
        (n - F.length(F.replace(url, c, F.lit("")))) / n * F.log2(
            F.greatest((n - F.length(F.replace(url, c, F.lit("")))) / n, F.lit(1e-12)))))
    suffix = F.element_at(F.split(F.col("host"), r"\."), -1)
    fold = F.pmod(F.xxhash64("url", F.lit(FOLDS)), F.lit(FOLDS))
    df = df.select("*", suffix.alias("suffix"), F.when(F.col("rule_verdict").isNotNull(), fold).alias("fold"))
    # one row a suffix: all rows, and (blocked, labelled) of each fold
    stats = df.groupBy("suffix").agg(
        F.log1p(F.count("*").cast("double")).alias("suffix_log_count"),
        *[F.count_if((F.col("fold") == f) & (F.col("rule_verdict") == "block")).alias(f"b{f}") for f in range(FOLDS)],
        *[F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(FOLDS)])

    def others(kind: str) -> Column:
        return reduce(add, [F.when(F.col("fold") == f, 0).otherwise(F.col(f"{kind}{f}")) for f in range(FOLDS)])

    df = (df.join(stats, "suffix").withColumn("suffix_blocked", (others("b") + 1.0) / (others("n") + 2.0))
          .drop("fold", *[f"{kind}{f}" for kind in "bn" for f in range(FOLDS)]))
    return df.select(
        "*", n.cast("double").alias("length"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (F.length(F.regexp_replace(url, r"[^0-9]", "")) / n).alias("digit_ratio"),
        F.when(F.length(url) > 0, entropy).otherwise(0.0).alias("entropy"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")).alias("params"),
        F.length(query).cast("double").alias("query_length"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith(url, F.lit("https:")).cast("double").alias("secure"))


def judge(pages: DataFrame, rules: tuple = RULES, per_class: int = PER_CLASS, trees: int = TREES, depth: int = DEPTH,
          id_col: str = "page_id", url_col: str = "url", seed: int = 31) -> DataFrame:
    """One row per page: id, host, path, rule, verdict (allow or block), and the trees' block probability.

    Null, empty and malformed URLs have empty host and path and are judged by
    the trees like any other; repeated rows are judged each; where the rules
    label no URL, or all alike, there is nothing to train on and unruled URLs
    get the only verdict seen, or allow.  An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = lexical(df.select("*", name.alias("rule"), verdict.alias("rule_verdict")))
    rows = cut_lineage(df.select("id", "url", "host", "path", "rule", "rule_verdict", *_FEATURES))
    order = [F.xxhash64("url", F.lit(seed)), F.col("url")]
    labelled = [rows.where(F.col("rule_verdict") == v).orderBy(*order).limit(per_class) for v in ("allow", "block")]
    train = cut_lineage(labelled[0].unionAll(labelled[1]).select(
        (F.col("rule_verdict") == "block").cast("double").alias("label"), *_FEATURES))
    seen = {r["label"] for r in train.select("label").distinct().collect()}
    out = rows
    if len(seen) == 2:
        vectors = VectorAssembler(inputCols=_FEATURES, outputCol="features")
        # one partition of at most 2 * per_class rows: the same trees whatever the cluster
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(
            vectors.transform(train.coalesce(1).sortWithinPartitions("label", *_FEATURES)))
        from pyspark.ml.functions import vector_to_array
        out = model.transform(vectors.transform(rows)).withColumn("block_probability",
                                                                 vector_to_array("probability")[1])
    else:
        out = out.withColumn("block_probability", F.lit(1.0 if seen == {1.0} else 0.0))
    guessed = F.when(F.col("block_probability") > 0.5, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule",
                      F.coalesce("rule_verdict", guessed).alias("verdict"), "block_probability")
