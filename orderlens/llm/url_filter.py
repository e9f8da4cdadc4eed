"""URL filter: host and path rules, and boosted trees for the rest.

A rule names a host and a path prefix; it fits the host and all its subdomains
and the longest rule that fits decides. URLs without a rule are judged by
gradient-boosted trees over lexical features: length, depth, share of digits,
entropy of characters, parameter counts, and statistics of the host's suffix.
The trees are trained on labelled URLs, by default those that a rule decides,
of which at most ``TRAINING_ROWS`` (the least by hash) are used. Everything is
DataFrame functions and Spark's own tree learner; the features' suffix
statistics are counted over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.session import store


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str  # starts with /

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)

TRAINING_ROWS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.2, 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length",
    "host_length",
    "path_length",
    "host_depth",
    "path_depth",
    "digit_ratio",
    "entropy",
    "n_parameters",
    "query_length",
    "n_hyphens",
    "suffix_share",
    "suffix_mean_length",
    "suffix_mean_depth",
)


def _after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))


def host_of(url: Column) -> Column:
    host = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    return F.coalesce(F.when(F.locate("/", rest) > 0, F.substr(rest, F.locate("/", rest))), F.lit(""))


def _fits(rule: UrlRule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))


def _decided(rules: Sequence[UrlRule], value: str) -> Column:
    """The name or verdict of the longest rule that fits; of equally long ones the first."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        result = F.lit(getattr(rule, value))
        out = F.when(_fits(rule), result) if out is None else out.when(_fits(rule), result)
    return F.lit(None).cast("string") if out is None else out


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""

    def share(c: Column) -> Column:
        return _count_of(text, c) / F.length(text)

    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", -share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(F.length(text) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def _count_of(text: Column, c: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, c, F.lit("")))


def _lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path and more) with the features of the URL itself and its suffix."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.when(F.locate("?", url) > 0, F.substr(url, F.locate("?", url) + 1)).otherwise(F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    own = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_depth": _count(host, "."),
        "path_depth": _count(path, "/"),
        "digit_ratio": digits / size,
        "entropy": _entropy(url),
        "n_parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "query_length": F.length(query),
        "n_hyphens": _count(host, "-"),
        "suffix": F.substring_index(host, ".", -1),
    }
    return rows.withColumns({k: v if k == "suffix" else v.cast("double") for k, v in own.items()})


def with_features(rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``rows`` (url, host, path and more) with the lexical features as doubles; suffixes are counted over ``pages``."""
    plain = _lexical(rows)
    counted = plain if pages is None else _lexical(pages)
    per = counted.groupBy("suffix").agg(
        F.count("*").alias("suffix_rows"),
        F.avg("url_length").alias("suffix_mean_length"),
        F.avg("path_depth").alias("suffix_mean_depth"),
    )
    n_pages = (rows if pages is None else pages).count()
    shares = per.withColumn("suffix_share", F.col("suffix_rows") / F.lit(float(max(1, n_pages)))).drop("suffix_rows")
    if pages is None:
        return plain.join(shares, "suffix")
    return plain.join(shares, "suffix", "left").fillna(0.0, [c for c in shares.columns if c != "suffix"])


def train(labelled: DataFrame, rows: int = TRAINING_ROWS):
    """A tree model from rows of features and ``label`` (1.0 block, 0.0 allow), and the commoner label.

    The model is None if one of the labels is missing.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    common = 1.0 if counts.get(1.0, 0) > counts.get(0.0, 0) else 0.0
    if len(counts) < 2:
        return None, common
    # Copies of a URL are one row with their number as its weight; each label has half of the rows.
    features = [F.first(c).alias(c) for c in FEATURES]
    each = labelled.groupBy("url", "label").agg(F.count("*").cast("double").alias("weight"), *features)
    order = [F.xxhash64("url"), F.col("url"), F.col("label")]
    halves = [each.filter(F.col("label") == v).orderBy(*order).limit(rows // 2) for v in (0.0, 1.0)]
    used = halves[0].unionByName(halves[1]).orderBy(*order)
    used = store(used.select(*FEATURES, "label", "weight").coalesce(1), "labelled")
    # The labels weigh as much as they do among all rows.
    held = {r["label"]: r["sum"] for r in used.groupBy("label").agg(F.sum("weight").alias("sum")).collect()}
    scale = F.when(F.col("label") == 1.0, counts[1.0] / held[1.0]).otherwise(counts[0.0] / held[0.0])
    used = used.withColumn("weight", F.col("weight") * scale)
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(used)
    return learner.fit(vectors.select("features", "label", "weight")), common


def judge(pages: DataFrame, rules: Sequence[UrlRule] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every row of ``pages``.

    ``labelled`` (page_id, url, label) replaces the URLs that rules decide as
    training rows. Without both labels the commoner one is the verdict of all
    URLs that no rule fits (allow if there are none). A null url, or one
    without ``://``, has an empty host and path and is judged by the trees on
    what features it has. Repeated rows are judged alike, an empty table gives
    an empty result, and other columns are ignored. URLs may have any length.
    """

    def parts(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})

    rows = parts(pages.select("page_id", "url"))
    rows = rows.withColumns({"rule": _decided(rules, "name"), "decided": _decided(rules, "verdict")})
    featured = store(with_features(rows), "urls")
    if labelled is None:
        known = featured.filter("decided is not null").withColumn("label", (F.col("decided") == "block").cast("double"))
    else:
        known = with_features(parts(labelled.select("page_id", "url", F.col("label").cast("double").alias("label"))), rows)
    model, common = train(known)
    if model is None:
        judged = featured.withColumn("prediction", F.lit(common))
    else:
        judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured))
    own = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"))
