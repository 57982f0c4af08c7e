"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The pages that a rule decides are the labelled ones. From all of them come the suffix statistics (share
of blocked pages by last host label and by last two), from a bounded sample of their URLs the trees; the
trees judge every URL that no rule fits.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import Stage

# Fixed rules (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE_ROWS = 20_000
SMOOTHING = 5.0
TREES, DEPTH, SEED = 12, 4, 11


def host(url: Column) -> Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """host, path, rule (the longest that fits; else null) and rule_verdict."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        on, _, under = text.partition("/")
        fits = ((F.col("host") == on) | F.col("host").endswith("." + on)) & F.col("path").startswith("/" + under)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return urls.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).select(
        "*", rule.alias("rule"), verdict.alias("rule_verdict"))


def lexical(url: str | None, at: str, under: str) -> list[float]:
    """Lexical features of one URL (nulls and URLs without a host give the features of empty parts)."""
    import math
    from collections import Counter

    url = url or ""

    def entropy(text):
        n = len(text)
        return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0

    def share(text, chars):
        return sum(c in chars for c in text) / len(text) if text else 0.0

    query = url.partition("?")[2].partition("#")[0]
    labels = at.split(".")
    steps = [s for s in under.split("/") if s]
    return [float(len(url)), float(len(at)), float(len(under)), float(len(query)), float(len(steps)), float(len(labels)),
            float(len(query.split("&")) if query else 0), float("#" in url), float(url[:8].lower() == "https://"),
            share(url, "0123456789"), share(at, "0123456789"), share(under, "0123456789"), share(at, "aeiou"),
            float(at.count("-")), float(max(map(len, labels))), float(min(map(len, labels))), entropy(at),
            entropy(under), float(under.endswith("/")), float(len(steps[-1]) if steps else 0),
            float(len(steps[0]) if steps else 0)]


@F.pandas_udf(ArrayType(DoubleType()))
def lexical_features(url: pd.Series, at: pd.Series, under: pd.Series) -> pd.Series:
    return pd.Series([lexical(*x) for x in zip(url, at, under, strict=True)])


def _suffixes(df: DataFrame) -> DataFrame:
    return df.withColumns({"suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2)})


def _statistics(labelled: DataFrame, suffix: str, prior: float) -> DataFrame:
    """Smoothed share of blocked pages and log count by suffix, over all labelled pages."""
    n = F.sum("pages")
    return labelled.groupBy(suffix).agg(
        ((F.sum(F.col("label") * F.col("pages")) + SMOOTHING * prior) / (n + SMOOTHING)).alias(f"{suffix}_blocked"),
        F.log1p(n).alias(f"{suffix}_seen"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules=RULES,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, blocked (the trees' probability).

    A null URL, or one without ``://``, has empty host and path and is judged by the trees like any other.
    Rows may repeat, ids may be null, other columns are ignored. Where the labelled pages lack a verdict
    all other URLs get the one they have; without any labelled URL they are allowed. An empty table gives no rows.
    """
    ruled = _suffixes(with_rule(pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")), rules))
    stage = Stage(pages.sparkSession, "urls")
    labelled = stage.table(
        ruled.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
        .groupBy("url", "host", "path", "suffix1", "suffix2", "label").agg(F.count("*").alias("pages")), "labelled")
    total = {r.label: r.n for r in labelled.groupBy("label").agg(F.sum("pages").alias("n")).collect()}
    if len(total) < 2:
        other = F.lit(float(1.0 in total))
        return _decide(ruled.withColumn("blocked", other))
    prior = total[1.0] / sum(total.values())
    first, second = (stage.table(_statistics(labelled, s, prior), s) for s in ("suffix1", "suffix2"))

    # Distinct URLs of each verdict; their pages are their weight, scaled to all pages of the verdict.
    drawn = [labelled.where(F.col("label") == x).orderBy(F.xxhash64("url", "host"), "url").limit(max(1, sample_rows // 2))
             for x in (0.0, 1.0)]
    sample = stage.table(drawn[0].union(drawn[1]), "sample")
    part = {r.label: r.n for r in sample.groupBy("label").agg(F.sum("pages").alias("n")).collect()}
    scale = F.when(F.col("label") == 1.0, total[1.0] / part[1.0]).otherwise(total[0.0] / part[0.0])

    def features(df: DataFrame) -> DataFrame:
        known = df.join(first, "suffix1", "left").join(second, "suffix2", "left")
        extra = F.array(F.coalesce("suffix1_blocked", F.lit(prior)), F.coalesce("suffix1_seen", F.lit(0.0)),
                        F.coalesce("suffix2_blocked", F.lit(prior)), F.coalesce("suffix2_seen", F.lit(0.0)))
        return known.withColumn("features", array_to_vector(F.concat(lexical_features("url", "host", "path"), extra)))

    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, cacheNodeIds=False, weightCol="weight")
    weighted = features(sample.withColumn("weight", F.col("pages") * scale))
    model = trees.fit(weighted.select("features", "label", "weight").coalesce(2))
    judged = model.transform(features(ruled)).withColumn("blocked", vector_to_array("probability")[1])
    return _decide(judged)


def _decide(df: DataFrame) -> DataFrame:
    by_trees = F.when(F.col("blocked") >= 0.5, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_trees).alias("verdict"), "blocked")
