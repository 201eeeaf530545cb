"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and the start of a path; a rule decides the URLs of its host
and of all subdomains. The URLs that rules decide are the labelled ones: trees
learn from them how blocked and allowed URLs look (length, depth, digits,
entropy, parameters, how frequent suffix and host are) and judge the others.
Everything here is DataFrame functions; training takes a bounded sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host, start of the path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_TRAINING_URLS = 10_000   # labelled URLs that the trees are fitted on
LEAST_SHARE = 1e-4           # rarer suffixes and hosts count as share 0: at most 10,000 have more
TREES, DEPTH, SEED = 20, 4, 3

FEATURES = (
    "f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens",
    "f_entropy", "f_parameters", "f_query_length", "f_fragment", "f_secure", "f_suffix_length", "f_suffix_share",
    "f_host_share",
)


def parts(urls: DataFrame) -> DataFrame:
    """page_id, url, host, path, rest (all after ``://``)."""
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    lower = F.translate(
        F.regexp_extract("rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return urls.select(F.col("page_id"), url.alias("url")).withColumn("rest", F.coalesce(rest, F.lit(""))).withColumns({
        "host": lower, "path": F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1),
    })


def deciding_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    decided = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, host, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(start)
        decided = F.when(fits, F.struct(F.lit(host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(decided)
    return decided


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Bits per character of a text's own character distribution."""
    n = F.greatest(F.length(text), F.lit(1))
    kinds = F.array_distinct(F.split(text, ""))
    each = F.transform(kinds, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.coalesce(F.aggregate(
        F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    ), F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Feature columns that follow from the URL itself, and ``suffix``."""
    url, host, path, rest = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "host", "path", "rest"))
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    suffix = F.substring_index(host, ".", -1)
    number = {
        "f_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length(path),
        "f_depth": _count(path, "/"), "f_labels": _count(host, ".") + 1,
        "f_digits": _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "f_host_digits": _count(host, "0123456789"), "f_hyphens": _count(host, "-"), "f_entropy": entropy(url),
        "f_parameters": _count(query, "="), "f_query_length": F.length(query),
        "f_fragment": F.contains(rest, F.lit("#")).cast("int"), "f_secure": F.startswith(url, F.lit("https")).cast("int"),
        "f_suffix_length": F.length(suffix),
    }
    return urls.withColumn("suffix", suffix).withColumns({k: v.cast("double") for k, v in number.items()})


def shares(urls: DataFrame, key: str, total: int) -> DataFrame:
    """Share of all URLs per value of ``key``, where it is at least
    ``LEAST_SHARE``: no more than 1 / LEAST_SHARE rows, whatever the corpus."""
    counts = urls.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SHARE * total)
    return counts.select(key, F.log1p(F.col("n") / total * 10_000).alias(f"f_{key}_share"))


def judge_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
               max_training: int = MAX_TRAINING_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, score.

    ``score`` is the trees' probability of block (null where a rule decides, or
    nothing could be learnt). Takes ``page_id`` and ``url``; rows may repeat and
    be null: a null URL, or one without ``://``, has an empty host and path and
    is judged by the trees. Without labelled URLs everything else is allowed; if
    all labelled URLs share a verdict, the others get it. No rows: no row.
    """
    base = parts(urls).withColumn("_decided", deciding_rule(rules))
    total = base.count()
    described = lexical(base)
    for key in ("suffix", "host"):
        described = described.join(F.broadcast(shares(described, key, total)), key, "left").fillna(0.0, [f"f_{key}_share"])
    labelled = described.filter(F.col("_decided").isNotNull()).withColumn(
        "_label", (F.col("_decided.verdict") == "block").cast("double")
    ).select("_label", "url", *FEATURES).orderBy(F.xxhash64("url"), "url").limit(max_training)
    kinds = {r["_label"]: r["count"] for r in labelled.groupBy("_label").count().collect()}
    result = described.select("page_id", "host", "path", "_decided", *FEATURES)
    if len(kinds) == 2:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        trees = GBTClassifier(
            featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, seed=SEED,
        )
        model = trees.fit(vectors.transform(labelled).select("_label", "_features"))
        result = model.transform(vectors.transform(result)).withColumn(
            "_score", vector_to_array("probability")[1]
        )
    else:
        result = result.withColumn("_score", F.lit(next(iter(kinds), None)).cast("double"))
    verdict = F.when(F.col("_decided").isNotNull(), F.col("_decided.verdict")).otherwise(
        F.when(F.col("_score") >= 0.5, "block").otherwise("allow")
    )
    return result.select(
        "page_id", "host", "path", F.col("_decided.rule").alias("rule"), verdict.alias("verdict"),
        F.when(F.col("_decided").isNull(), F.col("_score")).alias("score"),
    )
