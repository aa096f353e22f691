"""URL filter: path rules first, then gradient-boosted trees on lexical features.

The rules label the URLs they fit; the trees are fitted to a bounded sample of those labels and
judge the rest. The statistics of suffixes are counted from all labelled URLs, each different
URL once, and out of fold for the sample: a URL that the trees are fitted to has the shares of
the labelled URLs in the other folds, so that its own label isn't among its features. The small
forest is grown once from the sample's feature rows and becomes one column expression, so
scoring stays in the scan. Features: lengths, depth, digit ratio, character entropy, parameter
counts and statistics of suffixes (the share of blocked labels by top-level domain, by registered
domain, by first path segment and by file ending, smoothed by the overall share, which also
stands for suffixes that have no label). Cuts lie half way between neighbouring values.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and
is judged by its (empty) features; without labels of both kinds the verdict is the only kind
seen, or ``allow``; repeated rows get equal verdicts; very long URLs are read whole; an empty
table gives no rows; only page_id and url are read, and other columns may have any names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, own_columns, table, written

#: The rules, as verdict and host with path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labelled URLs the trees are grown from, at most; taken by the lowest hash of the url.
SAMPLE = 5_000
TREES = 30
DEPTH = 3
RATE = 0.3
LEAST = 10
CUTS = 32
SMOOTH = 5.0
#: Folds that a sampled URL is left out of by its own share of the statistics.
FOLDS = 5

SUFFIXES = ("tld", "domain", "segment", "ending")
NUMBERS = (
    "url_length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "hyphens", "entropy",
    "params", "query_length", "fragment", "longest_label", "secure",
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, and the longest fitting rule with its verdict, or nulls."""
    d = own_columns(pages, "page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        domain, path = text[:at], text[at:]
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return d.withColumn("rule", rule).withColumn("ruled", verdict)


def suffix_columns() -> list[Column]:
    """The suffixes of host and path, named as in SUFFIXES."""
    labels, path = F.split(F.col("host"), r"\."), F.col("path")
    return [
        F.coalesce(F.get(labels, F.size(labels) - 1), F.lit("")).alias("tld"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)).alias("domain"),
        F.coalesce(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0)), F.lit("")).alias("segment"),
        F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1).alias("ending"),
    ]


def features(d: DataFrame) -> DataFrame:
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    # Entropy of the host's and path's characters, in bits.
    chars = F.split(F.concat(host, path), "")
    d = d.withColumn("chars", F.filter(chars, lambda c: c != ""))
    counts = F.transform(F.array_distinct("chars"), lambda c: F.size(F.filter("chars", lambda x: x == c)) / F.size("chars"))
    d = d.withColumn("shares", counts)
    entropy = F.aggregate("shares", F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return d.select(
        "page_id", "url", "host", "path", "rule", "ruled",
        F.length(url).cast("double").alias("url_length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        digits.cast("double").alias("digits"),
        (digits / F.greatest(F.length(url), F.lit(1))).cast("double").alias("digit_ratio"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("params"),
        F.length(query).cast("double").alias("query_length"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        url.startswith("https").cast("double").alias("secure"),
        *suffix_columns(),
    )


def halves(values: np.ndarray) -> np.ndarray:
    """Up to CUTS places between different values, evenly by rank."""
    own = np.unique(values)
    between = (own[1:] + own[:-1]) / 2
    if len(between) <= CUTS:
        return between
    return between[np.linspace(0, len(between) - 1, CUTS).round().astype(int)]


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Gradient boosting of the log loss with Newton leaves: the first score and the trees.

    A leaf is a number, a node (feature, cut, low, high).
    """
    cuts = [halves(col) for col in x.T]
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    first = math.log(share / (1 - share))
    score = np.full(len(y), first)
    forest = []

    def grow(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(RATE * g / (h + 1.0))
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * LEAST:
            for f, places in enumerate(cuts):
                col = x[rows, f]
                for c in places:
                    low = col <= c
                    n = int(low.sum())
                    if min(n, len(rows) - n) < LEAST:
                        continue
                    gl, hl = grad[rows[low]].sum(), hess[rows[low]].sum()
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    if gain > best[0]:
                        best = (gain, f, float(c))
        _, f, c = best
        if f is None:
            score[rows] += leaf
            return leaf
        low = x[rows, f] <= c
        return f, c, grow(rows[low], grad, hess, depth - 1), grow(rows[~low], grad, hess, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        if np.abs(y - p).max() < 0.02:
            break
        forest.append(grow(np.arange(len(y)), y - p, p * (1 - p), DEPTH))
    return first, forest


def as_column(tree, inputs: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(F.col(inputs[f]) <= cut, as_column(low, inputs)).otherwise(as_column(high, inputs))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """kind, key, fold, blocked and n: the labelled URLs and the blocked ones of every suffix."""
    d = labelled.select("ruled", fold_of(F.col("url")).alias("fold"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    d = d.select("ruled", "fold", *suffix_columns())
    pairs = F.array(*[F.struct(F.lit(s).alias("kind"), d[s].alias("key")) for s in SUFFIXES])
    d = d.select("fold", F.explode(pairs).alias("s"), (F.col("ruled") == "block").cast("long").alias("block"))
    return d.groupBy("s.kind", "s.key", "fold").agg(F.sum("block").alias("blocked"), F.count(F.lit(1)).alias("n"))


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def labelled_urls(ruled: DataFrame) -> DataFrame:
    return ruled.filter("ruled IS NOT NULL AND url IS NOT NULL").select("url", "ruled").distinct()


@dataclass(frozen=True)
class Model:
    """The forest, and the table of blocked shares by suffix."""

    first: float
    forest: list
    overall: float
    stats: DataFrame

    @property
    def inputs(self) -> list[str]:
        return [*NUMBERS, *(f"{s}_share" for s in SUFFIXES)]


def smoothed(blocked, n, overall: float):
    return (blocked + SMOOTH * overall) / (n + SMOOTH)


def fit(labelled: DataFrame, sample: int = SAMPLE, rules=RULES) -> Model | str:
    """The model of the labelled URLs (url, ruled), or the only verdict there is."""
    spark = labelled.sparkSession
    counts = written(suffix_counts(labelled), "suffixes")
    # Every labelled URL has one top-level domain, if an empty one: those rows count them all.
    of_all = counts.filter(F.col("kind") == "tld").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")).first()
    blocked, n = of_all["blocked"] or 0, of_all["n"] or 0
    if blocked in (0, n):
        return "block" if blocked else "allow"
    overall = blocked / n
    # The bounded sample that the trees are fitted to is gathered once.
    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(sample).collect()
    frame = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(rows)], "page_id long, url string").coalesce(2)
    train = features(with_rules(frame, rules)).select(*NUMBERS, *SUFFIXES, fold_of(F.col("url")).alias("fold"), "page_id").toPandas()
    label = np.array([rows[i]["ruled"] == "block" for i in train["page_id"]], float)
    for s in SUFFIXES:
        # The sample's own suffixes: at most one key for each sampled URL, and FOLDS rows a key.
        own = spark.createDataFrame([(k,) for k in sorted(set(train[s]))], "own string").coalesce(1)
        mine = counts.filter(F.col("kind") == s).join(F.broadcast(own), F.col("key") == F.col("own"), "left_semi").collect()
        total: dict[str, list[int]] = {}
        of_fold = {(r["key"], r["fold"]): (r["blocked"], r["n"]) for r in mine}
        for (key, _), (b, m) in of_fold.items():
            t = total.setdefault(key, [0, 0])
            t[0], t[1] = t[0] + b, t[1] + m
        shares = []
        for key, fold in zip(train[s], train["fold"], strict=True):
            b, m = of_fold.get((key, fold), (0, 0))
            shares.append(smoothed(total[key][0] - b, total[key][1] - m, overall))
        train[f"{s}_share"] = shares
    inputs = [*NUMBERS, *(f"{s}_share" for s in SUFFIXES)]
    first, forest = boost(train[inputs].to_numpy(float), label)
    stats = counts.groupBy("kind", "key").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    return Model(first, forest, overall, written(stats.select("kind", "key", smoothed(F.col("blocked"), F.col("n"), overall).alias("share")), "shares"))


def scored(ruled: DataFrame, model: Model) -> DataFrame:
    """The features of with_rules' rows, and p_block, the trees' probability."""
    d = features(ruled)
    for s in SUFFIXES:
        # These tables have no proven bound: the measured size of what was written decides
        # whether one is broadcast or the join is shuffled.
        share = model.stats.filter(F.col("kind") == s).select(F.col("key").alias(f"{s}_key"), F.col("share").alias(f"{s}_share"))
        d = d.join(share, F.col(s) == F.col(f"{s}_key"), "left")
        d = d.withColumn(f"{s}_share", F.coalesce(f"{s}_share", F.lit(model.overall)))
    score = F.lit(model.first)
    for tree in model.forest:
        score = score + as_column(tree, model.inputs)
    return d.withColumn("p_block", 1 / (1 + F.exp(-score)))


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    ruled = with_rules(pages, rules)
    model = fit(labelled_urls(ruled), sample, rules)
    if isinstance(model, str):
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(model)).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    own = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    return scored(ruled, model).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "p_block")


def op2_url_gbt(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
