"""URL filters: host rules, and gradient-boosted trees on lexical features.

Everything is column expressions: features, the fitted trees (compiled to
nested conditions) and the rules run inside generated code. The trees are
fitted on labelled URLs, here those that a rule decides; of them, distinct,
about half of ``MOST_TRAINED`` of each label at most, by a hash of the URL, with
weights that restore their numbers. Suffix statistics are block rates over all
labelled URLs, by a hash of the suffix into ``SUFFIX_BINS`` bins, which bounds
what is sent with a plan. A URL that is fitted gets the rates of the other half
of the labelled URLs, so its own label isn't among its features.

Edge cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule, and is judged by its (constant) features; labels of one kind
only, or none, leave nothing to fit, and the method allows everything; rows
that repeat are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchloom.llm.common import lower_ascii, pick, stage

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MOST_TRAINED = 20_000
SUFFIX_BINS = 512
TREES, DEPTH, STEP = 10, 3, 0.3
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&%#:"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), lower_ascii(F.regexp_extract(after, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of the same length: the longer host), and
    its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Last label of the host, last two, and the first folder of the path."""
    return {
        "top": F.substring_index(host, ".", -1),
        "domain": F.substring_index(host, ".", -2),
        "folder": F.regexp_extract(path, r"^/([^/]*)/", 1),
    }


def _bin(suffix: Column) -> Column:
    return F.pmod(F.xxhash64(suffix), F.lit(SUFFIX_BINS)).cast("int")


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(2))


def features(url: Column, host: Column, path: Column, rates: dict[str, list[float]], apart=None) -> dict[str, Column]:
    """Lexical features of a URL; rates: block rate by bin of each suffix. apart:
    such rates of each half of the labelled URLs, where a URL takes those of the other half."""
    text = F.coalesce(url, F.lit(""))
    lowered = lower_ascii(text)
    size = F.greatest(F.length(text), F.lit(1))
    counts = [_occurrences(lowered, c) for c in _ALPHABET]
    rest = size - reduce(lambda a, b: a + b, counts)
    share = [F.greatest(c, F.lit(0)) / size for c in [*counts, rest]]
    entropy = reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share])
    query = F.when(F.contains(text, F.lit("?")), F.regexp_extract(text, r"\?([^#]*)", 1)).otherwise("")
    out = {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _occurrences(path, "/"),
        "labels": _occurrences(host, ".") + 1,
        "hyphens": _occurrences(host, "-"),
        "digit_ratio": F.length(F.regexp_replace(text, r"[^0-9]", "")) / size,
        "host_digits": F.length(F.regexp_replace(host, r"[^0-9]", "")),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(_occurrences(query, "&") + 1),
        "fragment": F.contains(text, F.lit("#")).cast("int"),
        "secure": F.startswith(lowered, F.lit("https:")).cast("int"),
    }
    for name, suffix in _suffixes(host, path).items():
        rate = lambda r, at=_bin(suffix) + 1, name=name: F.element_at(F.array(*[F.lit(x) for x in r[name]]), at)
        out[f"{name}_rate"] = rate(rates) if apart is None else F.when(_fold(url) == 0, rate(apart[1])).otherwise(rate(apart[0]))
    return {k: v.cast("double") for k, v in out.items()}


def _compiled(node, columns: list[Column]) -> Column:
    """A fitted tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _compiled(node.leftChild(), columns), _compiled(node.rightChild(), columns)
    return F.when(columns[split.featureIndex()] <= float(split.threshold()), left).otherwise(right)


class UrlModel:
    """Block rates of suffixes, and trees; ``trees`` is None where there was nothing to fit."""

    def __init__(self, rates: dict[str, list[float]], trees):
        self.rates, self.trees = rates, trees

    def margin(self, row: dict[str, Column]) -> Column:
        """Above 0: block. row: columns that hold the features, by name."""
        if self.trees is None:
            return F.lit(-1.0)
        columns = list(row.values())
        parts = [F.lit(w) * _compiled(node, columns) for w, node in self.trees]
        return reduce(lambda a, b: a + b, parts)


def fit(labelled: DataFrame, most: int = MOST_TRAINED) -> UrlModel:
    """Fits on ``labelled(url, host, path, label)``; label 1: block."""
    labelled = stage(labelled.groupBy("url", "host", "path").agg(F.max("label").alias("label")), "labelled-urls")
    total, blocked = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (blocked + 1) / (total + 2)
    rates, apart = {}, ({}, {})
    for name, suffix in _suffixes(F.col("host"), F.col("path")).items():
        found = labelled.groupBy(_bin(suffix).alias("bin"), _fold(F.col("url")).alias("fold"))
        rows = found.agg(F.sum("label").alias("b"), F.count("*").alias("n")).collect()  # 2 * SUFFIX_BINS rows at most
        for into, folds in ((rates, (0, 1)), (apart[0], (0,)), (apart[1], (1,))):
            sums = {i: (0, 0) for i in range(SUFFIX_BINS)}
            for r in rows:
                if r["fold"] in folds:
                    b, n = sums[r["bin"]]
                    sums[r["bin"]] = b + r["b"], n + r["n"]
            into[name] = [(b + 2 * prior) / (n + 2) for b, n in (sums[i] for i in range(SUFFIX_BINS))]
    if not 0 < blocked < total:
        return UrlModel(rates, None)
    share = {label: min(1.0, most / 2 / n) for label, n in ((0, total - blocked), (1, blocked))}
    of_label = lambda x: F.when(F.col("label") == 1, F.lit(x[1])).otherwise(F.lit(x[0]))
    limit = of_label({label: math.ceil(s * (1 << 40)) for label, s in share.items()})
    labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < limit)
    row = features(F.col("url"), F.col("host"), F.col("path"), rates, apart)
    weight = of_label({label: max(share.values()) / s for label, s in share.items()})
    table = labelled.select(*[c.alias(n) for n, c in row.items()], F.col("label").cast("double").alias("label"), weight.alias("weight"))
    table = stage(table, "url-features")
    table = VectorAssembler(inputCols=list(row), outputCol="features").transform(table).coalesce(2)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=32, weightCol="weight")
    model = trees.fit(table.select("features", "label", "weight"))
    java = model._java_obj
    return UrlModel(rates, [(w, t.rootNode()) for w, t in zip(java.treeWeights(), java.trees(), strict=True)])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the trees' margin."""
    rows = pick(pages, "page_id", "url")
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("*", *[F.coalesce(c, F.lit("")).alias(n) for n, c in (("h", F.col("host")), ("p", F.col("path")))])
    rows = rows.select("page_id", "url", F.col("h").alias("host"), F.col("p").alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    labelled = rows.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("int"))
    model = fit(labelled.select("url", "host", "path", "label"))
    row = features(F.col("url"), F.col("host"), F.col("path"), model.rates)
    rows = rows.select("page_id", "host", "path", "rule", "ruled", *[c.alias(f"_{n}") for n, c in row.items()])
    rows = rows.withColumn("margin", model.margin({n: F.col(f"_{n}") for n in row}))
    own = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "margin")
