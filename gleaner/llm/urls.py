"""URL filters: rules by host suffix and path prefix, and gradient-boosted trees for what no rule decides.

The trees see lexical features of the url, and statistics of its host's suffix (the last label) over all pages: how
many urls with it a rule decides, and which share of these is blocked, smoothed. They are trained from the urls that
a rule decides; there the share is that of the other folds only (urls fall into folds by their hashes, repeated ones into
one), so that it says nothing of the url itself and the trees learn to trust it as they will find it.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; it is scored as an empty
text; without decided urls of both kinds every other url is allowed or blocked as the decided ones are (allowed
if there are none); equal rules give the same verdict, the first listed naming it; urls of any length are read whole;
repeated rows are judged each, and repeated urls are learned from once; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import joined, with_package, written

ALLOW, BLOCK = "allow", "block"
#: Decided urls that the trees are trained from, at most.
MAX_ROWS = 20_000
#: Folds of urls, for shares that leave the url's own out.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host/path prefix

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def by_rule(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and decided: of the longest rule that fits, or null."""
    host, path = split_url(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule = decided = F.lit(None).cast("string")
    # shorter rules first, so that longer ones are asked before them; of equal ones the first listed
    for r in sorted(reversed(rules), key=lambda r: len(r.pattern)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, decided = F.when(fits, r.pattern).otherwise(rule), F.when(fits, r.verdict).otherwise(decided)
    return out.withColumn("rule", rule).withColumn("decided", decided)


FEATURES = (
    "length", "host length", "path length", "host labels", "path depth", "digit ratio", "host digits", "hyphens in host", "entropy", "host entropy",
    "parameters", "query length", "has fragment", "last label length", "longest label", "vowel ratio of host", "https", "first digit of the path", "decided urls with the suffix", "blocked share of the suffix",
)


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(text)
    return float(-(n * np.log2(n)).sum())


def lexical(url: str | None, blocked: int = 0, decided: int = 0) -> list[float]:
    """The numbers of FEATURES; blocked, decided: urls with the suffix that rules block and decide."""
    url = url or ""
    scheme, _, rest = url.partition("://")
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    labels, digits = host.split("."), sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(slash + path), len(labels), path.count("/") + bool(slash), digits / max(1, len(url)), sum(c.isdigit() for c in host), host.count("-"), _entropy(url), _entropy(host),
        query.count("=") , len(query), bool(fragment), len(labels[-1]), max(map(len, labels)), sum(c in "aeiou" for c in host.lower()) / max(1, len(host)), scheme.lower() == "https", next((int(c) for c in path if c in "0123456789"), -1), np.log1p(decided), (blocked + 1) / (decided + 2),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: a feature and threshold for each inner node, a value for each leaf."""

    base: float
    feature: np.ndarray  # tree, inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), int)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaf[at - inner] if len(x) else 0
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are looked for among quantiles of each feature."""
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else float(y[0]) * 20 - 10
        return Trees(base if len(y) else -10.0, np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    margin = np.full(len(y), base := float(np.log(y.mean() / (1 - y.mean()))))
    inner, made = 2**depth - 1, ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, where = 1e-9, None
            whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for f, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                gs, hs = (np.cumsum(np.bincount(binned[rows, f], w[rows], len(c) + 1))[:-1] for w in (g, h))
                gain = gs**2 / (hs + ridge) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + ridge) - whole
                if gain[k := int(gain.argmax())] > best:
                    best, where = gain[k], (f, c[k])
            if where:
                feature[node], threshold[node] = where
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        leaf = np.array([g[at == k].sum() / (h[at == k].sum() + ridge) * rate for k in range(inner, 2 * inner + 1)])
        margin += leaf[at - inner]
        for to, v in zip(made, (feature, threshold, leaf)):
            to.append(v)
    return Trees(base, *map(np.array, made))


def with_suffixes(decided: DataFrame, url: str = "url") -> DataFrame:
    """Adds STATS of the suffix over all rows (with host and decided), and of the rows of the other folds alone."""
    rows = decided.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("fold", F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int"))
    rows = written(rows, "suffixes")
    bad, known = F.col("decided") == BLOCK, F.col("decided").isNotNull()
    each = lambda test: F.array(*(F.count_if(test & (F.col("fold") == k)) for k in range(FOLDS)))
    stats = rows.groupBy("suffix").agg(F.count("*").alias("n"), each(bad).alias("_bad"), each(known).alias("_known"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, b: a + b)
    found = joined(rows, written(stats, "suffix_counts"), ["suffix"], rows.count())
    found = found.withColumns({"suffix_blocked": total("_bad"), "suffix_decided": total("_known")})
    others = {f"other_{c[7:]}": F.col(c) - F.get(F.col(a), F.col("fold")) for c, a in (("suffix_blocked", "_bad"), ("suffix_decided", "_known"))}
    return found.withColumns(others).drop("_bad", "_known")


STATS, OTHERS = ["suffix_blocked", "suffix_decided"], ["other_blocked", "other_decided"]


def train(decided: DataFrame, url: str = "url", max_rows: int = MAX_ROWS) -> Trees:
    """Trains from at most ``max_rows`` decided urls; which ones hangs on hashes of the urls only."""
    rows = decided.where(F.col("decided").isNotNull() & F.col(url).isNotNull()).select(url, (F.col("decided") == BLOCK).cast("int").alias("y"), *OTHERS).distinct()
    got = rows.orderBy(F.xxhash64(url), url, "y").limit(max_rows).collect()
    x = [lexical(r[url], *(r[c] for c in OTHERS)) for r in got]
    return boost(np.array(x, float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", max_rows: int = MAX_ROWS) -> DataFrame:
    """key, host, path, rule, verdict and the trees' probability that the url is to be blocked."""
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    decided = written(with_suffixes(by_rule(rows, rules, "_url"), "_url"), "decided")
    sent = pages.sparkSession.sparkContext.broadcast(train(decided, "_url", max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [lexical(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("_url", *STATS)))]
            p = 1 / (1 + np.exp(-np.clip(sent.value.margin(np.array(x, float)), -40, 40)))
            by = batch.column("decided").to_pylist()
            verdict = [d or (BLOCK if x >= 0.5 else ALLOW) for d, x in zip(by, p)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("_key", "host", "path", "rule")), pa.array(verdict), pa.array(p)], names=[key, "host", "path", "rule", "verdict", "block_probability"])

    kind = pages.schema[key].dataType.simpleString()
    return with_package(decided).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, block_probability double")
