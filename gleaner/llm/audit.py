"""Filter interaction audit: what each order of five filters removes at each step, by part of the corpus.

The state before a step is the set of filters already applied, whatever their order: a node of a lattice of 32 subsets.
A document contributes to its 80 edges (applied subset, next filter) alike for all documents that fail the same
filters, so documents are counted by part and failed filters first, these counts make the edges, and a permutation is a
path of five edges: 600 steps join the edges of each part.

Filters: A fails texts of under 50 words; B those with distinct words under 65 %; C those with capitals over 5 % of
their characters; D those with one of ``#$%&*|``; E those identical to a text of a smaller id, table-wide.

Cases: a null text is the empty one (and identical to other empty ones); a null source is the part of the empty
string; a null id is neither smaller nor larger than another, so that its text never fails E nor makes another fail it;
repeated rows count each, and rows of one id do not fail E by each other; of several labels of an id a 1 counts; texts
of any length are read whole; an empty table has no parts and gives an empty result; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import joined, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
UPPER, SIGNS, WHITE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|", "\t\n\x0b\x0c\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D the text fails."""
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), F.length(F.translate(text, SIGNS, "")) < F.length(text))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and mask (bits 0 to 4: the filters that fail) of each row.

    Texts are read once, into a table of masks and digests; the least id of each digest goes back to its rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failed(whole).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    rows = written(rows, "verdicts")
    told = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return joined(rows, told, ["digest"], rows.count()).select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def tallies(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents by what they fail, and those of them labelled so."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marked = marked.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    both = found.join(marked, "id", "left")  # a hot id, or the null one, is split as a skewed left side
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def edges(counted: DataFrame) -> DataFrame:
    """part, applied (a mask), next (a bit) and the counts of each of the 80 edges, zeros included."""
    spark = counted.sparkSession
    pairs = [(a, 1 << f) for a in range(MASKS) for f in range(len(FILTERS)) if not a >> f & 1]
    lattice = F.broadcast(spark.createDataFrame(pairs, "applied int, next int"))  # 80 rows
    meets, fails = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("next")) != 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias
    return counted.crossJoin(lattice).groupBy("part", "applied", "next").agg(  # at most 32 counts of a part
        total("n", ~meets & ~fails)("kept"), total("n", ~meets & fails)("removed"), total("n", meets & fails)("redundant"), total("n", F.col("mask") == F.col("next"))("unique_fails"),
        total("good", ~meets & fails)("good_lost"), total("toxic", ~meets & fails)("toxic_lost"),
    )


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, applied and next of the 600 steps."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, applied = "".join(FILTERS[f] for f in order), 0
        for k, f in enumerate(order, 1):
            out.append((name, k, applied, 1 << f))
            applied |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step and counts: one row, zeros included, for each part, order and step.

    shapley is what the step's filter removes, summed over all orders: each edge as often as orders go along it.
    """
    spark = docs.sparkSession
    found = written(edges(tallies(verdicts(docs, doc_id, text, part), labels)), "edges")  # 80 rows a part
    paths = spark.createDataFrame(steps(), "filter_order string, step int, applied int, next int")  # 600 rows
    ways = F.broadcast(paths.groupBy("applied", "next").agg(F.count("*").alias("ways")))
    shares = found.join(ways, ["applied", "next"]).groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    along = found.join(F.broadcast(paths), ["applied", "next"]).join(shares, ["part", "next"])
    return along.select("part", "filter_order", "step", *(F.col(c).cast("bigint").alias(c) for c in COUNTS))
