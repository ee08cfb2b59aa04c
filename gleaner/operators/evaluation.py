"""Evaluation of retrieval and answers: ranks of expected files, recall, distractors, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id and hit_rank: the first rank of the expected path (question_id, expected), null for a miss."""
    found = hits.join(questions.select("question_id", F.col("expected").alias("path")), ["question_id", "path"]).groupBy("question_id").agg(F.min("rank").alias("hit_rank"))
    return questions.select("question_id").join(found, "question_id", "left")


def recall_at(ranks: DataFrame, *at: int) -> DataFrame:
    """n, the mean reciprocal rank and, for each k, the number and share of questions with a hit within k."""
    within = [F.count_if(F.col("hit_rank") <= k) for k in at]
    shares = [x for k, c in zip(at, within) for x in (c.alias(f"hits_at_{k}"), F.round(c / F.count("*"), 6).alias(f"recall_at_{k}"))]
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mean_reciprocal_rank"), *shares)


def source_scores(expected: Column, used: Column, distractors: Column) -> dict[str, Column]:
    """Of one answer: correct, expected and used (distinct files), perfect (none is missing) and distractors cited."""
    own = F.array_distinct(used)
    right = F.size(F.array_intersect(expected, used))
    n = F.size(F.array_distinct(expected))
    return {"correct": right, "n_expected": n, "n_used": F.size(own), "perfect": right == n, "distracted": F.size(F.array_intersect(own, distractors))}


def by_difficulty(answers: DataFrame) -> DataFrame:
    """Scores of answers (difficulty, ok, expected, used, distractors) by difficulty, and of all (difficulty null).

    Answers that failed count as questions and score nothing.
    """
    used = F.when(F.col("ok"), F.col("used")).otherwise(F.array().cast("array<string>"))
    scored = answers.select("difficulty", "ok", *(c.alias(n) for n, c in source_scores(F.col("expected"), used, F.col("distractors")).items()))
    return scored.rollup("difficulty").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("succeeded"), F.count_if(F.col("ok") & F.col("perfect")).alias("perfect"),
        F.count_if(F.col("ok") & (F.col("distracted") == 0)).alias("undistracted"), F.sum("distracted").alias("distractors_cited"),
        F.round(F.try_divide(F.sum("correct"), F.sum("n_expected")), 6).alias("recall"), F.round(F.try_divide(F.sum("correct"), F.sum("n_used")), 6).alias("precision"),
    )


def cited_as(path: Column, expected: Column, distractors: Column) -> Column:
    """What a cited file is: expected, a distractor, or made up."""
    return F.when(F.array_contains(expected, path), "expected").when(F.array_contains(distractors, path), "distractor").otherwise("made up")


def report(scores: DataFrame, title: str) -> str:
    """A table in Markdown of the scores, a few rows."""
    columns, rows = scores.columns, scores.orderBy(*scores.columns).collect()
    cell = lambda v: "all" if v is None else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows), ""])


def seeded(key: Column, seed: int) -> Column:
    """What a seeded order sorts by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def shuffled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that the seed alone decides, the same wherever and however often it runs."""
    return rows.orderBy(seeded(F.col(key), seed), key).limit(n)
