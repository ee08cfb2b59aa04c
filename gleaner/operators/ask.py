"""From questions to cited answers: search, contents of the files found, prompts, a model, and what of its replies holds."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import answering, hybrid, index
from gleaner.staging import written
from gleaner.workers import with_package

Agent = Callable[[list[str]], list[str]]

#: Fixed value: how often a provider is asked that says it is asked too much.
TRIES = 6


class Limited(Exception):
    """A provider is asked too much; ``seconds`` until it may be asked again, if it told them."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__(seconds)
        self.seconds = seconds


def patient(agent: Agent, other: Agent | None = None, tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> Agent:
    """An agent that waits where the provider is ``Limited``, as long as it says or twice as long each time, from two seconds.

    At any other failure, or once all tries are used, the other provider is asked once; without one, or if it fails too, the failure goes on.
    """

    def asked(prompts: list[str]) -> list[str]:
        pause = 2.0
        for left in reversed(range(tries)):
            try:
                return agent(prompts)
            except Limited as e:
                if left:
                    wait(pause if e.seconds is None else e.seconds)
                    pause *= 2
                    continue
                failure: Exception = e
            except Exception as e:  # noqa: BLE001  whatever it is, the other provider may do
                failure = e
            break
        if other is None:
            raise failure
        try:
            return other(prompts)
        except Exception as e:
            raise e from failure

    return asked


def replies(prompts: DataFrame, agent: Agent) -> DataFrame:
    """The prompts with a reply each; a model that fails on a batch gives no reply there."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield pd.Series(agent(batch.tolist()), dtype=object)
            except Exception:  # noqa: BLE001  a model that is given may fail in any way; the reply is missing then
                yield pd.Series([None] * len(batch), dtype=object)

    return with_package(prompts).withColumn("reply", run("prompt"))


def search_rewritten(points: DataFrame, questions: DataFrame, rewriter: Agent, embedder: index.Embedder = index.hashed, **search) -> DataFrame:
    """The hits of ``hybrid.run_search`` for questions (question_id, question, history) as a model rewrites them.

    rewriter: from prompts to JSON texts with query and keywords; where it fails, or gives none, the question stands for itself.
    """
    told = replies(questions.withColumn("prompt", hybrid.rewrite_prompt(F.col("question"), F.col("history"))), rewriter)
    told = told.withColumn("_r", F.from_json("reply", "query string, keywords array<string>"))
    asked = told.withColumn("search", hybrid.rewritten(F.col("question"), F.col("_r.query"), F.col("_r.keywords"))).select("question_id", "question", "search")
    asked = written(asked, "rewritten")  # a model is asked once
    return hybrid.run_search(points, asked.withColumn("embedding", index.embedded(F.col("search"), embedder)), **search)


def ask(points: DataFrame, questions: DataFrame, table_rows: DataFrame, contents: DataFrame, manifest: DataFrame, agent: Agent, fallback: str = "The answer could not be read.", **search) -> DataFrame:
    """question_id, answer, sources and dropped (cited files that the question was not given) of each question."""
    hits = hybrid.run_search(points, questions, **search)
    wanted = hybrid.rows_of_hits(hits)
    blocks = answering.file_blocks(wanted, table_rows, contents, manifest, questions)
    said = replies(answering.prompts(blocks, questions), agent).select("question_id", answering.repaired_answer(F.col("reply"), fallback).alias("a"))
    answers = said.select("question_id", F.col("a.answer").alias("answer"), F.col("a.sources_used").alias("sources_used"), F.lit(False).alias("not_found"))
    answers = written(answers, "answers")  # a model is asked once, and what was said is what is checked
    kept = answering.kept_sources(answers, wanted.select("question_id", "path"))
    return answers.select("question_id", "answer").join(kept, "question_id")
