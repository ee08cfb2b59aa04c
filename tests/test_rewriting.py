"""Questions are searched for as a model rewrites them, in one call."""

import json

from pyspark.sql import functions as F

from gleaner.operators import ask, index


def test_a_question_is_searched_for_as_it_is_rewritten(spark):
    texts = ["the tower of the old castle", "a receipt for four lamps", "notes on the garden and its roses"]
    points = spark.createDataFrame([(k, f"/f{k}", None, t) for k, t in enumerate(texts)], "vec_id bigint, path string, chunk_index int, text string")
    points = points.withColumn("embedding", index.embedded(F.col("text")))
    asked = spark.createDataFrame([(1, "and how tall is it?", [("Which tower?", "That of the castle.")]), (2, "garden roses", []), (3, "garden roses", None)], "question_id bigint, question string, history array<struct<q:string,a:string>>")

    def rewriter(prompts):
        if any("garden" in p for p in prompts):
            return ["no json" if "garden" in p else json.dumps({"query": "castle tower", "keywords": ["old"]}) for p in prompts]
        return [json.dumps({"query": "castle tower", "keywords": ["old"]}) for _ in prompts]

    best = {r["question_id"]: r["path"] for r in ask.search_rewritten(points, asked, rewriter).where("rank = 1").collect()}
    assert best == {1: "/f0", 2: "/f2", 3: "/f2"}

    def broken(prompts):
        raise RuntimeError("no model")

    best = {r["question_id"]: r["path"] for r in ask.search_rewritten(points, asked, broken).where("rank = 1").collect()}
    assert best[2] == best[3] == "/f2"
