"""Saves that are whole or not at all, and providers that ask for patience."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ask
from gleaner.sources import sinks


def test_json_is_saved_whole_and_sorted(spark, tmp_path):
    path = tmp_path / "manifest"
    save = lambda rows: sinks.save_json(spark.createDataFrame(rows, "path string, kind string"), "path", str(path))
    lines = lambda: [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]
    save([("b", "x"), ("a", None), ("c", "y")])
    first = ['{"kind":null,"path":"a"}', '{"kind":"x","path":"b"}', '{"kind":"y","path":"c"}']
    assert lines() == first
    broken = spark.createDataFrame([("z", "k")], "path string, kind string").withColumn("kind", F.raise_error(F.lit("cut off")).cast("string"))
    with pytest.raises(Exception, match="cut off"):
        sinks.save_json(broken, "path", str(path))
    assert lines() == first
    path.rename(tmp_path / "manifest.old")  # died between the renames, and then before its own lines were written
    with pytest.raises(Exception, match="cut off"):
        sinks.save_json(broken, "path", str(path))
    assert lines() == first
    save([("d", "w")])
    assert lines() == ['{"kind":"w","path":"d"}'] and not (tmp_path / "manifest.old").exists() and not (tmp_path / "manifest.new").exists()


def provider(*says):
    """What a provider does at each call: an exception, or replies."""
    left = list(says)

    def agent(prompts):
        one = left.pop(0)
        if isinstance(one, Exception):
            raise one
        return [one] * len(prompts)

    return agent


def test_a_limited_provider_is_waited_for_and_then_another_is_asked(spark):
    waits = []
    go = lambda agent, other=None: ask.patient(agent, other, wait=waits.append)(["q"])
    assert go(provider(ask.Limited(), ask.Limited(7), ask.Limited(), "fine")) == ["fine"] and waits == [2, 7, 8]
    waits.clear()
    assert go(provider(*[ask.Limited()] * 6), provider("other")) == ["other"] and waits == [2, 4, 8, 16, 32]
    waits.clear()
    assert go(provider(ValueError("no")), provider("other")) == ["other"] and waits == []
    with pytest.raises(ask.Limited):
        go(provider(*[ask.Limited(0)] * 6))
    with pytest.raises(KeyError) as e:
        go(provider(ValueError("no")), provider(KeyError("neither")))
    assert isinstance(e.value.__cause__, ValueError)
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    agent = ask.patient(provider(ask.Limited(0), "said"), provider("other"))
    assert {r["reply"] for r in ask.replies(prompts, agent).collect()} == {"said"}
