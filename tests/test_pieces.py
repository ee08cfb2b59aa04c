"""Workers take batches apart in pieces that do not grow with the table, whole rows each."""

import pyarrow as pa

from gleaner import workers


def test_pieces_of_texts_and_tokens_are_bounded_and_whole():
    texts = ["a" * 300_000, None, "b" * 700_000, "c" * 2_500_000, "", "d" * 10, "e" * 999_995]
    got = list(workers.pieces([pa.RecordBatch.from_pydict({"n": range(7), "t": texts})], "t"))
    assert [p.column("n").to_pylist() for p in got] == [[0, 1, 2], [3], [4, 5], [6]]
    tokens = [["x"] * 100_000, None, ["y"] * 31_072, ["z"], []]
    got = list(workers.pieces([pa.RecordBatch.from_pydict({"n": range(5), "t": pa.array(tokens, pa.list_(pa.string()))})], 1))
    assert [p.column("n").to_pylist() for p in got] == [[0, 1, 2], [3, 4]]
    assert list(workers.pieces([pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})], "t")) == []
