"""Byte-level BPE as a monoid: encodings of adjacent stretches combine, so a text is reduced as a tree.

Halves are encoded recursively. To join neighbours, a window around the seam is encoded anew. It grows, doubling,
until both its ends are places where every scan of the pattern has a boundary, whatever lies around: after a
letter that no letter follows, after a digit that no digit follows, or between another character (not an
apostrophe, which may take letters with it) and a character of another class. Matches depend on nothing before
their start, and those on either side of such places neither reach over nor look beyond them to any effect, so
the tokens outside the window are those of the whole text. Decoding concatenates up the same kind of tree.

Leaves and windows are encoded by the library for such vocabularies, each as a text of its own.

Cases: a null text counts as empty (no ids); a text without any safe place is one window, encoded whole, however long;
repeated rows are encoded each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import text_chunks, with_package

#: Characters, or ids, that a leaf of the tree holds.
LEAF = 256
#: Characters on either side of a seam that the first window holds.
WINDOW = 16
SAFE = regex.compile(r"(?<=\p{L})(?!\p{L}).|(?<=\p{N})(?!\p{N}).|(?<=[^\s\p{L}\p{N}'])[\s\p{L}\p{N}]|(?<=')[\s\p{N}]", regex.S)


class Codec:
    """ranks: bytes of each token and its rank; pattern: what parts a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self.leaf.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        n, begin, end = WINDOW, None, None
        while begin is None or end is None:
            if begin is None:
                if mid - n <= lo:
                    begin = lo
                elif found := SAFE.search(text, mid - n, mid):
                    begin = found.start()
            if end is None:
                if mid + n >= hi:
                    end = hi
                elif found := SAFE.search(text, mid + 1, mid + n):
                    end = found.start()
            n *= 2
        plain = self.leaf.encode_ordinary
        keep = len(left) - len(plain(text[begin:mid]))
        drop = len(plain(text[mid:end]))
        left[keep:] = plain(text[begin:end])
        left += right[drop:] if drop else right
        return left

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return self.leaf.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each rank file and worker."""
    if (ranks_path, pattern) not in _codecs:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[ranks_path, pattern] = Codec(ranks, pattern)
    return _codecs[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids array<int> of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text):
            ids = [codec(ranks_path, pattern).encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return with_package(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key and the bytes of each row's ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [codec(ranks_path, pattern).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], names=[key, "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    return with_package(encoded.select(key, "ids")).mapInArrow(run, f"`{key}` {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        names = [str(i) for i in range(c.leaf.n_vocab)]
        for batch in text_chunks(batches, "text"):
            counts, digests, decoded = [], [], []
            for t in batch.column("text"):
                ids = c.encode(t.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return with_package(rows).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
