"""Byte-level BPE over whole batches: pre-tokens found with numpy, each distinct one encoded once."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN

#: Character classes of the pre-token pattern.
LETTER, NUMBER, OTHER, SPACE, UNSURE = range(5)
#: White space that the pattern's \s takes, below LIMIT.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
#: Code points from here on leave their text to the library, whose Unicode tables may be of another version.
LIMIT = 0x0250
#: Distinct pre-tokens whose ids a worker keeps.
KEPT = 800_000


def _classes() -> np.ndarray:
    out = np.full(LIMIT + 1, OTHER, np.uint8)
    for c in range(LIMIT):
        kind = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c in WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[LIMIT] = UNSURE
    return out


CLASS = _classes()


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def starts_of(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. first: where a text starts.

    Runs of one class are pre-tokens; the last white-space character before another class stands alone, or
    belongs to what follows if it is a blank; an apostrophe that starts a match takes s t m d re ve ll with it.
    """
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    last = np.zeros(len(points), bool)
    last[:-1] = (kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~first[1:]
    start |= last
    start[1:] &= ~(last[:-1] & (points[:-1] == 0x20))
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        end = len(points)
        follow = np.append(np.flatnonzero(first), end)
        stop = follow[np.searchsorted(follow, quote, side="right")]
        at = lambda i: np.where(quote + i < stop, points[np.minimum(quote + i, end - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for chosen, n in ((short, 1), (long, 2)):
            start[quote[chosen] + 1] = False
            after = quote[chosen] + n + 1
            start[after[after < end]] = True
    return start


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file with the usual pre-token pattern.

    Distinct pre-tokens are encoded by rank, which is the same where the file lists its merges in the order of
    their ids (checked); texts with special tokens or rare characters go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: the merges are not in the order of their ids")
        self.ranked = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)

    def known(self, words: pa.StringArray) -> np.ndarray:
        """Places of the words in the store, encoding those that are new."""
        if len(self.words) > KEPT:
            self.forget()
        found = pc.index_in(words, value_set=self.words)
        place = found.fill_null(-1).to_numpy().copy()
        if found.null_count:
            where = np.flatnonzero(place < 0)
            new = words.filter(pc.is_null(found))
            white = pc.utf8_is_space(new)  # it would run into the line ends that part the words
            where = np.append(where[~white.to_numpy(zero_copy_only=False)], where[white.to_numpy(zero_copy_only=False)])
            plain, white = new.filter(pc.invert(white)), new.filter(white)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), "\n")[0].as_py()
            flat = self.ranked.encode_to_numpy(joined, disallowed_special=())
            ends = np.append(np.flatnonzero(flat == self.line), len(flat)) - np.arange(len(plain)) if len(plain) else np.zeros(0, np.int64)
            apart = [self.ranked.encode_ordinary(w) for w in white.to_pylist()]
            n = np.append(np.diff(ends, prepend=0), np.array([len(x) for x in apart], np.int64))
            flat = np.append(flat[flat != self.line], np.array([i for x in apart for i in x], np.uint32)).astype(np.uint32)
            place[where] = len(self.words) + np.arange(len(where))
            self.at = np.append(self.at, len(self.ids) + np.cumsum(n) - n)
            self.ids, self.n = np.append(self.ids, flat), np.append(self.n, n)
            self.words = pa.concat_arrays([self.words, plain, white])
        return place

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, hard = [], []
        for k, t in enumerate(texts):
            if t:
                (hard if any(s in t for s in self.special) else plain).append(k)
        if plain:
            points = np.frombuffer("".join([texts[k] for k in plain]).encode("utf-32-le"), np.uint32)
            sizes = np.fromiter((len(texts[k]) for k in plain), np.int64, len(plain))
            kinds = CLASS[np.minimum(points, LIMIT)]
            begin = np.cumsum(sizes) - sizes
            odd = np.maximum.reduceat(kinds, begin) == UNSURE
            if odd.any():
                hard += [k for k, x in zip(plain, odd) if x]
                keep = np.repeat(~odd, sizes)
                points, kinds, sizes, plain = points[keep], kinds[keep], sizes[~odd], [k for k, x in zip(plain, odd) if not x]
                begin = np.cumsum(sizes) - sizes
        if plain:
            first = np.zeros(len(points), bool)
            first[begin] = True
            start = starts_of(points, kinds, first)
            where = np.flatnonzero(start)
            wide = np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800).astype(np.int8), dtype=np.int32)
            offsets = np.zeros(len(where) + 1, np.int32)
            offsets[1:-1], offsets[-1] = wide[where[1:] - 1], wide[-1]
            words = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer("".join([texts[k] for k in plain]).encode())).dictionary_encode()
            place = self.known(words.dictionary)[words.indices.to_numpy()]
            n = self.n[place]
            ends = np.cumsum(n)
            flat = self.ids[np.repeat(self.at[place] - (ends - n), n) + np.arange(ends[-1])]
            per = np.add.reduceat(n, np.searchsorted(where, begin))
            for k, x in zip(plain, np.split(flat, np.cumsum(per)[:-1])):
                out[k] = x
        for k in hard:
            out[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return out
