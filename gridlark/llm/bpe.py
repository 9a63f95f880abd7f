"""BPE by batched numpy merge rounds.

The symbols of many distinct words stand in one flat array.  In each round the
neighbouring pairs are looked up by binary search among the sorted keys of all
merges, the lowest rank of each word is found, and all its places (leftmost
first where they overlap) are merged at once.  Words without a pair retire.
That gives the one-merge-at-a-time result if no two merges make the same
symbol, which the constructor checks.

Scale: narrow maps over partitions, no shuffle; a worker holds one slab of
text, its distinct words, and a cache of a fixed number of bytes; a text of any length
is one slab at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridlark.llm.common import tidy
from gridlark.llm.wordsplit import Cache, chunk_ids, default_path, empty_caches, joined_ids, slabs, splitter

_NONE = np.int64(1) << 40


class WordBpe:
    def __init__(self, path: str):
        self.split = splitter(path)
        model = self.split.spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.split.added.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("two merges make the same symbol")
        self.width = max(self.names) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.inner = np.array([vocab[self.split.char_of[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[self.split.char_of[b] + end] for b in range(256)], np.int64)
        self.cache = Cache()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, little-endian, 4 bytes each; words must not be empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        rank, made = self._look_up(ids, word, np.arange(len(ids)))
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            stay = lowest < _NONE
            if not stay.all():
                done_ids.append(ids[~stay])
                done_word.append(word[~stay])
            place = np.flatnonzero(stay & (rank == lowest))
            first = np.r_[True, np.diff(place) != 1]  # of a run of overlapping places, every second one
            run_start = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run_start) % 2 == 0]
            ids[place] = made[place]
            changed = np.zeros(len(ids), bool)
            changed[place] = changed[place - (place > 0)] = True
            stay[place + 1] = False
            ids, word, rank, made, changed = (x[stay] for x in (ids, word, rank, made, changed))
            at = np.flatnonzero(changed)
            rank[at], made[at] = self._look_up(ids, word, at)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        counts = np.bincount(word, minlength=len(words))
        flat, ends = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _look_up(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at the places at; _NONE where no merge fits."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * self.width + ids[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[found] == key) & (word[at] == word[after]) & (after > at)
        return np.where(fits, self.rank[found], _NONE), self.made[found]

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        return chunk_ids(self.split, chunks, lambda words: self.encode_words([w.encode() for w in words]) if words else [])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return joined_ids(self.split, texts, self.cache, self._chunk_ids)

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _schema(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in keep if c != name), T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns keep (all by default) and ids: binary, little-endian unsigned 32-bit token ids.

    A null or empty text has no ids; a very long one is read whole, in memory
    of some ten times its size.  Rows stay as they are, repeated ones too; a
    column of df named like ids is replaced.  An empty df gives an empty result.
    """
    path = path or default_path()
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slabs(batch.column(place)):
                part = batch.slice(first, len(texts))
                made = pa.array(bpe(path).encode(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), made], [*keep, ids])

    return df.mapInArrow(tidy(run, empty_caches), _schema(df, keep, ids, T.BinaryType()))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns keep (all by default) and text, decoded from ids; null ids are an empty text."""
    path = path or default_path()
    keep = [c for c in (df.columns if keep is None else keep) if c != text]
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                made = pa.array([bpe(path).decode(x.as_py() or b"") for x in part.column(place)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), made], [*keep, text])

    return df.mapInArrow(tidy(run), _schema(df, keep, text, T.StringType()))
