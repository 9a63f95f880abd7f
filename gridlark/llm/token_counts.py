"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over symbols (a byte, or a byte that ends its word).
Each node has a failure link and the number of tokens popped when it is
followed, both worked out beforehand, so a word is read symbol by symbol with
no step back and no piece is ever built.  Many words advance together: one
numpy step handles the next symbol of each, transitions being found by binary
search over sorted (node, symbol) keys.

Scale: narrow maps, no shuffle; each distinct word of a slab is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridlark.llm.common import tidy
from gridlark.llm.wordsplit import Cache, coded, default_path, empty_caches, lowered, slabs, splitter

_SYMBOLS = 512


class Automaton:
    """tokens: sequences of symbols 0 to 511, each with at least one symbol."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        child: list[dict[int, int]] = [{}]
        ends = [False]
        for token in tokens:
            v = 0
            for c in token:
                if c not in child[v]:
                    child[v][c] = len(child)
                    child.append({})
                    ends.append(False)
                v = child[v][c]
            ends[v] = True
        link, popped = [-1] * len(child), [0] * len(child)
        queue = [0]
        for u in queue:
            for c, v in child[u].items():
                queue.append(v)
                if ends[v]:
                    link[v], popped[v] = 0, 1
                    continue
                z, n = link[u], popped[u]
                while z >= 0 and c not in child[z]:
                    n += popped[z]
                    z = link[z]
                if z >= 0:
                    link[v], popped[v] = child[z][c], n
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)
        edges = sorted((u * _SYMBOLS + c, v) for u, of in enumerate(child) for c, v in of.items())
        self.keys, self.targets = np.array([k for k, _ in edges], np.int64), np.array([v for _, v in edges], np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty word, its last byte taken as a word end; 1 for a word that can't be matched."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = (np.cumsum(lengths) - lengths)[order]
        flat[np.cumsum(lengths) - 1] += 256
        left = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="right")
        node, n, lost = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        for k, live in enumerate(left):
            todo = np.flatnonzero(~lost[:live])
            symbol = flat[begin[:live] + k]
            while len(todo):
                key = node[todo] * _SYMBOLS + symbol[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                node[todo[hit]] = self.targets[at[hit]]
                todo = todo[~hit]
                self._fail(todo, node, n, lost)
                todo = todo[~lost[todo]]
        todo = np.flatnonzero((node > 0) & ~lost)
        while len(todo):
            self._fail(todo, node, n, lost)
            todo = todo[(node[todo] > 0) & ~lost[todo]]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(lost, 1, n)
        return out

    def _fail(self, at: np.ndarray, node: np.ndarray, n: np.ndarray, lost: np.ndarray) -> None:
        n[at] += self.popped[node[at]]
        node[at] = self.link[node[at]]
        lost[at[node[at] < 0]] = True


def summed(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each range of rows: the sums of the first two columns, the greatest of the third."""
    sums = np.zeros((len(rows) + 1, 2), np.int64)
    np.cumsum(rows[:, :2], axis=0, out=sums[1:])
    out = np.zeros((len(offsets) - 1, 3), np.int64)
    out[:, :2] = sums[offsets[1:]] - sums[offsets[:-1]]
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):  # ranges without rows take no place, so the others' are gapless
        out[some, 2] = np.maximum.reduceat(rows[:, 2], offsets[some])
    return out


class WordCounter:
    def __init__(self, path: str):
        self.split = splitter(path)
        model = self.split.spec["model"]
        end = model["end_of_word_suffix"] or ""

        def symbols(token: str) -> tuple[int, ...]:
            body = token.removesuffix(end) if end else token
            ids = [self.split.byte_of[c] for c in body]
            return (*ids[:-1], ids[-1] + 256) if body != token else tuple(ids)

        self.automaton = Automaton([symbols(t) for t in model["vocab"] if t != end])
        self.cache = Cache()

    def _of(self, chunks: list[str]) -> list[tuple[int, int, int]]:
        """Words, tokens, and the most tokens of a word, for each chunk."""
        names, code, offsets = self.split.words(chunks)
        used = np.unique(code)
        tokens = np.zeros(len(names), np.int64)
        if len(used):
            tokens[used] = self.automaton.counts([names[k].encode() for k in used.tolist()])
        return list(map(tuple, summed(np.c_[np.ones(len(code), np.int64), tokens[code], tokens[code]], offsets).tolist()))

    def of(self, texts: list[str]) -> np.ndarray:
        """Words, tokens, and the most tokens of a word, for each text."""
        chunks, code, offsets = coded(list(map(lowered, texts)))
        return summed(np.array(self.cache.values(chunks, self._of), np.int64).reshape(-1, 3)[code], offsets)


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns keep (all by default) and n_words, n_tokens, max_word_tokens (long).

    Words are the tokenizer's; strings of its special tokens are ordinary text.
    A null or empty text has 0 of each; a very long one, or a very long word,
    is read whole.  Rows stay as they are, repeated ones too; columns of df with
    these names are replaced.  An empty df gives an empty result.
    """
    path = path or default_path()
    own = ["n_words", "n_tokens", "max_word_tokens"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in own]
    place = df.columns.index(text)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slabs(batch.column(place)):
                part = batch.slice(first, len(texts))
                made = [pa.array(x) for x in counter(path).of(texts).T]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], [*keep, *own])

    return df.mapInArrow(tidy(run, empty_caches), schema)
