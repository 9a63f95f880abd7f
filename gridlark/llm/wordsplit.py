"""Words of a tokenizer whose words never span white space, with per-process caches.

The tokenizer file fixes a normaliser (NFC, white space runs to one space,
lower case), a splitter and the added tokens that are cut out beforehand.
Nothing of that reaches over a space, so texts are cut at ASCII white space and
each distinct chunk is worked on once.  Chunks of well-known characters are
lower-cased and split here; any other chunk goes through the library's own
normaliser and splitter, so both ways agree.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

FILE = "word_bpe_49k.json"

#: Characters on which Python's lower() and this splitter agree with the library: ASCII, Latin letters, common punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
_PUNCTUATION = "¡-©«¬®-±´¶-¸»¿×÷‐-‧"
_KNOWN = re.compile(rf"[\t-\r\x20-\x7e{_LETTERS}{_PUNCTUATION}]*")
#: The splitter's pattern, for lower-case text of those characters; a line end, too, is a piece.
_SPLIT = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

#: Bytes that a generation of a worker's cache may hold.  It changes speed only.
CACHE = 32_000_000
#: Bytes of an entry besides its chunk, about.
_ENTRY = 200
#: Characters of text that are worked on at once.
SLAB = 4_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


class Splitter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        level = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(level)]
        self.char_of = {b: chr(b) for b in level} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.char_table = str.maketrans({chr(b): c for b, c in self.char_of.items()})
        self.byte_of = {c: b for b, c in self.char_of.items()}

    def segments(self, text: str) -> list[str | int]:
        """Texts between added tokens, each of which is its id (an int); lower-cased where that is safe."""
        if self._added.search(text) is None:
            return [lowered(text)]
        out: list[str | int] = []
        at = 0
        for m in self._added.finditer(text):
            out += [text[at : m.start()], self.added[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def _odd_words(self, chunk: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(chunk)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def words(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct words, places among them, each chunk's range of places); chunks hold no ASCII white space."""
        odd: list[int] = []
        text = "\n".join(chunks)
        if not _KNOWN.fullmatch(text):
            known = [_KNOWN.fullmatch(c) is not None for c in chunks]
            odd = [k for k, x in enumerate(known) if not x]
            text = "\n".join(c for c, x in zip(chunks, known, strict=True) if x)
        found = _SPLIT.findall(text.lower()) if len(odd) < len(chunks) else []
        sizes = np.zeros(len(chunks), np.int64)
        others = [self._odd_words(chunks[k]) for k in odd]
        flat = pa.array([*found, *(w for ws in others for w in ws)], pa.string()).dictionary_encode()
        code = flat.indices.to_numpy()
        names = flat.dictionary.to_pylist()
        lines = np.flatnonzero(code[: len(found)] == names.index("\n")) if len(chunks) - len(odd) > 1 else np.zeros(0, np.int64)
        plain = np.ones(len(chunks), bool)
        plain[odd] = False
        if len(odd) < len(chunks):
            sizes[plain] = np.diff(np.r_[-1, lines, len(found)]) - 1
        sizes[odd] = list(map(len, others))
        # In the chunks' order: those of well-known characters have their words first.
        begin = np.zeros(len(chunks), np.int64)
        begin[plain] = np.r_[0, lines + 1][: len(chunks) - len(odd)]
        begin[odd] = len(found) + np.cumsum(sizes[odd]) - sizes[odd]
        offsets = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])
        return names, code[at], offsets


def lowered(text: str) -> str:
    """text in lower case if that is the library's; it saves chunks that differ by case only."""
    return text.lower() if text.isascii() or _KNOWN.fullmatch(text) else text


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def slabs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about SLAB bytes; null is empty."""
    first, run, n = 0, [], 0
    for k, value in enumerate(texts):
        text = value.as_py() or ""
        run.append(text)
        n += len(text)
        if n >= SLAB:
            yield first, run
            first, run, n = k + 1, [], 0
    if run:
        yield first, run


class Cache:
    """Values of chunks, in two generations of bounded size; what is still in use moves to the newer one."""

    every: list[Cache] = []

    def __init__(self, size: int = CACHE):
        self.size = size
        self.empty()
        Cache.every.append(self)

    def empty(self) -> None:
        self.new, self.old, self.held = {}, {}, 0

    def values(self, chunks: list, make: Callable[[list], list]) -> list:
        """The value of each of the chunks, which differ; make(chunks) gives those that are not known yet."""
        if self.held > self.size:
            self.new, self.old, self.held = {}, self.new, 0
        found = list(map(self.new.get, chunks))
        here = [k for k, v in enumerate(found) if v is None]
        for k in here:
            found[k] = self.old.get(chunks[k])
        lacking = [k for k in here if found[k] is None]
        for k, v in zip(lacking, make([chunks[k] for k in lacking]) if lacking else (), strict=True):
            found[k] = v
        self.new.update((chunks[k], found[k]) for k in here)
        self.held += _ENTRY * len(here) + sum(len(chunks[k]) for k in here)
        return found


def empty_caches() -> None:
    """For the end of a partition."""
    for cache in Cache.every:
        cache.empty()


def coded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, places among them, each text's range of places): texts cut at ASCII white space by Arrow."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _gathered(values: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values' ids at the places code, one after the other; where each ends)."""
    ids = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    n = sizes[code]
    ends = np.cumsum(n)
    begins = (np.cumsum(sizes) - sizes)[code] - (ends - n)
    place = np.repeat(begins.astype(np.int32), n)  # a slab has far fewer ids than 2^31
    place += np.arange(len(place), dtype=np.int32)
    return ids[place], ends


def chunk_ids(split: Splitter, chunks: list[str], of_words: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Each chunk's ids; of_words gives those of distinct words."""
    names, code, offsets = split.words(chunks)
    used = np.unique(code)
    values = [b""] * len(names)
    for k, v in zip(used.tolist(), of_words([names[k] for k in used.tolist()]), strict=True):
        values[k] = v
    ids, ends = _gathered(values, code)
    data, at = ids.tobytes(), (4 * np.r_[0, ends][offsets]).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def joined_ids(split: Splitter, texts: list[str], cache: Cache, make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Each text's ids (little-endian, 4 bytes each); make gives the ids of new chunks.

    Only the distinct chunks of all texts meet Python; the ids are gathered by numpy.
    """
    parts = [split.segments(t) for t in texts]
    plain = [x for p in parts for x in p if isinstance(x, str)]
    if not plain:
        return []
    chunks, code, offsets = coded(plain)
    ids, ends = _gathered(cache.values(chunks, make), code)
    gathered = ids.tobytes()
    at = (4 * np.r_[0, ends][offsets]).tolist()
    out, k = [], 0
    for p in parts:
        found = []
        for x in p:
            if isinstance(x, int):
                found.append(x.to_bytes(4, "little"))
            else:
                found.append(gathered[at[k] : at[k + 1]])
                k += 1
        out.append(found[0] if len(found) == 1 else b"".join(found))
    return out
