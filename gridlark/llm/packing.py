"""Packing of token pieces into sequences by the linear grouping scheme.

Bin packing needs only how many pieces there are of each length, at most
``capacity`` numbers, so the plan is made on the driver, whatever the corpus:

1. Large pieces (over ``small`` tokens), in order of length, are cut into
   groups of equal cardinality; each counts as its group's longest.
2. For these few sizes, the fullest configuration that holds the longest
   piece left is found by dynamic programming and used as often as the numbers
   allow, until no large piece is left.
3. The actual pieces take their groups' places, which opens room.
4. Small pieces, longest first, go where least room is left; new sequences are
   opened only when none has room.

The plan is a list of segments: the r-th piece of a length, for r in a range,
goes to sequence s + r at one offset.  Its size depends on capacity and the
number of groups alone.

Scale: token counts need one narrow pass, kept as a table of about 40 bytes a
piece.  Ranks within a length come from row numbers within (length, salt), with
enough salts that no task sorts more than ``PER_SALT`` pieces of a length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.common import stored, tidy
from gridlark.llm.wordsplit import Cache, chunk_ids, default_path, empty_caches, joined_ids, slabs, splitter

CAPACITY = 2048
GROUPS = 1024
#: Pieces of more tokens are large.
SMALL = 256
#: A document's last id.
END = 0
PER_SALT = 500_000
_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class LibraryIds:
    """Ids by the tokenizers library, each distinct word encoded once."""

    def __init__(self, path: str):
        self.split = splitter(path)
        self.model = self.split.library.model
        self.chunks, self.words = Cache(), Cache()

    def _words(self, words: list[str]) -> list[bytes]:
        """By the library's model; its normaliser and splitter have nothing left to do for a word."""
        shown = [w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self.split.char_table) for w in words]
        ids = [[t.id for t in self.model.tokenize(w)] for w in shown]
        return [_PACK[len(x)](*x) if len(x) < len(_PACK) else struct.pack(f"<{len(x)}I", *x) for x in ids]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        return chunk_ids(self.split, chunks, lambda words: self.words.values(words, self._words))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return joined_ids(self.split, texts, self.chunks, self._chunks)


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


_PIECE = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def pieces(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) and, if asked for, ids (binary, little-endian unsigned 32-bit).

    A document is its ids and END, so a null or empty text has one piece of one
    token.  Only documents over capacity are cut.
    """
    path = path or default_path()
    rows = df.select(id, text)
    schema = T.StructType([rows.schema[id], *(T.StructField(n, t) for n, t in _PIECE), *([T.StructField("ids", T.BinaryType())] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for first, texts in slabs(batch.column(1)):
                of, out = [], []
                for k, body in enumerate(library_ids(path).encode(texts)):
                    body += end
                    for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[at : at + 4 * capacity]
                        of.append(first + k)
                        out.append((piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *made[: 5 if ids else 4]], schema.names)

    return rows.mapInArrow(tidy(run, empty_caches), schema)


def configuration(sizes: list[int], numbers: list[int], capacity: int) -> list[int]:
    """How many of each size (longest first) fill capacity best, with one of the first that is left at least."""
    lead = next(k for k, n in enumerate(numbers) if n)
    room = capacity - sizes[lead]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps: list[tuple[int, np.ndarray]] = []
    for k in range(lead, len(sizes)):
        size = sizes[k]
        for _ in range(min(numbers[k] - (k == lead), room // size)):
            more = reach.copy()
            more[size:] |= reach[:-size]
            new = more & ~reach
            if not new.any():
                break
            steps.append((k, new))
            reach = more
        if reach[room]:
            break
    used = [0] * len(sizes)
    used[lead] = 1
    left = int(np.flatnonzero(reach)[-1])
    for k, new in reversed(steps):  # a sum is new in the step that first reached it
        if new[left]:
            used[k] += 1
            left -= sizes[k]
    return used


class _Runs:
    """Sequences in ranges of equal content: by room left, a list of (first, number)."""

    def __init__(self, capacity: int):
        self.capacity, self.total = capacity, 0
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.rank = [0] * (capacity + 1)

    def open(self, n: int) -> tuple[int, int]:
        self.total += n
        return self.total - n, n

    def put(self, length: int, first: int, n: int, used: int) -> None:
        """The next n pieces of the length, one to each of n sequences from first on."""
        self.segments.append((length, self.rank[length], n, first, used))
        self.rank[length] += n

    def add(self, room: int, run: tuple[int, int]) -> None:
        self.by_room.setdefault(room, []).append(run)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """(segments, sequences) for counts[length] pieces; a segment is (length, first rank, number, first sequence, offset)."""
    runs = _Runs(capacity)
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"pieces have 1 to {capacity} tokens")
    large = [(n, left[n]) for n in sorted(left, reverse=True) if n > small]
    each = -(-sum(c for _, c in large) // groups) or 1
    members: dict[int, list[list[int]]] = {}  # rounded size -> actual [length, number], longest first
    room_in_group, size = 0, 0
    for n, c in large:
        while c:
            if not room_in_group:
                room_in_group, size = each, n
            take = min(c, room_in_group)
            members.setdefault(size, []).append([n, take])
            c -= take
            room_in_group -= take
    sizes = sorted(members, reverse=True)
    numbers = [sum(c for _, c in members[s]) for s in sizes]
    while any(numbers):
        used = configuration(sizes, numbers, capacity)
        times = min(n // u for n, u in zip(numbers, used, strict=True) if u)
        blocks = [(*runs.open(times), 0)]  # (first, number, tokens)
        for k, u in enumerate(used):
            numbers[k] -= u * times
            for _ in range(u):
                after = []
                for first, n, at in blocks:
                    while n:
                        head = members[sizes[k]][0]
                        take = min(n, head[1])
                        runs.put(head[0], first, take, at)
                        after.append((first, take, at + head[0]))
                        head[1] -= take
                        if not head[1]:
                            members[sizes[k]].pop(0)
                        first += take
                        n -= take
                blocks = after
        for first, n, at in blocks:
            runs.add(capacity - at, (first, n))
    for length in sorted((n for n in left if n <= small), reverse=True):
        n = left[length]
        while n:
            room = min((r for r, of in runs.by_room.items() if r >= length and of), default=None)
            if room is None:
                per = capacity // length
                run = runs.open(max(1, n // per))
                many = min(per, n)
                for k in range(many):
                    runs.put(length, *run, k * length)
                n -= many * run[1]
                runs.add(capacity - many * length, run)
                continue
            first, of = runs.by_room[room].pop()
            take = min(n, of)
            runs.put(length, first, take, capacity - room)
            n -= take
            runs.add(room - length, (first, take))
            if take < of:
                runs.add(room, (first + take, of - take))
    return np.array(sorted(runs.segments), np.int64).reshape(-1, 5), runs.total


def _place(segments: np.ndarray):
    """Sequence and offset of (length, rank), by binary search among the segments."""
    keys = segments[:, 0] << 48 | segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            sequence = pa.array(segments[at, 3] + rank - segments[at, 1])
            kept = [c for n, c in zip(names, batch.columns, strict=True) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, sequence, pa.array(segments[at, 4])], [*(n for n in names if n != "rank"), "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, by: list[str], length: str = "length", capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """parts with sequence_id and offset (long): gapless places in sequences of capacity tokens at most.

    by names the columns that tell rows apart; rows alike in them and in length
    may trade places.  parts is read more than once and must be the same each
    time: pass a stored table.  Columns of parts named like the two are
    replaced.  Without rows there are no sequences.
    """
    own = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    rows = parts.select(F.struct(*own).alias("row"), F.struct(*by).alias("by"), F.col(length).alias("length"))
    counts = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect()}
    segments, _ = plan(counts, capacity, groups, small)
    salts = np.ones(capacity + 1, np.int64)
    for n, c in counts.items():
        salts[n] = -(-c // PER_SALT)
    most = F.get(F.split(F.lit(",".join(map(str, salts))), ",").cast("array<long>"), F.col("length").cast("int"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("by"), most))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("by")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("before") + F.col("within")).alias("rank"))
    schema = T.StructType([ranked.schema["row"], ranked.schema["length"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(tidy(_place(segments)), schema).select("row.*", "sequence_id", "offset")


def pack_documents(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """pieces() of df with sequence_id and offset; other columns of df don't come along.

    Rows with equal or null ids are packed each; a null or empty text is one
    token; a very long one is encoded whole and cut.  An empty df gives an
    empty result.
    """
    return pack(stored(pieces(df, id, text, capacity, path)), [id, "piece"], capacity=capacity)
