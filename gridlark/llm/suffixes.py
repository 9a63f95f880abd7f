"""Exact substring dedup: a depth-limited radix sort of suffixes.

Wanted are all windows of ``length`` bytes that start at two places or more.
Suffixes are ordered only through their first ``length`` bytes, digit after
digit from the most significant one; a suffix alone in its class drops out at
once, and the classes left after the last digit are exactly the repeated
windows.

Sending every suffix through a shuffle would move many times the corpus, so
the cluster's digits are chosen by content.  Each window has an anchor, the
smallest hash among its ``GRAM``-byte grams, which depends on the window alone;
neighbouring windows mostly share it.  A run is a maximal range of neighbouring
windows with one anchor: about one for each 76 bytes.

1. First digit, the anchor's gram: runs whose gram occurs once drop out.
2. Second digit, the run's whole bytes: runs found twice or more are repeated
   altogether, with all their windows.
3. Grams with several different runs (the edges of repeated passages) get the
   bytes of one run of each kind.  Within a gram, windows are sorted by their
   place relative to the anchor and then by eight bytes a pass.
4. A gram with very many different runs is not gathered: its windows are
   re-keyed by a 128-bit hash of all their bytes, repeats within a batch being
   settled before the shuffle.

Equal windows always have equal anchors, so nothing is lost; runs are told
apart by two independent 64-bit hashes, windows of step 3 by their bytes.

All of this is about distinct texts, told apart by two 64-bit hashes.  A text
on two rows or more is repeated altogether, which a count of hashes tells; a
task reads it once, however often it meets it.

Scale: every step's groups are bounded or pre-aggregated; what is shuffled is
about 0.7 of the text's bytes as hashes, and the text itself twice.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.common import stored, tidy

LENGTH = 200
GRAM = 50
#: Different runs of a gram that a task may gather.
GATHER = 2000
#: Tasks that one gram's runs are dealt to.
SALTS = 8
#: Windows that are looked at in one numpy step, and documents that a task turns into Python objects at a time.
SLAB = 1 << 17
ROWS = 500
#: Texts that a task remembers, so as not to read copies again; it changes speed only, about 100 bytes each.
SEEN = 100_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a slab's places; grams are ordered by the rest of their hash, the same rest in every slab.
_PLACE = 24
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_RUN = ["gram", "run", "place"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _MULTIPLIER)
    down = np.full(n, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    """Runs of windows with one anchor, for windows of length bytes and grams of gram bytes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, slab: int = SLAB):
        if not 0 < gram <= length <= gram + 250:
            raise ValueError("a run's width must fit in 8 bits")
        if slab + length >= 1 << _PLACE:
            raise ValueError("a slab's places must fit beside the hash")
        self.length, self.gram, self.slab = length, gram, slab
        self.up, self.down = _powers(2 * slab + length + 1)

    def runs(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first window, windows, anchor's place in the run, gram hash) of documents data[begin:end]."""
        parts = []
        row = 0
        while row < len(begin):
            if end[row] - begin[row] > self.slab:  # in segments, cut at fixed places of the document
                for at in range(0, int(end[row] - begin[row]) - self.length + 1, self.slab):
                    stop = min(int(end[row] - begin[row]), at + self.slab + self.length - 1)
                    lo, *rest = self._slab(data[begin[row] + at : begin[row] + stop], np.array([0]), np.array([stop - at]))
                    parts.append((np.full(len(lo), row), lo + at, *rest[1:]))
                row += 1
                continue
            last = int(np.searchsorted(end, begin[row] + self.slab, side="right"))
            last = max(last, row + 1)
            base = begin[row]
            lo, of, *rest = self._slab(data[base : end[last - 1]], begin[row:last] - base, end[row:last] - base)
            parts.append((of + row, lo - (begin[row:last] - base)[of], *rest))
            row = last
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)

    def _slab(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(data)
        if n < self.length:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty, empty, np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.down[:n], out=sums[1:])
        gram = (sums[self.gram :] - sums[: n + 1 - self.gram]) * self.up[: n + 1 - self.gram]
        gram ^= gram >> np.uint64(32)
        gram *= _MIX
        gram ^= gram >> np.uint64(29)
        low = np.uint64((1 << _PLACE) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)  # by hash, then leftmost
        width, have = self.length - self.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least & low).astype(np.int64)
        inside = np.zeros(len(anchor) + 1, np.int32)
        long_ = end - begin >= self.length
        np.add.at(inside, begin[long_], 1)
        np.add.at(inside, end[long_] - self.length + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        # Documents stand side by side, so a window over a border is never inside; a change of anchor or a border starts a run.
        change = np.r_[True, anchor[1:] != anchor[:-1]]
        first = np.flatnonzero(inside & (change | np.r_[True, ~inside[:-1]]))
        last = np.flatnonzero(inside & np.r_[change[1:] | ~inside[1:], True])
        of = np.searchsorted(begin, first, side="right") - 1
        return first, of, last - first + 1, anchor[first] - first, gram[anchor[first]]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, begin, end) of a string or binary column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _pack(first: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 16 | windows << 8 | anchor


def _text(rows: DataFrame) -> list[T.StructField]:
    """What a text is known by: its row's id, and a hash, as ids may repeat or be null."""
    return [rows.schema["id"], rows.schema["a"]]


def _key(df: DataFrame, id: str, text: str, keep: list[str]) -> DataFrame:
    """id, a, b (the text's hashes), text (never null), kept."""
    kept = F.struct(*keep) if keep else F.lit(None).cast("boolean")
    rows = df.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), kept.alias("kept"))
    return rows.select("id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), "text").alias("b"), "text", "kept")


def _joined(rows: DataFrame, other: DataFrame, column: str, how: str) -> DataFrame:
    """rows with column of other (id, a, column), whose pairs (id, a) are unique; a null id equals a null id.

    All columns of rows are read by whoever asks, so that one shuffle of the texts serves every join.
    """
    other = other.withColumnsRenamed({"id": "_id", "a": "_a"})
    return rows.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("a") == F.col("_a")), how).select(*rows.columns, column)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (id, a, b, ...) without most rows whose text the task met before; SEEN texts are remembered at a time."""
    seen: set[int] = set()
    for batch in batches:
        stay = []
        for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if (pair := a << 64 | b & (1 << 64) - 1) not in seen:
                seen.add(pair)
                stay.append(k)
        if len(seen) > SEEN:
            seen.clear()
        if stay:
            yield batch if len(stay) == batch.num_rows else batch.take(pa.array(stay))


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, run, place, id, a) of every run; a task gives those of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in _firsts(batches):
            data, begin, end = _bytes_of(batch.column(3))
            view = memoryview(np.ascontiguousarray(data))
            row, first, windows, anchor, grams = anchors.runs(data, begin, end)
            at = begin[row] + first
            digest = xxhash.xxh3_64_intdigest
            ids = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (at + windows + length - 1).tolist(), strict=True)), np.uint64, len(at))
            take = pa.array(row)
            columns = [pa.array(grams.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(_pack(first, windows, anchor))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(take), batch.column(1).take(take)], [*_RUN, "id", "a"])

    long_ = rows.select("id", "a", "b", "text").where(F.octet_length("text") >= length)
    return long_.mapInArrow(tidy(run), T.StructType([*(T.StructField(n, T.LongType()) for n in _RUN), *_text(rows)]))


_SENT = [
    ("key1", T.LongType()),
    ("key2", T.LongType()),
    #: 0: bytes of a run; 1: one window of a crowded gram; 2: a settled window.
    ("kind", T.IntegerType()),
    ("first", T.LongType()),
    ("windows", T.LongType()),
    ("anchor", T.LongType()),
    ("bytes", T.BinaryType()),
]
_PART = [T.StructField(n, T.LongType()) for n in ("start", "end")]


def _sent(lists: DataFrame, length: int) -> DataFrame:
    """Rows of _SENT with id and a, from (id, a, b, text, kept, runs)."""
    names = [n for n, _ in _SENT]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(_firsts(batches)):
            rows: list[tuple] = []
            of: list[int] = []
            crowded: dict[int, list[tuple[int, int]]] = {}
            for k in range(batch.num_rows):
                text = batch.column(3)[k].as_py().encode()
                for r in batch.column(5)[k].as_py():
                    first, windows, anchor = r["place"] >> 16, r["place"] >> 8 & 255, r["place"] & 255
                    if not r["crowded"]:
                        rows.append((r["gram"], 0, 0, first, windows, anchor, text[first : first + windows + length - 1]))
                        of.append(k)
                        continue
                    for p in range(first, first + windows):
                        crowded.setdefault(xxhash.xxh3_128_intdigest(text[p : p + length]), []).append((k, p))
            for h, at in crowded.items():
                for k, p in at if len(at) > 1 else ():  # settled; a key of its own for each row
                    rows.append((signed(xxhash.xxh3_64_intdigest(struct.pack("<qqq", batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), p))), 0, 2, p, 1, 0, None))
                    of.append(k)
                rows.append((signed(h >> 64), signed(h & (1 << 64) - 1), 1, at[0][1], 1, 0, None))  # windows in other batches may equal it
                of.append(at[0][0])
            made = [pa.array(x, pa.binary() if n == "bytes" else pa.int32() if n == "kind" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)] if rows else None
            if made:
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([*made, batch.column(0).take(take), batch.column(1).take(take)], [*names, "id", "a"])

    return lists.mapInArrow(tidy(run), T.StructType([*(T.StructField(n, t) for n, t in _SENT), *_text(lists)]))


def repeated_windows(group: np.ndarray, pieces: list[bytes], windows: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window in it) of the windows that occur twice or more among the pieces of a group.

    Most significant digits first: place relative to the anchor, then eight
    bytes a pass; windows alone in their class leave after each pass.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    padded = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    eights = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), strides=(1,))
    begin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), windows)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    classes = group[piece] * 256 + (anchor[piece] - inner)
    live = np.arange(len(piece))
    for depth in range(-8, length, 8):
        if depth < 0:
            digit = np.zeros(len(live), np.uint64)
        else:
            digit = eights[begin[piece[live]] + inner[live] + depth].astype(np.uint64)
            if length - depth < 8:
                digit >>= np.uint64(8 * (8 - (length - depth)))
        order = np.lexsort((digit, classes))
        live, classes, digit = live[order], classes[order], digit[order]
        if not len(live):
            break
        new = np.r_[True, (classes[1:] != classes[:-1]) | (digit[1:] != digit[:-1])]
        name = np.cumsum(new) - 1
        stay = np.bincount(name)[name] > 1
        live, classes = live[stay], name[stay]
    live.sort()
    return piece[live], inner[live]


#: Windows that are sorted together.
_SORTED = 1 << 18


def _sort(length: int):
    """Reads rows of _SENT sorted by key1, key2, kind; gives the repeated ranges."""

    def gathered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end) of kind 0."""
        names = batch.schema.names
        column = lambda n: batch.column(names.index(n)).to_numpy(zero_copy_only=False)
        key, first, windows, anchor = (column(n) for n in ("key1", "first", "windows", "anchor"))
        pieces = batch.column(names.index("bytes")).to_pylist()
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        # Groups are whole in the batch; they are sorted together up to _SORTED windows.
        upto = np.cumsum(windows) // _SORTED
        slab = upto[np.flatnonzero(new)][group]
        out = []
        for s in np.unique(slab):
            at = np.flatnonzero(slab == s)
            piece, inner = repeated_windows(group[at] - group[at[0]], [pieces[k] for k in at], windows[at], anchor[at], length)
            if len(piece):
                begins = np.r_[True, (piece[1:] != piece[:-1]) | (inner[1:] != inner[:-1] + 1)]
                ends = np.r_[begins[1:], True]
                rows = at[piece[begins]]
                out.append((rows, first[rows] + inner[begins], first[rows] + inner[ends] + length))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            names = batch.schema.names
            take = pa.array(row)
            own = [batch.column(names.index(n)).take(take) for n in ("id", "a")]
            return pa.RecordBatch.from_arrays([*own, pa.array(start), pa.array(end)], ["id", "a", "start", "end"])

        held: pa.Table | None = None  # the last key's rows, as the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            key1, key2 = (now.column(c).to_numpy() for c in ("key1", "key2"))
            other = np.flatnonzero((key1 != key1[-1]) | (key2 != key2[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut == 0 and now.num_rows > 4 * GATHER and now.column("kind")[0].as_py() == 1:
                # One window over and over: two rows tell as much as all, once those between are given out.
                yield from parts(now.slice(0, now.num_rows - 2), out)
                held = now.slice(now.num_rows - 2)
                continue
            held = now.slice(cut)
            if cut:
                yield from parts(now.slice(0, cut), out)
        if held is not None:
            yield from parts(held, out)

    def parts(rows: pa.Table, out) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        kind, key1, key2, first = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("kind", "key1", "key2", "first"))
        pick = np.flatnonzero(kind == 0)
        if len(pick):
            row, start, end = gathered(batch.take(pa.array(pick)))
            yield out(batch, pick[row], start, end)
        same = np.zeros(len(kind), bool)
        alike = (kind[1:] == 1) & (kind[:-1] == 1) & (key1[1:] == key1[:-1]) & (key2[1:] == key2[:-1])
        same[1:] |= alike
        same[:-1] |= alike
        row = np.flatnonzero(same | (kind == 2))
        if len(row):
            yield out(batch, row, first[row], first[row] + length)

    return run


def _spread_join(runs: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """runs whose keys are in sums.

    A hot key is dealt to SALTS tasks, each of which gets its row of sums; as
    sums are shuffled anew for that, Spark can split what is still uneven.
    """
    salted = runs.withColumn("_salt", F.pmod(F.xxhash64("a", "place"), F.lit(SALTS)).cast("int"))
    every = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, [*keys, "_salt"]).drop("_salt")


def repeated_ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, gather: int = GATHER) -> DataFrame:
    """(id, a, start, end): byte ranges, overlaps and repeats allowed, whose union is what repeated windows cover.

    rows: as _key gives them.
    """
    light = rows.select("id", "a", "b", F.octet_length("text").cast("long").alias("end")).where(F.col("end") >= length)
    copied = light.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    copied = light.join(copied, ["a", "b"]).select("id", "a", F.lit(0).cast("long").alias("start"), "end").distinct()
    runs = _runs(rows, length, gram)
    grams = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    shared = stored(_spread_join(runs, grams, ["gram"]))
    # A text's place can be there from each task that met the text, so places are counted by what they are.
    one = F.struct("id", "a", "place")
    kinds = shared.groupBy("gram", "run").agg(F.min(one).alias("one"), (~F.min(one).eqNullSafe(F.max(one))).alias("twice"))
    whole = _spread_join(shared, kinds.where("twice").select("gram", "run"), ["gram", "run"])
    first = F.shiftright("place", 16)
    ranges = whole.select("id", "a", first.alias("start"), (first + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + (length - 1)).alias("end"))
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    edges = kinds.join(several, "gram").select("one.id", "one.a", F.struct("gram", "one.place", (F.col("kinds") > gather).alias("crowded")).alias("r"))
    lists = edges.groupBy("id", "a").agg(F.collect_list("r").alias("runs"))
    sent = _sent(_joined(rows, lists, "runs", "inner"), length)
    dealt = sent.repartition("key1", "key2").sortWithinPartitions("key1", "key2", "kind")
    more = dealt.mapInArrow(tidy(_sort(length)), T.StructType([*_text(rows), *_PART]))
    return ranges.unionByName(more).unionByName(copied)


def _remove(text: bytes, ranges: list) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed ranges)."""
    kept, at, spans, removed = [], 0, 0, 0
    for start, end in sorted(ranges):
        if end <= at:
            continue
        if start > at or not spans:
            kept.append(text[at:start])
            spans += 1
            removed += end - start
        else:
            removed += end - at
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, spans


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, gather: int = GATHER, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, remaining) and the columns keep, one row for each row of df.

    remaining is the UTF-8 text without each byte that a repeated window of
    length bytes covers: binary, or as_text a string, without the bytes of
    characters that the border of a removed range cuts.  Null and empty texts, and any shorter than
    length, lose nothing; very long ones are read in segments.  Rows with equal
    or null ids are each kept and judged by their texts; a row that is there
    twice is a repeated text.  Columns named like those above are not kept.
    An empty df gives an empty result.
    """
    keep = [c for c in keep or [] if c not in (id, "n_bytes", "n_removed", "n_spans", "remaining")]
    rows = _key(df, id, text, keep)
    ranges = repeated_ranges(rows, length, gram, gather).groupBy("id", "a").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    numbers = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    out = T.StructType([rows.schema["id"], rows.schema["kept"], *numbers, T.StructField("remaining", T.StringType() if as_text else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            made = []
            for t, found in zip(batch.column(3), batch.column(5), strict=True):
                body = t.as_py().encode()
                made.append((len(body), *_remove(body, [(r["start"], r["end"]) for r in found.as_py() or ()])))
            n, left, removed, spans = zip(*made, strict=True) if made else ((), (), (), ())
            rest = pa.array([x.decode(errors="ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())
            columns = [*(pa.array(x, pa.int64()) for x in (n, removed, spans)), rest]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *columns], out.names)

    found = _joined(rows, ranges, "ranges", "left").mapInArrow(tidy(run), out)
    extra = ["kept.*"] if keep else []
    return found.select(F.col("id").alias(id), "n_bytes", "n_removed", "n_spans", "remaining", *extra)
