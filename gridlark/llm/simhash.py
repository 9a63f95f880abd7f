"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits; two of them link if they differ in 3 at most.  Then
one of its two 32-bit halves differs in 1 at most.  The anchors of a half are
the words of the Hamming code on 31 of its bits: every word is within covering
radius 1 of exactly one anchor, its home.  If two halves differ in 1 bit, the
home of one is within radius + 1 = 2 of the other.  So each fingerprint goes to
its two homes and, as a guest, to every anchor within 2 (16 a half at most),
and guests are compared with residents, anchor by anchor.  No link is lost.

Scale: equal fingerprints are one row before anything is replicated, with 34
rows of 25 bytes each at most.  Anchors are counted with partial sums first;
where many fingerprints meet, residents and guests are dealt out in chunks and
each pair of chunks is a task's work of its own, so no task sees more than a
fixed number of fingerprints of an anchor at a time.  A task gives back a
spanning forest of the links it finds, never all pairs of a group.  Components
are found by star steps on fingerprints.  Spark guesses the size of rows and of
their anchors from that of compressed texts, which can be far less: all of them
are joined by a merge, lest it sends them to the driver for broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.common import cut, tidy
from gridlark.llm.components import components

DISTANCE = 3
SEED = 42
#: Fingerprints of an anchor that are compared at once; anchors with more are split into chunks of about this many.
CHUNK = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    """What stands between white space, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_LOWER).split()


def shingles(text: str, size: int = 3) -> list[bytes]:
    """size-word shingles of the text, A-Z lower-cased; the whole sequence if it is shorter; none without words."""
    words = words_of(text)
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit k is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text or "", size)), np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = 3) -> DataFrame:
    """The columns keep (all by default) and fingerprint: 64 bits as a signed long.  A null text is an empty one."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "fingerprint"]
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(np.array([fingerprint(x.as_py(), size) for x in batch.column(place)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), made], [*keep, "fingerprint"])

    return df.mapInArrow(tidy(run), T.StructType([*(df.schema[c] for c in keep), T.StructField("fingerprint", T.LongType())]))


def _syndromes() -> np.ndarray:
    """By byte and its place among the four of a half: the exclusive or of 1-based bit numbers, 31 bits counted."""
    table = np.zeros((4, 256), np.uint8)
    for place in range(4):
        for bit in range(8):
            number = 8 * place + bit + 1
            if number <= 31:
                table[place] ^= np.where(np.arange(256) >> bit & 1, number, 0).astype(np.uint8)
    return table


_SYNDROME = _syndromes()
#: For each syndrome s: masks that lead from a word to the anchors within 2 of it, its home first.
#: A word with syndrome s != 0 has its home across bit s, and anchors across each pair of bits a, b with a ^ b = s.
_MASKS = [[0]] + [[1 << (s - 1)] + [1 << (a - 1) | 1 << (b - 1) for a in range(1, 32) if (b := a ^ s) > a and b <= 31] for s in range(1, 32)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at_home) for 32-bit words: the Hamming anchors within 2 of each, on the low 31 bits."""
    octets = half.astype("<u4").view(np.uint8).reshape(-1, 4)
    syndrome = _SYNDROME[0][octets[:, 0]] ^ _SYNDROME[1][octets[:, 1]] ^ _SYNDROME[2][octets[:, 2]] ^ _SYNDROME[3][octets[:, 3]]
    low = half & np.uint32(0x7FFFFFFF)
    rows, found, home = [], [], []
    for s, masks in enumerate(_MASKS):
        at = np.flatnonzero(syndrome == s)
        for k, mask in enumerate(masks):
            rows.append(at)
            found.append(low[at] ^ np.uint32(mask))
            home.append(np.full(len(at), k == 0))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicated(distinct: DataFrame) -> DataFrame:
    """(anchor, home, fingerprint); anchor holds the half in bit 31."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 20_000):
                prints = batch.column(0).slice(first, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
                for side in (0, 1):
                    row, anchor, home = anchors((prints >> np.uint64(32 * side)).astype(np.uint32))
                    key = anchor.astype(np.int64) | side << 31
                    columns = [pa.array(key), pa.array(home), pa.array(prints[row].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "home", "fingerprint"])

    return distinct.mapInArrow(tidy(run), "anchor long, home boolean, fingerprint long")


def links(residents: np.ndarray, guests: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (resident, guest) that differ in 1 to distance bits."""
    names = np.unique(np.concatenate([residents, guests]))
    label = np.arange(len(names))
    at_resident, at_guest = np.searchsorted(names, residents), np.searchsorted(names, guests)
    found = []
    step = max(1, (1 << 21) // max(1, len(guests)))
    for first in range(0, len(residents), step):
        near = np.bitwise_count(residents[first : first + step, None] ^ guests[None, :]) <= distance
        for a in np.flatnonzero(near.any(axis=1)):
            own = label[at_resident[first + a]]
            met = np.flatnonzero(near[a])
            met = met[label[at_guest[met]] != own]
            others, where = np.unique(label[at_guest[met]], return_index=True)
            if len(others):
                found += [(int(residents[first + a]), int(guests[met[w]])) for w in where]
                label[np.isin(label, others)] = own
    return found


def _small_links(prints: np.ndarray, start: np.ndarray, homes: np.ndarray, sizes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """links of many small groups at once; a group is a run of prints, its residents first."""
    visits = np.repeat(sizes - homes, homes)  # guests that each resident meets
    first_guest = np.repeat(start + homes, homes)
    before = np.cumsum(homes) - homes
    resident = np.repeat(start, homes) + np.arange(homes.sum()) - np.repeat(before, homes)
    row = np.repeat(resident, visits)
    guest = np.repeat(first_guest, visits) + np.arange(len(row)) - np.repeat(np.cumsum(visits) - visits, visits)
    apart = np.bitwise_count(prints[row] ^ prints[guest])
    near = np.flatnonzero((apart <= distance) & (apart > 0))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    found = []
    for u, v in zip(prints[row[near]].tolist(), prints[guest[near]].tolist(), strict=True):
        x, y = root(u), root(v)
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((u, v))
    return found


#: A group with at most so many pairs is compared along with others; so many pairs are compared in one numpy step.
_SMALL, _STEP = 4096, 1 << 20


def _compare(distance: int):
    """Reads rows sorted by anchor, i, j and residents first; holds one batch and one group at a time."""

    def of(keys: np.ndarray, home: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[start, len(prints)])
        homes = np.add.reduceat(home.astype(np.int64), start)
        pairs = homes * (sizes - homes)
        found = []
        for k in np.flatnonzero(pairs > _SMALL):
            mid = start[k] + homes[k]
            found += links(prints[start[k] : mid], prints[mid : start[k] + sizes[k]], distance)
        small = np.flatnonzero((pairs > 0) & (pairs <= _SMALL))
        runs = np.cumsum(pairs[small]) // _STEP
        for r in np.unique(runs):
            at = small[runs == r]
            found += _small_links(prints, start[at], homes[at], sizes[at], distance)
        flat = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            now = (np.stack([column("anchor"), column("i"), column("j")], axis=1), column("home").astype(bool), column("fingerprint").view(np.uint64))
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True)) if held else now
            last = np.flatnonzero((now[0] != now[0][-1]).any(axis=1))
            cut_at = last[-1] + 1 if len(last) else 0
            held = tuple(x[cut_at:] for x in now)
            if cut_at:
                yield of(*(x[:cut_at] for x in now))
        if held:
            yield of(*held)

    return run


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that join all fingerprints (column fingerprint, each once) within distance, which is 3 at most."""
    if distance > 3:
        raise ValueError("two halves and one anchor radius cover 3 bits")
    every = _replicated(distinct)
    counts = every.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    # An anchor works only if it has a resident and another fingerprint; the resident is a guest of its home, too.
    parts = lambda n: F.ceil(n / chunk).cast("int")
    busy = counts.where((F.col("homes") > 0) & (F.col("all") > 1)).select("anchor", parts(F.col("homes")).alias("h"), parts(F.col("all")).alias("g"))
    rows = every.hint("merge").join(busy, "anchor")
    own = lambda n: F.pmod(F.xxhash64("fingerprint"), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    resident = rows.where("home").select("anchor", own("h").alias("i"), every_of("g").alias("j"), F.lit(True).alias("home"), "fingerprint")
    guest = rows.select("anchor", every_of("h").alias("i"), own("g").alias("j"), F.lit(False).alias("home"), "fingerprint")
    dealt = resident.unionByName(guest).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("home"))
    return dealt.mapInArrow(tidy(_compare(distance)), "u long, v long").distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of df.

    fingerprint is a signed long, component_id the smallest id reachable by
    links, the row's own included.  Null and empty texts have fingerprint 0 and
    link like any other; very long ones are hashed in blocks.  Rows with equal
    ids are each kept, and so are those with a null id, which counts as no id: a
    component of such rows only has a null component_id.  Other columns of df
    don't come along.  An empty df gives an empty result.
    """
    prints = cut(fingerprints(df.select(id, text), text, [id]))
    classes = prints.groupBy("fingerprint").agg(F.min(id).alias("least"))
    joined = components(fingerprint_links(classes.select("fingerprint"), distance))
    rooted = classes.hint("merge").join(joined, classes["fingerprint"] == joined["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.hint("merge").join(least, "root").select("fingerprint", "component_id")
    return prints.hint("merge").join(named, "fingerprint").select(id, "fingerprint", "component_id")
