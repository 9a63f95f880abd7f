"""Near copies: SimHash anchors give candidates, exact Jaccard similarity of word shingles decides.

The similarity is that of the sets of 5-word shingles, 0.8 or more.  At 0.8
every tenth bit or so of a fingerprint differs, far more than one 64-bit
fingerprint can cover by anchors; so a text has a wide one, of 64 blocks of 31
bits, made from its word pairs, of which an edit spoils fewer than of longer
shingles.  In each block the anchors are the words of the Hamming code
(covering radius 1): a text goes to its nearest anchor, and texts that share an
anchor are candidates.  Two blocks meet whose words differ in no bit, or in one
or two that the code corrects; a pair with one bit of 12 differing meets in 7
or 8 of the 64, one with 3 of 20 (a passage cut out or put in, at 0.8 exactly)
in one on average.  Recall is measured in the README.

A class is the texts of one set, known by a 64-bit hash of it.  Candidates
whose first 128 bits differ in more than 36 are left out: at 0.8 it is 19 on
average and over 36 for one pair in 100,000.

Scale: a class has 64 rows of 32 bytes, and keys of one class drop out;
sets are read only for classes that have a candidate.  A class first meets the
least classes of its first keys, the nearest few of them.  Then only keys whose
classes are not yet in one component are left, and there the classes outside
the key's largest component meet the others, dealt out in chunks.  So a large
group of near copies costs rows in proportion to its size.  A task gives back a
spanning forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.common import small, stored, tidy
from gridlark.llm.components import components
from gridlark.llm.simhash import SEED, words_of

#: Words of a shingle, and the least similarity in hundredths.
SIZE, LEAST = 5, 80
#: Words of what fingerprints are made of.
FEATURE = 2
BLOCKS, BITS = 64, 31
#: Of the first 128 bits, how many may differ.
NEAR = 36
#: Blocks whose least classes a class meets first, and how many of these, the nearest; later steps see to the rest.
STAR_BLOCKS, FIRST = 12, 8
#: Classes that a task holds of a key at once.
CHUNK = 1024
#: Features that are worked on at once; their counts fit in a byte.
_STEP = 255
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BITS + 16, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NUMBERS = np.arange(1, BITS + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The set of size-word shingles as rising hashes, from the words' hashes; fewer words are one shingle, none are none."""
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    if not len(words):
        return total[:0]
    for k in range(min(size, len(words))):
        total += _mixed(words[k : k + n] * _ODD[k])
        total *= _ODD[BITS]
    return np.unique(total)


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words_of(text or "")), np.uint64)


def wide_bits(features: np.ndarray) -> np.ndarray:
    """BLOCKS x BITS bits: 1 if set in over half of the features' hashes."""
    width = BLOCKS * BITS
    ones = np.zeros(width, np.int64)
    for at in range(0, len(features), _STEP):
        hashes = _mixed(features[at : at + _STEP, None] * _ODD[:BITS])
        ones += np.unpackbits(hashes.view(np.uint8), axis=1)[:, :width].sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(features)).reshape(BLOCKS, BITS)


def nearest_anchors(bits: np.ndarray) -> np.ndarray:
    """Each block's anchor: the Hamming word within 1 of it."""
    syndrome = np.bitwise_xor.reduce(np.where(bits, _NUMBERS, 0), axis=1)
    word = (bits << np.arange(BITS)).sum(axis=1)
    return word ^ np.where(syndrome, 1 << np.maximum(syndrome - 1, 0), 0)


def _name(of: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(of.tobytes()) - (1 << 63)


_SKETCH = [T.StructField("name", T.LongType()), T.StructField("print0", T.LongType()), T.StructField("print1", T.LongType()), T.StructField("anchors", T.ArrayType(T.IntegerType()))]


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """(id, text_hash, name, print0, print1, anchors) of rows (id, text_hash, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, found = [], [], []
            for x in batch.column(2):
                words = word_hashes(x.as_py())
                names.append(_name(shingle_hashes(words, size)))
                bits = wide_bits(shingle_hashes(words, FEATURE))
                prints.append(np.packbits(bits.ravel()[:128]).view(np.int64))
                found.append(nearest_anchors(bits).astype(np.int32) if len(words) else np.zeros(0, np.int32))
            prints = np.array(prints, np.int64).reshape(-1, 2)
            made = [pa.array(names, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["id", "text_hash", *(f.name for f in _SKETCH)])

    return rows.mapInArrow(tidy(run), T.StructType([*(rows.schema[c] for c in ("id", "text_hash")), *_SKETCH]))


def _sets(wanted: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(name, set) of the classes wanted (name, id, text_hash); a row of another set, of a like hash, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                names, sets = [], []
                for name, x in zip(*(c.slice(first, 500) for c in batch.columns), strict=True):
                    of = shingle_hashes(word_hashes(x.as_py()), size)
                    if _name(of) == name.as_py():
                        names.append(name.as_py())
                        sets.append(of.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["name", "set"])

    at = small(stored(wanted)).withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    found = rows.join(at, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("name", "text")
    return stored(found.mapInArrow(tidy(run), "name long, set binary").dropDuplicates(["name"]))


class _Group:
    """The residents of one chunk, and the components known there."""

    def __init__(self, least: int):
        self.least = least
        self.names: list[int] = []
        self.roots: list[int] = []
        self.sets: list[np.ndarray] = []
        self.parent: dict[int, int] = {}
        self.index: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def root(self, x: int) -> int:
        while (y := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(y, y)
            x = y
        return x

    def add(self, name: int, root: int, of: np.ndarray) -> None:
        self.names.append(name)
        self.roots.append(root)
        self.sets.append(of)

    def meet(self, name: int, root: int, of: np.ndarray) -> list[tuple[int, int]]:
        """Links of a guest to residents of other components."""
        if not self.sets:
            return []
        if self.index is None:
            sizes = np.array([len(s) for s in self.sets])
            every = np.concatenate(self.sets)
            order = np.argsort(every, kind="stable")
            self.index = every[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        every, owner, sizes = self.index
        first, end = np.searchsorted(every, of, "left"), np.searchsorted(every, of, "right")
        n = end - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        found = []
        for k in np.flatnonzero(100 * both >= self.least * (sizes + len(of) - both)):
            a, b = self.root(self.roots[k]), self.root(root)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                found.append((self.names[k], name))
        return found


def _compare(least: int):
    """Reads (key, i, j, home, name, root, set) sorted by key, i, j and residents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, _Group(least)
        for batch in batches:
            found: list[tuple[int, int]] = []
            key, i, j, home, name, root = (batch.column(k).to_pylist() for k in range(6))
            for k, of in enumerate(batch.column(6)):
                if now != (key[k], i[k], j[k]):
                    now, group = (key[k], i[k], j[k]), _Group(least)
                own = np.frombuffer(of.as_buffer(), "<u8")
                if home[k]:
                    group.add(name[k], root[k], own.copy())
                else:
                    found += group.meet(name[k], root[k], own)
            yield pa.RecordBatch.from_arrays([pa.array([x[side] for x in found], pa.int64()) for side in (0, 1)], ["u", "v"])

    return run


def _links(residents: DataFrame, guests: DataFrame, sets: DataFrame, least: int, chunk: int) -> DataFrame:
    """(u, v): links between residents and guests (key, name, root) of the same key."""
    parts = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    counted = lambda df, c: df.groupBy("key").agg(F.count(F.lit(1)).alias(c))
    counts = counted(residents, "r").join(counted(guests, "g"), "key").select("key", parts("r").alias("r"), parts("g").alias("g"))
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_home = residents.join(counts, "key").select("key", own("r").alias("i"), every_of("g").alias("j"), F.lit(True).alias("home"), "name", "root")
    visiting = guests.join(counts, "key").select("key", every_of("r").alias("i"), own("g").alias("j"), F.lit(False).alias("home"), "name", "root")
    dealt = at_home.unionByName(visiting).join(sets, "name").select("key", "i", "j", "home", "name", "root", "set")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("home")).mapInArrow(tidy(_compare(least)), "u long, v long")


def _apart(a: str, b: str) -> Column:
    """How many of the first 128 bits of two fingerprints differ; the columns' names begin with a and b."""
    return sum((F.bit_count(F.col(f"{a}print{k}").bitwiseXOR(F.col(f"{b}print{k}"))) for k in (0, 1)), F.lit(0))


def near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(id, text_hash, component_id), one row for each row of df.

    component_id is the smallest id reachable by links, the row's own included;
    texts link if the Jaccard similarity of their shingles is least hundredths
    or more.  text_hash (xxhash64 of the text, empty for null) tells rows of a
    repeated id apart.  Null and empty texts link with each other.  Rows with a
    null id count, but give no id; a component of such rows only has a null
    component_id.  Very long texts are read whole.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(id).alias("id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    sketches = stored(_sketches(rows, size))
    sketch = F.struct("print0", "print1", "anchors")
    classes = stored(sketches.groupBy("name").agg(F.min(F.struct("id", "text_hash")).alias("row"), F.min("id").alias("least"), F.first(sketch).alias("of")).select("name", "row", "least", "of.*"))
    prints = ["print0", "print1"]
    keys = classes.select("name", *prints, F.posexplode("anchors").alias("block", "anchor"))
    keys = keys.select("name", *prints, (F.shiftleft(F.col("block").cast("long"), 32) + F.col("anchor")).alias("key"))
    busy = keys.groupBy("key").agg(F.min("name").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = stored(keys.join(busy, "key").select("key", "name", *prints, "centre"))

    pairs = keyed.where((F.col("key") < STAR_BLOCKS << 32) & (F.col("name") != F.col("centre"))).select("centre", "name", *prints).distinct()
    of_centre = classes.select(F.col("name").alias("centre"), *(F.col(p).alias(f"centre_{p}") for p in prints))
    pairs = pairs.join(of_centre, "centre").select("name", "centre", _apart("", "centre_").alias("apart")).where(F.col("apart") <= NEAR)
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("apart", "centre"))), 1, FIRST)
    star = pairs.groupBy("name").agg(nearest.alias("of")).select("name", F.explode("of.centre").alias("key"))
    star = stored(star.select("key", "name", F.col("name").alias("root")))
    centres = star.select("key").distinct().select("key", F.col("key").alias("name"), F.col("key").alias("root"))
    of_rows = classes.select("name", "row.*")
    known = star.select("name").union(centres.select("name")).distinct()
    sets = _sets(known.join(of_rows, "name"), rows, size)
    first = stored(_links(centres, star, sets, least, chunk))
    roots = components(first)

    labelled = keyed.join(roots, keyed["name"] == roots["node"], "left").select("key", "name", *prints, F.coalesce("root", "name").alias("root"))
    labelled = stored(labelled)
    shares = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "most")
    rest = stored(labelled.join(mixed, "key"))
    other = rest.select("key", *(F.col(c).alias(f"other_{c}") for c in ("root", *prints)))
    meet = (F.col("root") != F.col("other_root")) & (_apart("", "other_") <= NEAR)
    few = stored(rest.where("root != most").join(other, (rest["key"] == other["key"]) & meet, "left_semi"))
    other = few.select(F.col("key").alias("other_key"), *(F.col(c).alias(f"other_{c}") for c in ("root", *prints)))
    met = stored(rest.join(other, (F.col("key") == F.col("other_key")) & meet, "left_semi"))
    lacking = met.select("name").union(few.select("name")).distinct().join(sets, "name", "left_anti")
    every = sets.unionByName(_sets(lacking.join(of_rows, "name"), rows, size))
    second = _links(few.select("key", "name", "root"), met.select("key", "name", "root"), every, least, chunk)

    joined = components(first.union(second))
    rooted = classes.join(joined, classes["name"] == joined["node"], "left").select("name", "least", F.coalesce("root", "name").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named_ = rooted.join(smallest, "root").select("name", "component_id")
    return sketches.select("id", "text_hash", "name").join(named_, "name").select(F.col("id").alias(id), "text_hash", "component_id")
