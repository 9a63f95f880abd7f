"""Quality rules: counts of a text's words and lines, and a hashed n-gram likelihood ratio.

All of it is DataFrame functions; no Python runs on the executors.

Two multinomials over ``buckets`` hash buckets are counted, each from the words
and word pairs of whole texts: one from every document, one from trusted ones.
A text's score is the sum of log(trusted / raw) over its n-grams, divided by
their number.  A text is kept if no base rule fails and its score reaches the
threshold.  The threshold comes from labelled texts that were held out of the
trusted count and pass the base rules: as far below the 1st percentile of the
trusted ones as that is below their median, so that it follows the noise of
small corpora; or midway from there to the median of the distrusted ones, if
that is higher.

Scale: the counting pass sends at most ``buckets`` rows from a task to the
shuffle; the weights, ``buckets`` numbers whatever the input (128 KB), come back
to the driver and go into the scoring plan as one folded constant.  Every
labelled text counts, or is held out.  Half of the trusted ids are broadcast as
bitmaps (a bit for each id of a range, ``MAX_MAPS`` ranges), so texts are not
shuffled; if ids are no whole numbers or too far apart, and many, they are.
Each text is scored once and its row stored; the threshold comes from the stored
scores, by counts in ever narrower bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.common import SPACE, let, small, stored

BUCKETS = 1 << 14
#: Bitmaps (4 KB each, for 32768 neighbouring ids) that are broadcast.
MAX_MAPS = 4096
#: Scores that the driver sorts; more are counted in BINS bins first.
FEW, BINS = 10_000, 1024
#: Of the trusted texts held out: the percentile that the threshold starts from.
LOW = 0.01
#: Added to each bucket's counts, so that no probability is 0.
SMOOTHING = 1.0

#: Weights are rounded to a millionth of a nat.
UNIT = 1_000_000

_WORD = f"[^{SPACE}]+"


def words_of(text: Column) -> Column:
    """A null text has no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_WORD})"), F.lit(1))


def _pair_hashes(words: Column) -> Column:
    """A 64-bit hash of each two neighbouring words; none if there are fewer."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.xxhash64(a, b))


def _bucket_ids(words: Column, pairs: Column, buckets: int) -> Column:
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return F.concat(F.transform(words, lambda w: bucket(F.xxhash64(w))), F.transform(pairs, bucket))


def _repeated_words(words: Column, pairs: Column) -> Column:
    """Words in 3-word windows that occur twice or more; pairs are the hashes of word pairs.

    Windows are told apart by their 64-bit hash; sorting (hash, place) puts
    equal ones side by side, so the work is n log n however often one recurs.
    """

    def covered(places: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        add = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + 3 - F.greatest(acc["end"] - i, F.lit(0))).alias("n"))
        return F.aggregate(places, zero, add, lambda acc: acc["n"])

    def among(sorted_: Column) -> Column:
        twice = F.filter(sorted_, lambda e, j: (e["h"] == F.get(sorted_, j - 1)["h"]) | (e["h"] == F.get(sorted_, j + 1)["h"]))
        return covered(F.sort_array(F.transform(twice, lambda e: e["i"])))

    def of(hashes: Column) -> Column:
        entries = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(entries), among))

    count = F.greatest(F.size(words) - 2, F.lit(0))
    return let(F.zip_with(F.slice(pairs, 1, count), F.slice(words, 3, count), lambda p, w: F.xxhash64(p, w)), of)


def _repeated_lines(text: Column) -> Column:
    return let(
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")),
        lambda lines: F.size(lines) - F.size(F.array_distinct(lines)),
    )


def base_counts(df: DataFrame, text: str = "text", weights: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null or empty text has no words and fails.  With weights (an array of
    whole numbers of 1 / UNIT nats by bucket), llr is the mean weight of the
    text's n-grams in nats, null if it has none.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(words: Column, pairs: Column) -> Column:
        out = [F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), _repeated_words(words, pairs).alias("n_repeat_words")]
        if weights is not None:
            total = lambda ids: F.aggregate(ids, F.lit(0).cast("long"), lambda acc, b: acc + F.get(weights, b))
            mean = lambda ids: total(ids) / F.nullif(F.size(ids), F.lit(0)) / UNIT
            out.append(let(_bucket_ids(words, pairs, buckets), mean).alias("llr"))
        return F.struct(*out)

    found = df.withColumn("_of_words", let(words_of(F.col(text)), lambda w: let(_pair_hashes(w), lambda p: of(w, p))))
    n, repeated = F.col("_of_words.n_words").cast("long"), F.col("_of_words.n_repeat_words").cast("long")
    found = found.withColumns(
        {
            "n_words": n,
            "word_chars": F.col("_of_words.word_chars").cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": _repeated_lines(whole).cast("long"),
            "n_repeat_words": repeated,
            "base_failed": (n < 50) | (100 * repeated > 50 * n),
        }
        | ({"llr": F.col("_of_words.llr")} if weights is not None else {})
    )
    return found.drop("_of_words")


def trusted_ids(labels: DataFrame, max_trusted: int | None = None, quality: int = 1) -> DataFrame:
    """The doc_id of labelled rows of a quality: all, or the max_trusted first by a hash of the id."""
    found = labels.where(F.col("quality") == quality).where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return found if max_trusted is None else found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def marked(df: DataFrame, ids: DataFrame, max_maps: int = MAX_MAPS) -> DataFrame:
    """df with t: 1 if its doc_id is among ids (doc_id, each once, none null), else 0."""
    ids = stored(ids)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(x.schema["doc_id"].dataType, whole) for x in (df, ids)):
        id = F.col("doc_id").cast("long")
        maps = stored(ids.groupBy(F.bitmap_bucket_number(id).alias("_range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(id)).alias("_bits")))
        if maps.count() <= max_maps:
            place = F.bitmap_bit_position(id)
            octet = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            bit = F.getbit(octet, (place % 8).cast("int")).cast("int")
            return df.join(F.broadcast(maps), F.bitmap_bucket_number(id) == F.col("_range"), "left").withColumn("t", F.coalesce(bit, F.lit(0))).drop("_range", "_bits")
    known = small(ids).withColumnRenamed("doc_id", "_id")
    return df.hint("merge").join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("t", F.col("_id").isNotNull().cast("int")).drop("_id")


def bucket_weights(df: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: weights, an array of log(trusted / raw) by bucket.

    Raw counts come from every row of df, trusted ones from those whose doc_id
    is in trusted.  Without a trusted row every weight is 0.
    """
    ids = let(words_of(F.col(text)), lambda w: _bucket_ids(w, _pair_hashes(w), buckets)).alias("ids")
    counts = marked(df.select("doc_id", text), trusted).select("t", ids).select("t", F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good"))
    every = df.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("id"))
    both = every.join(counts, "id", "left").na.fill(0, ["raw", "good"])
    sums = both.agg(
        F.array_sort(F.collect_list(F.struct("id", "raw", "good"))).alias("rows"), F.sum("raw").alias("raw"), F.sum("good").alias("good")
    )
    share = lambda n, total: (n + SMOOTHING) / (total + SMOOTHING * buckets)
    weight = lambda r: F.when(F.col("good") == 0, F.lit(0.0)).otherwise(F.log(share(r["good"], F.col("good")) / share(r["raw"], F.col("raw"))))
    return sums.select(F.transform("rows", weight).alias("weights"))


def percentiles(df: DataFrame, column: str, at: list[float], few: int = FEW) -> list[float | None]:
    """Of the numbers in a column that is stored, exactly and as F.percentile has them; None if there are none.

    At most few numbers or BINS counts come to the driver at once: bins that
    hold a wanted place are divided further.
    """
    value = F.col(column)
    (ends,) = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")).collect()
    places = [(ends["n"] - 1) * p for p in at]
    found: dict[int, float] = {}
    left = [(ends["least"], ends["most"], 0, ends["n"], {f(x) for x in places for f in (math.floor, math.ceil)})] if ends["n"] else []
    while left:
        low, high, first, n, ranks = left.pop()
        inside = df.where(value.between(low, high))
        if low == high:
            found |= dict.fromkeys(ranks, low)
        elif n <= few:
            numbers = sorted(r[0] for r in inside.select(value).collect())
            found |= {k: numbers[k - first] for k in ranks}
        else:
            place = F.floor((value - low) / (high - low) * BINS)
            for r in sorted(inside.groupBy(place.alias("bin")).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")).collect()):
                if own := {k for k in ranks if first <= k < first + r["n"]}:
                    left.append((r["least"], r["most"], first, r["n"], own))
                first += r["n"]
    between = lambda x: found[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * found[math.floor(x)] + (x - math.floor(x)) * found[math.ceil(x)]
    return [between(x) if found else None for x in places]


def _half() -> Column:
    """0: a trusted id is counted, 1: it is held out."""
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))


def fitted_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """From all labelled texts that were held out and pass the base rules; -infinity without trusted ones.  scored is stored."""
    trusted = trusted_ids(labels)
    good = trusted.where(_half() == 1).select(F.col("doc_id").alias("_id"), F.lit(True).alias("good"))
    bad = trusted_ids(labels, quality=0).join(trusted.hint("merge"), "doc_id", "left_anti").select(F.col("doc_id").alias("_id"), F.lit(False).alias("good"))
    passed = scored.where("not base_failed").select("doc_id", "llr")
    held = stored(passed.hint("merge").join(good.unionByName(bad), F.col("doc_id") == F.col("_id")).select("good", "llr"))
    low, middle = percentiles(held.where("good"), "llr", [LOW, 0.5])
    (worse,) = percentiles(held.where("not good"), "llr", [0.5])
    return threshold(low, middle, worse)


def threshold(low: float | None, middle: float | None, bad: float | None) -> float:
    """From the 1st percentile and the median of trusted scores and the median of distrusted ones; -infinity without trusted ones."""
    if low is None or middle is None:
        return float("-inf")
    below = 2 * low - middle
    return max(below, (low + bad) / 2) if bad is not None and bad < low else below


def _constant(weights: list[float]) -> Column:
    """The weights in 1 / UNIT nats, as an array that the optimizer folds; whole numbers in one string keep the plan small."""
    return F.split(F.lit(",".join(str(round(w * UNIT)) for w in weights)), ",").cast("array<int>")


def quality(df: DataFrame, labels: DataFrame, text: str = "text", least: float | None = None, buckets: int = BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of df (all by default) with the base counts, llr (the score) and kept; the threshold least (nats per n-gram) is fitted if not given.

    Null and empty texts fail a base rule and are not kept; very long ones are
    read whole.  Repeated rows each count.  Columns of df with these names are
    replaced.  Nothing else is lost; an empty df gives an empty result.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    df = df.drop(*(c for c in df.columns if c in own))
    keep = [c for c in (df.columns if keep is None else keep) if c not in own]
    (fitted,) = bucket_weights(df, trusted_ids(labels).where(_half() == 0), text, buckets).collect()
    scored = base_counts(df, text, _constant(fitted["weights"]), buckets).select(*dict.fromkeys([*keep, "doc_id"]), *own[:-1])
    if least is None:
        scored = stored(scored)
        least = fitted_threshold(scored, labels)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce("llr", F.lit(0.0)) >= least)).select(*keep, *own)
