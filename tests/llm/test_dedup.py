"""SimHash, components and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridlark.llm import queries as Q
from gridlark.llm.components import components
from gridlark.llm.simhash import anchors, fingerprint, fingerprint_links, links, near_duplicates
from gridlark.llm.suffixes import Anchors, remove_repeats, repeated_windows

DIR = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "A b c", "É é a a a a a", "w " * 5000, "x\x0by\x1cz q"])
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_anchors_are_all_code_words_within_two():
    rng = np.random.default_rng(0)
    halves = rng.integers(0, 1 << 32, 300, np.uint64).astype(np.uint32)
    row, anchor, home = anchors(halves)
    syndrome = lambda w: int(np.bitwise_xor.reduce([k + 1 for k in range(31) if w >> k & 1] or [0]))
    assert all(syndrome(int(a)) == 0 for a in anchor)
    apart = np.bitwise_count((halves[row] & np.uint32(0x7FFFFFFF)) ^ anchor)
    assert apart.max() <= 2 and (apart[home] <= 1).all()
    assert (np.bincount(row[home], minlength=300) == 1).all()
    assert set(np.bincount(row).tolist()) <= {1, 16}


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 60, np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 8), replace=False)
            prints.append(int(c) ^ sum(1 << int(k) for k in flips))
    prints = np.array(sorted(set(prints)), np.uint64)
    expected = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(int(prints[i] ^ prints[j])).count("1") <= 3])
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    at = {int(p): k for k, p in enumerate(prints.view(np.int64))}
    for chunk in (2048, 2):  # 2: every anchor is split
        found = fingerprint_links(frame, chunk=chunk).collect()
        assert roots(len(prints), [(at[r["u"]], at[r["v"]]) for r in found]) == expected
        assert all(bin(int(prints[at[r["u"]]] ^ prints[at[r["v"]]])).count("1") <= 3 for r in found)


def test_a_dense_group_gives_a_forest():
    prints = np.array([k * 3 for k in range(700)], np.uint64)
    found = links(prints, prints)
    assert len(found) < len(prints)


def test_components_of_odd_graphs(spark):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(200, 260)]
    star = [(500, k) for k in range(501, 700)]
    noise = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    edges = chain + star + noise + [(5, 5), (7, 3), (3, 7), (None, 4)]
    expected = roots(1200, [(a, b) for a, b in edges if a is not None])
    frame = spark.createDataFrame(edges, "u long, v long")
    for few in (0, 150, 200_000):  # by rounds alone, by both, by one task
        assert {r["node"]: r["root"] for r in components(frame, few).collect()} == {k: r for k, r in enumerate(expected) if k != r}
        assert components(frame.limit(0), few).count() == 0


def test_near_duplicates(spark):
    words = [f"w{k}" for k in range(400)]
    rng = random.Random(9)
    body = " ".join(rng.choices(words, k=900))
    texts = {10: body, 4: body, 8: body + " tail", 12: " ".join(rng.choices(words, k=300)), 3: None, 1: "", 20: " ", 30: "only two"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(4, body, "x")], "doc_id long, text string, fingerprint string")
    rows = near_duplicates(df).collect()
    assert len(rows) == len(texts) + 1
    prints = {k: slow_fingerprint(t) for k, t in texts.items()}
    ids = sorted(texts)
    expected = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[ids[i]] ^ prints[ids[j]]).count("1") <= 3])
    for r in rows:
        assert r["fingerprint"] % (1 << 64) == prints[r["doc_id"]]
        assert r["component_id"] == ids[expected[ids.index(r["doc_id"])]]
    assert near_duplicates(df.limit(0)).count() == 0


def test_simhash_query(spark):
    rows = Q.op6_simhash(spark, DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {k: f"{slow_fingerprint(t):016x}" for k, t in texts.items()}
    ids = sorted(texts)
    prints = [slow_fingerprint(texts[k]) for k in ids]
    expected = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: ids[expected[n]] for n, k in enumerate(ids)}


def slow_removal(texts, length):
    bodies = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        kept = bytes(c for c, gone in zip(b, covered, strict=True) if not gone)
        out.append((len(b), sum(covered), spans, kept))
    return out


def passages(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = [text(rng.randint(150, 700)) for _ in range(6)]
    out = [None, "", "short", text(199), "ab" * 600, "x" * 900, text(1200)]
    for _ in range(25):
        out.append("".join(rng.choice(shared) if rng.random() < 0.4 else text(rng.randint(1, 300)) for _ in range(rng.randint(1, 6))))
    out += [out[-1], out[-2], out[-3][7:], shared[0] * 3]
    return out


@pytest.mark.parametrize("seed,gather", [(0, 2000), (1, 2), (2, 2000)])
def test_removal(spark, seed, gather):
    texts = passages(seed)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, remaining string")
    rows = remove_repeats(df, gather=gather).orderBy("doc_id").collect()
    for expected, r in zip(slow_removal(texts, 200), rows, strict=True):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["remaining"])) == expected


def test_removal_of_repeated_rows_null_ids_and_empty_tables(spark):
    body = "".join(random.Random(1).choices("abcdefgh", k=500))
    df = spark.createDataFrame([(1, body, "e"), (1, body, "f"), (None, body[:300], None), (None, "other", None)], "doc_id long, text string, lang string")
    rows = remove_repeats(df, keep=["lang"], as_text=True).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["remaining"], r["lang"] or "") for r in rows) == [(5, 0, "other", ""), (300, 300, "", ""), (500, 500, "", "e"), (500, 500, "", "f")]
    assert remove_repeats(df.limit(0)).count() == 0


def test_other_lengths_and_cut_characters(spark):
    texts = ["é" * 30 + "abc", "xé" + "é" * 29 + "q", "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = remove_repeats(df, length=41, gram=11).orderBy("doc_id").collect()
    for expected, r in zip(slow_removal(texts, 41), rows, strict=True):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["remaining"])) == expected
    left = remove_repeats(df, length=41, gram=11, as_text=True).orderBy("doc_id").collect()
    assert [r["remaining"] for r in left] == [bytes(e[3]).decode(errors="ignore") for e in slow_removal(texts, 41)]


def test_segments_of_long_documents(spark):
    rng = np.random.default_rng(5)
    body = rng.integers(97, 101, 30_000).astype(np.uint8)
    small = Anchors(slab=4096).runs(body, np.array([0]), np.array([len(body)]))
    whole = Anchors().runs(body, np.array([0]), np.array([len(body)]))
    cover = lambda runs: {p for first, n in zip(runs[1], runs[2], strict=True) for p in range(first, first + n)}
    assert cover(small) == cover(whole) == set(range(len(body) - 199))
    of = lambda runs: {int(first) + k: int(first + anchor) for first, n, anchor in zip(runs[1], runs[2], runs[3], strict=True) for k in range(n)}
    assert of(small) == of(whole)


def test_radix_sort_finds_exactly_the_repeated_windows():
    rng = random.Random(8)
    pieces = ["".join(rng.choices("ab", k=40)).encode() for _ in range(60)]
    pieces += pieces[:10]
    windows = np.array([len(p) - 11 for p in pieces])
    anchor = np.zeros(len(pieces), np.int64)
    piece, inner = repeated_windows(np.zeros(len(pieces), np.int64), pieces, windows, anchor, 12)
    counts = Counter((k, p[k : k + 12]) for p in pieces for k in range(len(p) - 11))
    expected = {(n, k) for n, p in enumerate(pieces) for k in range(len(p) - 11) if counts[k, p[k : k + 12]] > 1}
    assert set(zip(piece.tolist(), inner.tolist(), strict=True)) == expected


def test_suffix_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    rows = Q.op5_suffix_dedup(spark, DIR).orderBy("doc_id").collect()
    for expected, r in zip(slow_removal([d["text"] for d in docs], 200), rows, strict=True):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*expected[:3], hashlib.sha256(expected[3]).hexdigest())


def test_null_ids_and_clashing_columns(spark):
    body = " ".join(f"w{k}" for k in range(300))
    rows = [(None, body, "x"), (None, "quite another text of a few words", "x"), (7, body, "x"), (9, None, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").withColumns({"component_id": F.lit(1), "node": F.lit(2)})
    found = {(r["doc_id"], r["fingerprint"] == 0, r["component_id"]) for r in near_duplicates(df).collect()}
    assert found == {(None, False, 7), (7, False, 7), (None, False, None), (9, True, 9), (None, True, 9)}
    kept = remove_repeats(df, keep=["n_bytes", "node"])
    assert kept.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "remaining", "node"]
    assert sorted(r["n_removed"] for r in kept.collect()) == [0, 0, 0, len(body), len(body)]


def test_rows_are_not_broadcast_by_the_size_of_compressed_texts(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    plan = lambda found: found._jdf.queryExecution().sparkPlan().toString()
    prints = df.select(F.xxhash64("text").alias("fingerprint")).distinct()
    assert "Broadcast" not in plan(fingerprint_links(prints))
    assert "Broadcast" not in plan(near_duplicates(df))
