"""Registered queries, whole, against brute force: every row and every column."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from gridlark.llm import queries as Q
from gridlark.llm.packing import pack_documents
from gridlark.llm.quality import BUCKETS, threshold
from gridlark.llm.secret_scan import ALLOW, CLASSES, secret_scan, spans_string
from gridlark.llm.token_counts import counter
from gridlark.llm.wordsplit import default_path
from tests.llm.test_native import SECRETS, base, frame, license_base, secret_base, slow_licenses
from tests.llm.test_words import greedy

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_token_counts(spark, texts, library):
    split = counter(default_path()).split
    tokens = set()
    for t in split.spec["model"]["vocab"]:
        body = t.removesuffix("</w>")
        ids = [split.byte_of[c] for c in body]
        if ids:
            tokens.add((*ids[:-1], ids[-1] + 256) if body != t else tuple(ids))
    longest, of = max(map(len, tokens)), {}
    rows = Q.op1_token_counts(spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(texts[r["doc_id"]] or ""))]
        for w in set(words) - of.keys():
            ids = [split.byte_of[c] for c in w]
            of[w] = greedy(tokens, (*ids[:-1], ids[-1] + 256), longest) or 1
        counts = [of[w] for w in words]
        assert (r["n_words"], r["n_tokens"], r["max_word_tokens"]) == (len(words), sum(counts), max(counts, default=0))


def test_licenses(spark, texts):
    for r in Q.op3_license_scan(spark, DIR).collect():
        text = texts[r["doc_id"]]
        n, places, labels = license_base(text)
        found = slow_licenses(text)
        ends = (places[0], places[-1]) if places else (None, None)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), *ends, labels)
        assert r["labels"] == ",".join(sorted({x[3] for x in found} | set(filter(None, labels.split(",")))))
        assert r["score"] == max((x[2] for x in found), default=0) / 5


def check_packing(rows, texts, library):
    pieces = {}
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces.setdefault((key, k), []).append((at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    found = {}
    for r in rows:
        found.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in pieces.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(total / 2048) * 1.02 + 1


def test_packing(spark, texts, library):
    check_packing(Q.op4_best_fit_packing(spark, DIR).collect(), texts.items(), library)


def test_packing_of_odd_rows(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, ""), (3, "word " * 5000)]
    clash = ["rank", "sequence_id", "_salt", "_n", "_within", "_before", "piece", "length"]
    df = spark.createDataFrame([(*r, *clash) for r in rows], ", ".join(["doc_id long, text string", *(f"{c} string" for c in clash)]))
    check_packing(pack_documents(df).collect(), rows, library)
    assert pack_documents(df.limit(0)).count() == 0


def slow_entropy(text):
    spans = []
    for c in CLASSES:
        most = math.floor((math.log2(c.width) - c.bits) * c.width * 1e6)
        term = [round(n * math.log2(n) * 1e6) if n else 0 for n in range(c.width + 2)]
        for m in re.finditer(c.run, text, re.A):
            run = m[0]
            patterns = [(p.replace("(?i)", ""), re.I if "(?i)" in p else 0) for p in (c.unless, *ALLOW)]
            if any(re.search(p, run, flags) for p, flags in patterns):
                continue
            hot = [i for i in range(len(run) - c.width + 1) if sum(term[n] for n in Counter(run[i : i + c.width]).values()) <= most]
            if hot:
                spans.append(("entropy", m.start() + hot[0], m.start() + hot[-1] + c.width))
    return spans


MORE = [
    "key AbCdEfGhIjKlMnOpQrStUvWx and getElementsByClassNameAndTypeOfThing and some-long-slug-of-words-and-more 2024-01-01/2025-01-01/2026",
    "aGhTbQzLmWxRkPvYcNsDfJuE " + "x8Fk2LqP9zRt4Wv7Bn3Mj6Hd" * 3 + " DEADBEEFDEADBEEFDEADBEEF 1f3a5c7e9b2d4f6a8c0e",
]


def slow_spans(text):
    kinds = ["assign", "access", "hex", "entropy"]
    found = [tuple(x.split(":")) for x in secret_base(text).split(",") if x]
    every = [(int(s), kinds.index(k), int(e)) for k, s, e in found] + [(s, 3, e) for _, s, e in slow_entropy(text or "")]
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(every))


def test_secrets(spark, texts):
    for r in Q.op7_secret_scan(spark, DIR).collect():
        text = texts[r["doc_id"]] or ""
        own = secret_base(text)
        kinds = Counter(x.split(":")[0] for x in own.split(",") if x)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and r["spans"] == slow_spans(text)
    odd = SECRETS + MORE + [" ".join(f"{k:032x}" for k in range(7**20, 7**20 + 700))]
    rows = secret_scan(frame(spark, odd)).select("doc_id", spans_string("secrets").alias("s")).orderBy("doc_id").collect()
    assert [r["s"] for r in rows] == [slow_spans(t) for t in odd]


def test_bpe(spark, texts, library):
    rows = Q.op9_bpe(spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def chained(*parts: bytes) -> int:
    """Spark's xxhash64 of several columns, as a signed number."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    grams = {}
    for key, text in texts.items():
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        grams[key] = [chained(w) % BUCKETS for w in words] + [chained(a, b) % BUCKETS for a, b in zip(words, words[1:], strict=False)]
    half = lambda k: chained(struct.pack("<q", k), b"half") % 2
    trusted = {k for k, q in labels.items() if q == 1}
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for key, of in grams.items():
        np.add.at(raw, of, 1)
        if key in trusted and half(key) == 0:
            np.add.at(good, of, 1)
    weights = np.log((good + 1) / (good.sum() + BUCKETS) / ((raw + 1) / (raw.sum() + BUCKETS)))
    weights = np.array([round(w * 1e6) for w in weights.tolist()])
    llr = {k: weights[of].sum() / len(of) / 1e6 if of else None for k, of in grams.items()}
    failed = {k: base(t)[5] for k, t in texts.items()}
    held = lambda q: [llr[k] for k, x in labels.items() if x == q and k in texts and not failed[k] and (q == 0 or half(k) == 1)]
    cut = threshold(np.percentile(held(1), 1), np.percentile(held(1), 50), np.percentile(held(0), 50) if held(0) else None)
    rows = Q.op10_quality_rules(spark, DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        k = r["doc_id"]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[k])
        assert r["llr"] == pytest.approx(llr[k], abs=1e-9) and r["kept"] == (not failed[k] and (llr[k] or 0) >= cut)


def test_thresholds():
    assert threshold(None, None, None) == float("-inf")
    assert threshold(-0.2, 0.0, None) == threshold(-0.2, 0.0, -0.1) == threshold(-0.2, 0.0, -9.0) == -0.4
    assert threshold(-0.2, 0.0, -0.3) == pytest.approx(-0.25)
