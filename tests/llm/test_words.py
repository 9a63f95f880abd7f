"""Token counts, BPE and packing, which share how texts are split."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridlark.llm.bpe import bpe, decode, encode
from gridlark.llm.packing import library_ids, pack, pack_documents, pieces, plan
from gridlark.llm.token_counts import Automaton, counter, token_counts
from gridlark.llm.wordsplit import Cache, default_path

ODD = [
    "",
    " \t\n ",
    "<|startoftext|>Hi<|endoftext|> it's Ça İI ΣΑΣ ﬁ ² ½ x y don't!!'s \x1c\x85a ẞ 中文字 é 'll",
    "a" * 3000 + "!" * 500,
    "\x00\x01 ퟿ 🙂🙂 ‘’ “q” ŉ ſ µ ª",
    "The cat's 123 toes, they'll ###$$$ naïve Été",
    "word " * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return [r[0] for r in rows] + ODD


def test_bpe_equals_the_library(library, texts):
    own = bpe(default_path())
    found = own.encode(texts)
    for text, ids in zip(texts, found, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_small_caches_change_nothing(texts):
    own = bpe(default_path())
    expected = own.encode(texts)
    own.cache = Cache(2000)
    assert [own.encode([t])[0] for t in texts] == expected
    own.cache = Cache()


def test_library_ids_for_packing(library, texts):
    found = library_ids(default_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_and_decode_frames(spark, library):
    df = spark.createDataFrame([(1, "Hello wörld", "x", "y"), (2, None, "x", "y"), (2, None, "x", "y"), (3, "", None, None)], "doc_id long, text string, ids string, decoded string")
    rows = decode(encode(df)).orderBy("doc_id").collect()
    assert len(rows) == 4
    ids = library.encode("Hello wörld", add_special_tokens=False).ids
    assert np.frombuffer(rows[0]["ids"], "<u4").tolist() == ids
    assert rows[0]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert [bytes(r["ids"]) for r in rows[1:]] == [b""] * 3 and [r["decoded"] for r in rows[1:]] == [""] * 3
    assert encode(df.limit(0)).count() == 0


def greedy(tokens: set, symbols: tuple, longest: int = 1 << 20) -> int | None:
    n = at = 0
    while at < len(symbols):
        size = next((k for k in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + k] in tokens), 0)
        if not size:
            return None
        at, n = at + size, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(5)
    for whole in (True, False):
        tokens = {tuple(rng.choices(range(97, 100), k=rng.randint(1, 5))) for _ in range(25)}
        tokens |= {(*t[:-1], t[-1] + 256) for t in list(tokens)[:15]}
        if whole:
            tokens |= {(c,) for c in range(97, 100)} | {(c + 256,) for c in range(97, 100)}
        words = [bytes(rng.choices(range(97, 101 if not whole else 100), k=rng.randint(1, 14))) for _ in range(800)]
        expected = [greedy(tokens, (*w[:-1], w[-1] + 256)) for w in words]
        assert Automaton(sorted(tokens)).counts(words).tolist() == [1 if n is None else n for n in expected]


def test_token_counts(spark, library, texts):
    own = counter(default_path())
    vocab = own.split.spec["model"]["vocab"]
    tokens = set()
    for t in vocab:
        body = t.removesuffix("</w>")
        ids = [own.split.byte_of[c] for c in body]
        if ids:
            tokens.add((*ids[:-1], ids[-1] + 256) if body != t else tuple(ids))
    longest = max(map(len, tokens))
    of: dict[str, int] = {}
    for text, found in zip(texts, own.of(texts).tolist(), strict=True):
        words = ["".join(w) for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        for w in set(words) - of.keys():
            ids = [own.split.byte_of[c] for c in w]
            of[w] = greedy(tokens, (*ids[:-1], ids[-1] + 256), longest) or 1
        counts = [of[w] for w in words]
        assert found == [len(words), sum(counts), max(counts, default=0)]
    df = spark.createDataFrame([(1, None, "a"), (2, "the cat", "a"), (2, "the cat", "a")], "doc_id long, text string, n_tokens string")
    rows = token_counts(df).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_tokens"]) for r in rows] == [(0, 0), (2, 2), (2, 2)]
    assert token_counts(df.limit(0)).count() == 0


def used(segments, counts):
    """Checks a plan; gives its sequences' contents."""
    sequences: dict[int, list] = {}
    ranks: dict[int, list] = {}
    for length, rank, n, first, offset in segments.tolist():
        ranks.setdefault(length, []).append((rank, n))
        for k in range(n):
            sequences.setdefault(first + k, []).append((offset, length))
    for length, ranges in ranks.items():
        at = 0
        for rank, n in sorted(ranges):
            assert rank == at
            at += n
        assert at == counts[length]
    return sequences


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    lengths = [min(2048, 1 + int(rng.lognormvariate(6, 1.2))) for _ in range(3000)]
    counts = Counter(lengths)
    segments, total = plan(counts)
    sequences = used(segments, counts)
    assert set(sequences) == set(range(total))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert total <= 1.02 * max(-(-sum(lengths) // 2048), sum(n > 1024 for n in lengths)) + 2


def test_plan_of_few_and_equal_lengths():
    assert plan({})[1] == 0
    assert plan({1: 5000})[1] == 3
    assert plan({2048: 7})[1] == 7
    assert plan({1024: 5})[1] == 3
    assert plan({1500: 10, 548: 10})[1] == 10
    with pytest.raises(ValueError):
        plan({2049: 1})


def test_pack_documents(spark, library):
    texts = ["word " * 5000, "", None, "a b c", "a b c", ODD[2], "tail " * 2047]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(3, "a b c", 1)], "doc_id long, text string, offset int")
    rows = pack_documents(df).collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["start"] == 2048 * r["piece"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*texts, "a b c"])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(df.limit(0)).count() == 0


def test_pack_splits_a_hot_length(spark, monkeypatch):
    from gridlark.llm import packing

    monkeypatch.setattr(packing, "PER_SALT", 50)
    df = spark.range(1000).selectExpr("id", "0 as piece", "cast(if(id < 900, 700, 100 + id % 7) as long) as length").persist()
    rows = pack(df, ["id", "piece"]).collect()
    places = Counter((r["sequence_id"], r["offset"]) for r in rows)
    assert len(rows) == 1000 and set(places.values()) == {1}


def test_pieces_can_carry_ids(spark):
    r = pieces(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ids=True).first()
    assert len(r["ids"]) == 4 * r["length"] and hashlib.sha256(r["ids"]).hexdigest()
