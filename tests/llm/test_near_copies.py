"""The pipeline's near-dedup stage against brute force on 5-word shingles."""

import random
import re

import corpus_pipeline
from gridlark.llm.near_copies import near_copies
from tests.llm.test_dedup import roots

DIR = "/root/testdata/sf0.001"


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(texts):
    ids = sorted(texts)
    sets = [slow_shingles(texts[k]) for k in ids]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    found = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if near(sets[i], sets[j])])
    return {k: ids[found[n]] for n, k in enumerate(ids)}


def test_the_stage_takes_five_words_and_four_fifths(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = slow_components(texts)
    assert expected[177] == 1 and expected[145] == 6  # 11 and 7 of 64 bits apart
    left = corpus_pipeline.near_dedup_stage(spark, docs, DIR)
    assert left.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in left.collect()} == set(expected.values())


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", " \n", "One two", "one TWO", "a b c d e", "a b c d e f"]
    for _ in range(5):
        now = rng.choices(words, k=150)
        for _ in range(12):  # a chain of edits, whose ends are no near copies
            now = [rng.choice(words) if rng.random() < 0.015 else w for w in now]
            texts.append(" ".join(now))
        texts.append(" ".join(now).upper())
    named = {10 * k + 3: t for k, t in enumerate(rng.sample(texts, len(texts)))}
    df = spark.createDataFrame(list(named.items()), "doc_id long, text string")
    expected = slow_components(named)
    for chunk in (1024, 2):
        rows = near_copies(df, chunk=chunk).collect()
        assert len(rows) == len(named) and {r["doc_id"]: r["component_id"] for r in rows} == expected
    again = df.union(df.limit(3))
    assert near_copies(again).count() == len(named) + 3
    assert near_copies(df.limit(0)).count() == 0
