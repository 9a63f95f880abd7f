import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from gridlark.llm import queries
from gridlark.llm.media import (
    BLOCK,
    MediaError,
    chosen_filters,
    cosine_hash,
    decode_png,
    encode_png,
    filter_rows,
    payload_of,
    read_media,
    text_to_media,
    unfilter_rows,
)


def slow_unfilter(data, kinds, step):
    """PNG's definition, byte by byte."""
    out = np.zeros_like(data)
    for y in range(data.shape[0]):
        for x in range(data.shape[1]):
            a = int(out[y, x - step]) if x >= step else 0
            b = int(out[y - 1, x]) if y else 0
            c = int(out[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out[y, x] = (int(data[y, x]) + [0, a, b, (a + b) // 2, near][kinds[y]]) % 256
    return out


@pytest.mark.parametrize("step", [1, 3])
@pytest.mark.parametrize("most", [0, 2, 4])
def test_filters(step, most):
    rng = np.random.default_rng(most)
    rows = rng.integers(0, 256, (9, 6 * step), np.uint8)
    kinds = rng.integers(0, most + 1, 9).astype(np.uint8)
    data = filter_rows(rows, kinds, step)
    assert (slow_unfilter(data, kinds, step) == rows).all()
    assert (unfilter_rows(data, kinds, step) == rows).all()


def test_png_round_trip_and_broken_files():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (5, 7, 3)):
        samples = rng.integers(0, 256, shape, np.uint8)
        data = encode_png(samples, rng.integers(0, 5, 5).astype(np.uint8))
        assert (decode_png(data).reshape(shape) == samples).all()
        for k in (0, 20, 45, len(data) - 3):
            broken = bytearray(data)
            broken[k] ^= 1
            with pytest.raises(MediaError):
                decode_png(bytes(broken))
        with pytest.raises(MediaError):
            decode_png(data[:-12])


def test_cosine_hash_is_stable():
    rng = np.random.default_rng(3)
    blobs = np.kron(rng.integers(0, 250, (8, 10)), np.ones((8, 8)))  # every low frequency has weight
    image = blobs.astype(np.uint8)
    noisy = (image.astype(int) + np.random.default_rng(0).integers(-2, 3, image.shape)).clip(0, 255).astype(np.uint8)
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert apart(cosine_hash(image[:, :, None]), cosine_hash(noisy[:, :, None])) <= 4
    assert cosine_hash(image[:, :, None]) == cosine_hash(image[:, :, None].copy())


def test_frames(spark):
    texts = [None, "", "x" * BLOCK, "é" * 400, "long " * 60_000, "long " * 60_000]
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = read_media(text_to_media(df)).orderBy("doc_id").collect()
    for text, r in zip(texts, rows, strict=True):
        payload = payload_of((text or "").encode())
        assert len(payload) % BLOCK == 0 and payload
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"]) and r["error"] is None
    assert rows[4]["feature"] == rows[5]["feature"] and rows[0]["media_sha256"] == rows[1]["media_sha256"]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(rows[2]["media"][:-4]))], "doc_id long, media binary")
    assert [r["error"] is not None for r in read_media(bad).collect()] == [True] * 3
    assert read_media(text_to_media(df.limit(0))).count() == 0


def test_random_texts_come_back(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([32, 65, 0x20AC, 0x1F642])) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in text_to_media(df).collect():
        assert decode_png(r["media"]).tobytes().rstrip(b"\xff").decode() == r["text"]


def slow_feature(samples: np.ndarray) -> str:
    height, width = samples.shape
    edges = lambda n: [(k * n // 32, max(k * n // 32 + 1, (k + 1) * n // 32)) for k in range(32)]
    small = [[sum(int(x) for row in samples[a:b] for x in row[c:d]) / ((b - a) * (d - c)) for c, d in edges(width)] for a, b in edges(height)]
    wave = [[math.cos(math.pi / 32 * (x + 0.5) * u) for x in range(32)] for u in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low)[31] / 2 + sorted(low)[32] / 2
    return f"{sum((value > middle) << (63 - k) for k, value in enumerate(low)):016x}"


def test_feature_equals_a_slow_transform():
    rng = np.random.default_rng(4)
    for shape in ((1, 576), (3, 576), (40, 576), (64, 32), (33, 70)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert cosine_hash(image) == slow_feature(image)


def test_written_rows_are_filtered():
    rows = np.arange(3 * 576).reshape(3, 576).astype(np.uint8)
    rows[1] = rows[0]
    assert chosen_filters(rows, 1).tolist() == [1, 2, 1]
    text = np.frombuffer(payload_of(b"some words of a text " * 100), np.uint8).reshape(-1, 576)
    assert chosen_filters(text, 1).any()
    assert (decode_png(encode_png(text))[:, :, 0] == text).all()


def test_media_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op2_media_columns(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(text), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        stored = encode_png(np.frombuffer(payload, np.uint8).reshape(-1, 576))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(payload) < 20_000:
            assert r["feature"] == slow_feature(np.frombuffer(payload, np.uint8).reshape(-1, 576))
