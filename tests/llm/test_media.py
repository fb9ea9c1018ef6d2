import hashlib
import math
import zlib

import numpy as np
import pytest

from vecloom.llm import media


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("height", [1, 2, 37])
def test_every_filter(kind, height):
    image = np.random.default_rng(kind).integers(0, 256, (height, 64)).astype(np.uint8)
    assert (media.read_png(media.write_png(image, kind)) == image).all()


def test_mixed_filters():
    image = np.random.default_rng(1).integers(0, 256, (40, 64)).astype(np.uint8)
    rows = np.empty((40, 65), np.uint8)
    padded = np.zeros((41, 65), np.int16)
    padded[1:, 1:] = image
    for y in range(40):
        kind = (y * 7) % 5
        guess = media._predicted(kind, padded[y + 1 : y + 2, :-1], padded[y : y + 1, 1:], padded[y : y + 1, :-1])
        rows[y] = [kind, *(image[y].astype(np.int16) - guess[0]).astype(np.uint8)]
    assert (media.unfilter(rows, np.array([0])) == image).all()
    assert (media.unfilter(np.concatenate([rows, rows[:7], rows]), np.array([0, 40, 47])) == np.concatenate([image, image[:7], image])).all()


def test_rows_choose_their_filters():
    """Against choosing row by row in plain Python; all five filters are undone together."""
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:60, :64]
    smooth = (128 + 100 * np.sin(x / 9 + y / 5)).astype(np.uint8)
    image = np.concatenate([smooth, rng.integers(0, 256, (30, 64)).astype(np.uint8), np.tile(rng.integers(0, 256, 64), (20, 1)).astype(np.uint8), np.frombuffer(b"some plain text " * 80, np.uint8).reshape(-1, 64)])
    rows = media.filtered(image)
    assert len(set(rows[:, 0].tolist())) >= 4
    kinds = [media.filtered(image, k) for k in range(5)]
    cost = lambda row: sum(min(int(v), 256 - int(v)) for v in row[1:])
    for i, row in enumerate(rows):
        assert cost(row) == min(cost(k[i]) for k in kinds)
    assert (media.unfilter(rows, np.array([0])) == image).all()


def test_given_texts_use_filters_that_look_up():
    import pyarrow.parquet as pq

    kinds = np.zeros(5, np.int64)
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        kinds += np.bincount(media.rows_of(media.write_png(np.frombuffer(media.payload(t), np.uint8).reshape(-1, 64)))[:, 0], minlength=5)
    assert kinds[1:].sum() > 0.9 * kinds.sum() and kinds[3:].sum() > 0.2 * kinds.sum()


def test_feature_against_a_plain_cosine_transform():
    def mean(values, n):
        return [values[i * len(values) // n] if len(values) <= n else sum(v := values[i * len(values) // n : (i + 1) * len(values) // n]) / len(v) for i in range(n)]

    rng = np.random.default_rng(8)
    for height in (1, 5, 32, 70):
        image = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        columns = [mean([float(v) for v in image[:, x]], 32) for x in range(64)]
        small = [mean([columns[x][y] for x in range(64)], 32) for y in range(32)]
        low = [sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * i / 64) * math.cos(math.pi * (2 * x + 1) * j / 64) for y in range(32) for x in range(32)) for i in range(8) for j in range(8)]
        low = [0.0] + [round(v, 6) for v in low[1:]]
        middle = sorted(low[1:])[31]
        assert media.cosine_hash(image) == f"{int(''.join('1' if v > middle else '0' for v in low), 2):016x}"


def test_chunks_and_damage():
    image = np.random.default_rng(2).integers(0, 256, (3000, 64)).astype(np.uint8)
    png = media.write_png(image)
    assert png.count(b"IDAT") >= 2 and (media.read_png(png) == image).all()
    for bad in (png[:50], png[:-6], png[:100] + bytes([png[100] ^ 1]) + png[101:], b"x" + png[1:], b""):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_feature_follows_the_picture():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:256, :64]
    waves = sum(rng.normal() * np.cos(np.pi * (2 * y + 1) * i / 512) * np.cos(np.pi * (2 * x + 1) * j / 128) for i in range(8) for j in range(8))
    image = np.clip(128 + 60 * waves / waves.std() / 2, 0, 255).astype(np.uint8)
    noisy = np.clip(image + rng.normal(0, 3, image.shape), 0, 255).astype(np.uint8)
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    assert apart(media.cosine_hash(image), media.cosine_hash(noisy)) <= 8
    assert apart(media.cosine_hash(image), media.cosine_hash(255 - image)) >= 48
    assert len(media.cosine_hash(np.zeros((1, 64), np.uint8))) == 16


def test_rows(spark, odd, odd_rows, nothing):
    stored = media.store(odd)
    assert stored.columns == ["doc_id", "n_bytes", "media"] and dict(stored.dtypes)["media"] == "binary"
    pngs = {}
    for r in stored.collect():
        pngs.setdefault(hashlib.sha256(bytes(r["media"])).hexdigest(), bytes(r["media"]))
    got = {}
    for r in media.read_back(stored).collect():
        got.setdefault((r["doc_id"], r["payload_sha256"]), []).append(r)
    for i, t in odd_rows:
        raw = (t or "").encode()
        put = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = got[i, hashlib.sha256(put).hexdigest()].pop()
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(put), zlib.crc32(put[-64:]))
        png = pngs[r["media_sha256"]]
        assert r["media_bytes"] == len(png) and media.read_png(png).tobytes() == put
        assert r["feature"] == media.cosine_hash(np.frombuffer(put, np.uint8).reshape(-1, 64))
    assert not any(got.values())
    assert media.read_back(media.store(nothing)).count() == 0


def test_null_media_raise(spark):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="no media"):
        media.read_back(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).collect()
