import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import near


def brute(image, width, height):
    def cell(gx, gy):
        x0, y0 = gx * width // 9, gy * height // 8
        x1, y1 = max(x0 + 1, (gx + 1) * width // 9), max(y0 + 1, (gy + 1) * height // 8)
        values = [image[y * width + x] for y in range(y0, y1) for x in range(x0, x1)]
        return sum(values) / len(values)

    bits = "".join("1" if cell(x, y) < cell(x + 1, y) else "0" for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


@pytest.mark.parametrize(("width", "height"), [(8, 8), (9, 8), (18, 10)])
def test_dhash(value, width, height):
    image = [100 + 40 * math.sin((x + 1) / 2) + 20 * math.cos(y * 3) for y in range(height) for x in range(width)]
    got = value(hashing.dhash(F.array(*[F.lit(x) for x in image]), width, height))
    assert got == brute(image, width, height)
    assert got == value(hashing.dhash(F.array(*[F.lit(x + 40) for x in image]), width, height))


def test_dhash_errors(value):
    with pytest.raises(ValueError, match="pixels"):
        hashing.dhash(F.array(F.lit(1)), 0, 8)
    with pytest.raises(Exception, match="too short"):
        value(hashing.dhash(F.array(F.lit(1)), 8, 8))


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("0" * 16, "0" * 15 + "1", 1), ("0" * 16, "0" * 15 + "f", 4), ("0" * 16, "f" * 16, 64), ("", "", 64), ("abcd", "abcdef", 64), ("zzzz", "0000", 64)],
)
def test_hamming(value, a, b, expected):
    assert value(hashing.hamming(F.lit(a), F.lit(b))) == expected


def cache(spark, rows, **options):
    frames = spark.createDataFrame([(1, k, h, s) for k, (h, s) in enumerate(rows)], "video_id long, arrival long, hash string, score double")
    return [(r.score, r.inherited) for r in near.cached_scores(frames, **options).orderBy("arrival").collect()]


def test_cache_hits_nearest(spark):
    zero, three, near_, far = ("8" + "0" * 13 + x for x in ("00", "07", "0e", "ff"))
    assert cache(spark, [(zero, 0.1), (three, 0.9)]) == [(0.1, False), (0.1, True)]
    assert cache(spark, [(zero, 0.1), (far, 0.9)])[1] == (0.9, False)
    assert cache(spark, [(zero, 0.1), (far, 0.5), (near_, 0.9)], threshold=5)[2] == (0.1, True)
    assert cache(spark, [(three, 0.1), (three, 0.5), (three, 0.9)], threshold=0)[2] == (0.1, True)


def test_cache_forgets_the_oldest(spark):
    h = lambda k: f"{0x8000000000000000 | (0xFFFF << (16 * k)):016x}"
    rows = [(h(0), 0.0), (h(1), 0.1), (h(2), 0.2), (h(0), 0.3)]
    assert cache(spark, rows, threshold=0, capacity=2)[3] == (0.3, False)
    assert cache(spark, rows, threshold=0, capacity=3)[3] == (0.0, True)
    assert cache(spark, [("0" * 16, 0.4), ("0" * 16, 0.5)]) == [(0.4, False), (0.5, False)]


def test_one_video_streams_past_its_cache(spark):
    """A long video and others, whose frames come in any order, against a fold over each."""
    import random

    from tidemark.operators.near import Cache

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = [(v, k, f"{rng.choice(base) ^ (1 << rng.randrange(64)):016x}", rng.random()) for v, n in ((1, 3000), (2, 50), (3, 50)) for k in range(n)]
    want = set()
    for v in (1, 2, 3):
        own = Cache(6, 24)
        want |= {(v, k, *own.judge(int(h, 16), s)) for w, k, h, s in rows if w == v}
    rng.shuffle(rows)
    frames = spark.createDataFrame(rows, "video_id long, arrival long, hash string, score double").repartition(5)
    assert {tuple(r) for r in near.cached_scores(frames).collect()} == want


def test_luma(value):
    assert value(hashing.luma(F.lit(100.0), F.lit(50.0), F.lit(10.0))) == pytest.approx(29.9 + 29.35 + 1.14)
    image = value(hashing.luma_image(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 255, 10, 20, 30, 0)])))
    assert image == pytest.approx([0.299 + 1.174 + 0.342, 2.99 + 11.74 + 3.42])
    assert value(hashing.usable(F.lit("0" * 16))) is False and value(hashing.usable(F.lit(None).cast("string"))) is False


def test_tables_of_near_pairs_read_more_bits_of_more_hashes():
    for count in (10, 10**4, 10**6, 10**9):
        tables = near.key_tables(6, count)
        assert all(sum(w for _, w in t) >= min(32, math.log2(count / 8)) - 1e-9 for t in tables) or count == 10
        rng = __import__("random").Random(count)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 6))
            assert any(all(not flips >> shift & ((1 << width) - 1) for shift, width in t) for t in tables)


@pytest.mark.parametrize("meet", [8, 0.001])
def test_near_pairs_match_all_pairs(spark, monkeypatch, meet):
    monkeypatch.setattr(near, "MEET", meet)
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    every = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:5]
    rows = spark.createDataFrame([(k, f"{x:016x}") for k, x in enumerate(every)], "frame_id long, hash string")
    got = {(r.hash_a, r.hash_b): r.distance for r in near.near_pairs(rows, 6).collect()}
    distinct = sorted({f"{x:016x}" for x in every})
    want = {(a, b): d for a in distinct for b in distinct if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 6}
    assert got == want and want
    assert near.near_pairs(rows, 6).count() == len(want)
