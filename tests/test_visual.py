"""Visual channels against loops over pixels."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.operators import raster
from weftline.plans import visual

RNG = np.random.default_rng(11)


def some_boxes(n, seed):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.integers(-60, 1270, n), rng.integers(-40, 790, n), rng.integers(0, 500, n), rng.integers(0, 300, n), rng.integers(0, 256, (n, 3))])


def pixels(boxes):
    out = np.full((raster.HEIGHT, raster.WIDTH, 3), 255, np.uint8)
    for x, y, w, h, *colour in boxes.tolist():
        out[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = colour
    return out


@pytest.mark.parametrize("n", [0, 1, 40])
def test_pictures_equal_painted_and_resampled_pixels(n):
    boxes = some_boxes(n, n)
    p, full = raster.Picture(boxes), pixels(boxes)
    gray = (full.astype(int) @ np.array([19595, 38470, 7471]) + 32768) >> 16
    for width, height in ((32, 32), (17, 16), (320, 200)):
        want = np.floor(np.clip(raster.lanczos(800, height) @ gray @ raster.lanczos(1280, width).T, 0, 255) + 0.5 + 1e-9)
        assert np.abs(p.gray_sized((width, height)) - want).max() <= 1 and (p.gray_sized((width, height)) == want).mean() > 0.9999
    assert p.rgb_sized((128, 80)).shape == (80, 128, 3)


def test_resampling_weights_follow_the_window():
    w = raster.lanczos(8, 4)
    for j in range(4):
        raw = []
        for i in range(8):
            t = (i + 0.5 - (j + 0.5) * 2) / 2
            raw.append(0 if abs(t) >= 3 else 1 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2)
        assert w[j] == pytest.approx(np.array(raw) / sum(raw))


def loop_edges(gray):
    h, w = gray.shape
    at = lambda r, c: gray[min(max(r, 0), h - 1), min(max(c, 0), w - 1)]  # noqa: E731  one pixel beyond the border is the border
    out = [[0.0] * 8 for _ in range(16)]
    for r in range(h):
        for c in range(w):
            gx = sum(k * (at(r + d, c + 1) - at(r + d, c - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(r + 1, c + d) - at(r - 1, c + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            if gx or gy:
                if gy < 0 or gy == 0 and gx < 0:
                    gx, gy = -gx, -gy
                if gx == gy or gx == 0 or gx == -gy or gy == 0:  # the exact bounds belong above
                    b = 0 if gy == 0 else 2 if gx == gy else 4 if gx == 0 else 6
                else:
                    b = int(math.degrees(math.atan2(gy, gx)) // 22.5)
                out[r * 4 // h * 4 + c * 4 // w][b] += math.hypot(gx, gy)
    return np.array([x / (sum(row) or 1) for row in out for x in row])


def test_edges_equal_a_loop():
    for gray in (raster.Picture(some_boxes(25, 3)).gray_sized((320, 200)), RNG.integers(0, 256, (200, 320)).astype(float), np.full((200, 320), 7.0)):
        got = raster.edge_histogram(gray)
        assert got.shape == (128,) and got == pytest.approx(loop_edges(gray), abs=1e-9)


def test_structural_similarity_equals_a_window_loop():
    pictures = [RNG.integers(0, 256, (12, 15)).astype(float) for _ in range(6)] + [np.full((12, 15), 9.0)]
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    for x in pictures:
        for y in pictures[:3] + pictures[-1:]:
            values = []
            for r in range(12 - 6):
                for c in range(15 - 6):
                    a, b = x[r : r + 7, c : c + 7].ravel(), y[r : r + 7, c : c + 7].ravel()
                    va, vb, cov = a.var(ddof=1), b.var(ddof=1), np.cov(a, b)[0, 1]
                    values.append((2 * a.mean() * b.mean() + c1) * (2 * cov + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (va + vb + c2)))
            assert raster.similarity(raster.Windows(x), raster.Windows(y)) == pytest.approx(min(max((np.mean(values) + 1) / 2, 0), 1), abs=1e-9)


def test_palette_is_the_double_sum():
    k = raster.palette_kernel()
    a, b = (raster.palette_histogram(raster.Picture(some_boxes(12, s)).rgb_sized((128, 80))) for s in (1, 2))
    form = lambda x, y: sum(x[i] * k[i, j] * y[j] for i in range(144) for j in range(144))
    va, vb = a @ raster.palette_factor(), b @ raster.palette_factor()
    assert raster.cosines(np.stack([va, vb]))[0, 1] == pytest.approx(form(a, b) / math.sqrt(form(a, a) * form(b, b)), abs=1e-9)
    assert a.sum() == pytest.approx(1) and raster.lab(np.array([255.0, 255, 255])) == pytest.approx([100, 0, 0], abs=0.02)
    assert raster.palette_histogram(np.full((2, 2, 3), 255.0)).argmax() // 36 == 3


def test_hashes():
    flat = raster.transform_bits(np.full((32, 32), 5.0))
    assert flat.sum() == 1 and flat[0]  # all but the first coefficient are their median
    n, gray = 32, RNG.integers(0, 256, (32, 32)).astype(float)
    c = [[sum(gray[y, x] * math.cos(math.pi * (2 * x + 1) * u / 64) * math.cos(math.pi * (2 * y + 1) * v / 64) for y in range(n) for x in range(n)) * (1 / math.sqrt(n) if u == 0 else math.sqrt(2 / n)) * (1 / math.sqrt(n) if v == 0 else math.sqrt(2 / n)) for u in range(8)] for v in range(8)]
    low = np.array(c).ravel()
    assert (raster.transform_bits(gray) == (low > np.median(low))).all()
    assert raster.neighbour_bits(np.array([[1.0, 2, 2, 0]])).tolist() == [True, False, False]


def test_pairs_of_a_batch():
    same = some_boxes(9, 5).tolist()
    rows = [(0, "c0", 0, 4, same), (0, "c1", 1, 1, same), (0, "c0", 0, 2, some_boxes(9, 6).tolist()), (0, "c1", 1, 3, None)]
    table = pa.Table.from_pylist([dict(zip(("batch", "config", "config_ord", "slot", "boxes"), r)) for r in rows])
    got = {(r["slot_a"], r["slot_b"], r["channel"]): r for r in raster.batch_pairs(table).to_pylist()}
    assert len(got) == 6 * 7 and {k[:2] for k in got} == {(2, 4), (2, 1), (2, 3), (4, 1), (4, 3), (1, 3)}
    assert all(got[4, 1, c]["s"] == 1 for c in raster.CHANNELS) and got[2, 4, "v-edge"]["kind"] == "self"
    assert got[1, 3, "v-edge"]["s"] is None and 0 < got[1, 3, "v-layout"]["s"] < 1  # a white page has no edges


@pytest.mark.parametrize(("digits", "radius"), [(16, 3), (64, 7), (16, 4)])
def test_near_signatures_are_all_pairs_within_the_radius(spark, digits, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(4 * digits) for _ in range(40)]
    for v in values[:30]:
        for _ in range(4):
            x = v
            for k in rng.sample(range(4 * digits), rng.randint(0, radius + 2)):
                x ^= 1 << k
            values.append(x)
    rows = [(f"{v:0{digits}x}",) for v in values] + [(None,)] * 3
    got = {(r.hash_a, r.hash_b): (r.n_a, r.n_b, r.distance) for r in visual.near_signatures(spark.createDataFrame(rows, "h string"), "h", radius).collect()}
    kinds = sorted({v for v, in rows if v})
    count = {k: sum(r[0] == k for r in rows) for k in kinds}
    want = {(a, b): (count[a], count[b], d) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    assert got == want and len(want) > 50


def test_scalars_of_painted_pages():
    table = pa.table({"slot": [1, 2, 3], "boxes": [None, [[0, 0, 1280, 400, 255, 0, 0]], [[0, 0, 640, 800, 0, 0, 0]]]})
    rows = raster.page_scalars(table).to_pylist()
    got = {(r["slot"], r["scalar"]): r["v"] for r in rows}
    assert len(got) == 12 and [got[1, s] for s in ("colorfulness", "brightness", "contrast", "whitespace_ratio")] == pytest.approx([0, 255, 0, 1], abs=1e-6)
    # half red, half white, but for the rows that resampling blends at the border
    assert got[2, "brightness"] == pytest.approx((0.299 * 255 + 255) / 2, rel=5e-3) and got[2, "whitespace_ratio"] == pytest.approx(0.5, abs=0.03)
    red = np.hypot(127.5, 63.75) + 0.3 * np.hypot(127.5, 63.75)
    assert got[2, "colorfulness"] == pytest.approx(red, rel=2e-2)
    assert got[3, "contrast"] == pytest.approx(127.5, rel=1e-2) and got[3, "colorfulness"] == pytest.approx(0, abs=1e-6)


def test_each_two_pictures_are_compared_once(spark, monkeypatch):
    """Pages of one picture share its scores: three batches of the same pages are no more work than one of them."""
    boxes = [some_boxes(9, 5).tolist(), some_boxes(9, 5).tolist(), some_boxes(9, 6).tolist(), None]
    rows = [(b, f"c{i % 2}", i % 2, 10 * b + i, x) for b in range(3) for i, x in enumerate(boxes)]
    pages = spark.createDataFrame([(*r, repr(r[4])) for r in rows], "batch long, config string, config_ord int, slot long, boxes array<array<long>>, picture string")
    count = spark.sparkContext.accumulator(0)
    scores = raster.picture_scores

    def counted(pairs, pictures):
        count.add(pairs.num_rows)
        return scores(pairs, pictures)

    monkeypatch.setattr(raster, "picture_scores", counted)
    pictures = pages.groupBy("picture").agg({"boxes": "first"}).withColumnRenamed("first(boxes)", "boxes")
    got = {(r.slot_a, r.slot_b, r.channel): r.s for r in visual.visual_pairs(pages, pictures).collect()}
    assert count.value == 6  # three pictures, with themselves too
    want = {}
    for b in range(3):
        table = pa.Table.from_pylist([dict(zip(("batch", "config", "config_ord", "slot", "boxes"), r)) for r in rows if r[0] == b])
        want |= {(r["slot_a"], r["slot_b"], r["channel"]): r["s"] for r in raster.batch_pairs(table).to_pylist()}
    assert got == want
