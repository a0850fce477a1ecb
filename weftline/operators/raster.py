"""Pages as pictures: boxes painted in order, resampled to the sizes of the visual channels, and their likeness.

A picture of boxes is constant between the boxes' edges, so it is painted on the grid of these edges only. Resampling is
a product of two fixed matrices whose columns are summed between edges first: its cost doesn't depend on the viewport.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The viewport, gray weights in 65536ths, the sizes of the channels' pictures.
WIDTH, HEIGHT = 1280, 800
GRAY = (19595, 38470, 7471)
#: The weights of colours in gray, as shares.
REC601 = (0.299, 0.587, 0.114)
HASH_SIDE, HASH_BLOCK, NEIGHBOURS, GRAYS, GRID, COLOURS = 32, 8, (17, 16), (320, 200), (32, 20), (128, 80)
#: Cells and directions of edges, window and constants of structural similarity.
CELLS, DIRECTIONS = (4, 4), 8
SSIM_WINDOW, SSIM_K, SSIM_RANGE = 7, (0.01, 0.03), 255
#: Bins of lightness, a and b with their bounds, the width of the palette's kernel, sRGB to XYZ and its white.
LAB_BINS, LAB_BOUNDS, SIGMA = (4, 6, 6), ((0, 100), (-110, 110), (-110, 110)), 10.0
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
D65 = np.array([0.95047, 1.0, 1.08883])
CHANNELS = ("v-phash", "v-dhash", "v-color", "v-palette", "v-layout", "v-edge", "v-ssim")


@lru_cache(maxsize=64)
def lanczos(n_in: int, n_out: int) -> np.ndarray:
    """The matrix that resamples ``n_in`` values to ``n_out`` with a three-lobed windowed sinc; rows sum to one."""
    scale = n_in / n_out
    reach = max(scale, 1.0)
    at = (np.arange(n_in)[None] + 0.5 - (np.arange(n_out)[:, None] + 0.5) * scale) / reach
    weight = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0.0)
    return weight / weight.sum(1, keepdims=True)


@lru_cache(maxsize=64)
def _up_to(n_in: int, n_out: int) -> np.ndarray:
    return np.concatenate([np.zeros((n_out, 1)), np.cumsum(lanczos(n_in, n_out), 1)], 1)


class Picture:
    """Boxes ``x, y, w, h, red, green, blue`` painted in their order on white; what is outside the viewport is cut off."""

    def __init__(self, boxes: np.ndarray):
        boxes = np.asarray(boxes, np.int64).reshape(-1, 7)
        x0, x1 = np.clip(boxes[:, 0], 0, WIDTH), np.clip(boxes[:, 0] + boxes[:, 2], 0, WIDTH)
        y0, y1 = np.clip(boxes[:, 1], 0, HEIGHT), np.clip(boxes[:, 1] + boxes[:, 3], 0, HEIGHT)
        self.xs, self.ys = np.unique([0, WIDTH, *x0, *x1]), np.unique([0, HEIGHT, *y0, *y1])
        self.rgb = np.full((len(self.ys) - 1, len(self.xs) - 1, 3), 255, np.uint8)
        left, right, top, bottom = (np.searchsorted(e, v) for e, v in ((self.xs, x0), (self.xs, x1), (self.ys, y0), (self.ys, y1)))
        for a, b, c, d, colour in zip(left, right, top, bottom, boxes[:, 4:], strict=True):
            self.rgb[c:d, a:b] = colour
        self.gray = (self.rgb.astype(np.int64) @ np.array(GRAY) + 0x8000 >> 16).astype(float)

    def sized(self, values: np.ndarray, width: int, height: int) -> np.ndarray:
        """Values of the grid resampled to whole numbers from 0 to 255."""
        across, down = _up_to(WIDTH, width), _up_to(HEIGHT, height)
        out = (down[:, self.ys[1:]] - down[:, self.ys[:-1]]) @ values @ (across[:, self.xs[1:]] - across[:, self.xs[:-1]]).T
        return np.floor(np.clip(out, 0, 255) + 0.5 + 1e-9)

    def gray_sized(self, size: tuple[int, int]) -> np.ndarray:
        return self.sized(self.gray, *size)

    def rgb_sized(self, size: tuple[int, int]) -> np.ndarray:
        return np.stack([self.sized(self.rgb[..., k].astype(float), *size) for k in range(3)], -1)


@lru_cache(maxsize=4)
def cosine_transform(n: int) -> np.ndarray:
    k = np.arange(n)
    out = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def transform_bits(gray: np.ndarray) -> np.ndarray:
    """Which of the lowest 8 x 8 coefficients of a square picture's cosine transform are above their median."""
    c = cosine_transform(len(gray))[:HASH_BLOCK]
    low = np.round((c @ gray @ c.T).ravel(), 9)
    return low > np.median(low)


def neighbour_bits(gray: np.ndarray) -> np.ndarray:
    return (gray[:, 1:] > gray[:, :-1]).ravel()


def edge_histogram(gray: np.ndarray) -> np.ndarray:
    """Gradients by cell and direction, weighted by their length; each cell's sum is one, or zero where it is flat."""
    p = np.pad(gray, 1, "symmetric")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    angle = np.degrees(np.arctan2(gy, gx)) % 180.0 % 180.0
    direction = np.minimum(np.floor((angle + 1e-9) / (180 / DIRECTIONS)), DIRECTIONS - 1).astype(np.int64)
    direction[angle >= 180 - 1e-9] = 0
    rows = np.arange(gray.shape[0])[:, None] * CELLS[1] // gray.shape[0]
    cells = rows * CELLS[0] + np.arange(gray.shape[1])[None] * CELLS[0] // gray.shape[1]
    out = np.bincount((cells * DIRECTIONS + direction).ravel(), np.hypot(gx, gy).ravel(), CELLS[0] * CELLS[1] * DIRECTIONS).reshape(-1, DIRECTIONS)
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0).ravel()


def colour_histogram(rgb: np.ndarray) -> np.ndarray:
    """Shares of the 64 colours that two bits of red, green and blue give."""
    level = (rgb.astype(np.int64) >> 6).reshape(-1, 3) @ np.array([16, 4, 1])
    return np.bincount(level, minlength=64) / len(level)


def lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t, d = linear @ TO_XYZ.T / D65, 6 / 29
    f = np.where(t > d**3, np.cbrt(t), t / (3 * d * d) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def palette_histogram(rgb: np.ndarray) -> np.ndarray:
    """Shares of 144 boxes of lightness, a and b; the upper bound belongs to the last box."""
    values, at = lab(rgb.reshape(-1, 3)), 0
    for k, (n, (lo, hi)) in enumerate(zip(LAB_BINS, LAB_BOUNDS, strict=True)):
        at = at * n + np.clip(np.floor((np.clip(values[:, k], lo, hi) - lo) / ((hi - lo) / n) + 1e-9).astype(np.int64), 0, n - 1)
    return np.bincount(at, minlength=int(np.prod(LAB_BINS))) / len(values)


def palette_kernel() -> np.ndarray:
    """How alike the middles of the boxes of colours are."""
    middle = [lo + (np.arange(n) + 0.5) * (hi - lo) / n for n, (lo, hi) in zip(LAB_BINS, LAB_BOUNDS, strict=True)]
    at = np.stack([x.ravel() for x in np.meshgrid(*middle, indexing="ij")], 1)
    return np.exp(-((at[:, None] - at[None]) ** 2).sum(2) / (2 * SIGMA**2))


@lru_cache(maxsize=1)
def palette_factor() -> np.ndarray:
    """The triangular matrix whose product with its transpose is the kernel: h1 K h2 is a dot product of h1 L and h2 L."""
    return np.linalg.cholesky(palette_kernel())


def window_sums(x: np.ndarray, n: int = SSIM_WINDOW) -> np.ndarray:
    """Sums of all n x n windows inside a picture of whole numbers, four look-ups each in a table of sums."""
    table = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(x, 0), 1, out=table[1:, 1:])
    return table[n:, n:] - table[:-n, n:] - table[n:, :-n] + table[:-n, :-n]


class Windows:
    """A picture with the sums of its windows, so that a pair of pictures needs one more table only."""

    def __init__(self, gray: np.ndarray):
        self.x, n = gray.astype(np.int64), SSIM_WINDOW**2
        self.mean = window_sums(self.x) / n
        self.var = (window_sums(self.x * self.x) / n - self.mean**2) * (n / (n - 1))


def similarity(a: Windows, b: Windows) -> float:
    """Mean structural similarity over all windows, from [-1, 1] to [0, 1]."""
    n, c1, c2 = SSIM_WINDOW**2, (SSIM_K[0] * SSIM_RANGE) ** 2, (SSIM_K[1] * SSIM_RANGE) ** 2
    cov = (window_sums(a.x * b.x) / n - a.mean * b.mean) * (n / (n - 1))
    s = (2 * a.mean * b.mean + c1) * (2 * cov + c2) / ((a.mean**2 + b.mean**2 + c1) * (a.var + b.var + c2))
    return float(np.clip((s.mean() + 1) / 2, 0, 1))


def descriptors(boxes: np.ndarray) -> dict[str, np.ndarray]:
    """What each channel compares of one page."""
    p = Picture(boxes)
    gray, rgb = p.gray_sized(GRAYS), p.rgb_sized(COLOURS)
    return {
        "v-phash": transform_bits(p.gray_sized((HASH_SIDE, HASH_SIDE))), "v-dhash": neighbour_bits(p.gray_sized(NEIGHBOURS)), "v-color": colour_histogram(rgb),
        "v-palette": palette_histogram(rgb) @ palette_factor(), "v-layout": p.gray_sized(GRID).ravel(), "v-edge": edge_histogram(gray), "v-ssim": gray,
    }


def cosines(x: np.ndarray) -> np.ndarray:
    """Of all pairs of rows, in [0, 1]; equal rows exactly 1, NaN where a row is zero."""
    norm = np.sqrt((x * x).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.clip(x @ x.T / norm / norm[:, None], 0, 1)
    _, kind = np.unique(x, axis=0, return_inverse=True)
    out[(kind[:, None] == kind[None]) & (norm > 0)[None]] = 1.0
    return out


def _boxes(column) -> list[np.ndarray]:
    return [np.array(x or [], np.int64).reshape(-1, 7) for x in column.to_pylist()]


def page_signatures(table: pa.Table, key: str = "slot") -> pa.Table:
    """``key, phash, dhash, edge, layout, color`` of pages ``key, boxes``."""
    found = [descriptors(b) for b in _boxes(table.column("boxes"))]
    bits = lambda c: pa.array([np.packbits(d[c]).tobytes().hex() for d in found], pa.string())
    values = lambda c: pa.array([np.round(d[c], 9).tolist() for d in found], pa.list_(pa.float64()))
    return pa.table({key: table.column(key), "phash": bits("v-phash"), "dhash": bits("v-dhash"), "edge": values("v-edge"), "layout": values("v-layout"), "color": values("v-color")})


def picture_scores(pairs: pa.Table, pictures: pa.Table) -> pa.Table:
    """``a, b, s`` of pairs ``a, b`` of pictures ``picture, boxes``: ``s`` has the scores of all channels in their order, null
    where a side has nothing to compare. All pictures of both sides are held at once."""
    pictures = pictures.sort_by("picture")
    at = {x: i for i, x in enumerate(pictures.column("picture").to_pylist())}
    a, b = (np.array([at[x] for x in pairs.column(c).to_pylist()], np.int64) for c in "ab")
    found = [descriptors(x) for x in _boxes(pictures.column("boxes"))]
    scores = np.zeros((len(a), len(CHANNELS)))
    for k, c in enumerate(CHANNELS[:2]):
        bits = np.stack([d[c] for d in found])
        scores[:, k] = 1 - (bits[a] != bits[b]).sum(1) / bits.shape[1]
    for k, c in enumerate(CHANNELS[2:6], 2):
        scores[:, k] = cosines(np.stack([d[c] for d in found]))[a, b]
    tables = [Windows(d["v-ssim"]) for d in found]
    scores[:, 6] = [similarity(tables[i], tables[j]) for i, j in zip(a, b, strict=True)]
    flat = np.round(scores, 6).ravel()
    s = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * len(CHANNELS), pa.int32()), pa.array(flat, mask=np.isnan(flat)))
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "s": s})


def page_pairs(pages: pa.Table, scores: pa.Table) -> pa.Table:
    """All pairs of one batch's pages in all channels, of the ``scores`` of their pictures; a batch has a fixed number of pages."""
    pages = pages.sort_by([("config_ord", "ascending"), ("slot", "ascending")])
    at = {x: i for i, x in enumerate(sorted(set(pages.column("picture").to_pylist())))}
    found = np.full((len(at), len(at), len(CHANNELS)), np.nan)
    a, b = (np.array([at[x] for x in scores.column(c).to_pylist()], np.int64) for c in "ab")
    found[a, b] = found[b, a] = pc.list_flatten(scores.column("s")).to_numpy().reshape(-1, len(CHANNELS))
    own = np.array([at[x] for x in pages.column("picture").to_pylist()], np.int64)
    a, b = np.triu_indices(len(own), 1)
    config, slot = pages.column("config").combine_chunks(), pages.column("slot").combine_chunks()
    x, y = config.take(pa.array(a)), config.take(pa.array(b))
    shared = {"batch": pa.array(np.full(len(a), pages.column("batch")[0].as_py()), pa.int64()), "config_a": x, "config_b": y, "kind": pc.if_else(pc.equal(x, y), "self", "cross"), "slot_a": slot.take(pa.array(a)), "slot_b": slot.take(pa.array(b))}
    each = found[own[a], own[b]]
    return pa.concat_tables([pa.table(shared | {"channel": pa.array([c] * len(a), pa.string()), "s": pa.array(each[:, k], mask=np.isnan(each[:, k]))}) for k, c in enumerate(CHANNELS)])


def batch_pairs(table: pa.Table) -> pa.Table:
    """All pairs of one batch's pages with their ``boxes`` in all channels."""
    names = pa.array([repr(x) for x in table.column("boxes").to_pylist()], pa.string())
    kinds = {x: b for x, b in zip(names.to_pylist(), table.column("boxes").to_pylist(), strict=True)}
    pictures = pa.table({"picture": list(kinds), "boxes": pa.array(list(kinds.values()), table.schema.field("boxes").type)})
    a, b = np.triu_indices(len(kinds))
    listed = pictures.column("picture").combine_chunks()
    return page_pairs(table.append_column("picture", names), picture_scores(pa.table({"a": listed.take(pa.array(a)), "b": listed.take(pa.array(b))}), pictures))


def page_scalars(table: pa.Table, key: str = "slot") -> pa.Table:
    """``key, scalar, v`` of pages ``key, boxes``: colourfulness by the spread and the mean of both opponent colours, mean
    and deviation of gray, and the share of the most frequent of 64 colours."""
    slots, names, values = [], [], []
    for slot, boxes in zip(table.column(key).to_pylist(), _boxes(table.column("boxes")), strict=True):
        rgb = Picture(boxes).rgb_sized(COLOURS).reshape(-1, 3)
        rg, yb, gray = rgb[:, 0] - rgb[:, 1], (rgb[:, 0] + rgb[:, 1]) / 2 - rgb[:, 2], rgb @ np.array(REC601)
        bins = np.bincount((rgb.astype(np.int64) >> 6) @ np.array([16, 4, 1]), minlength=64)
        found = {
            "colorfulness": np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()), "brightness": gray.mean(), "contrast": gray.std(), "whitespace_ratio": bins.max() / len(rgb),
        }
        slots += [slot] * len(found)
        names += found
        values += [float(x) for x in found.values()]
    return pa.table({key: pa.array(slots, table.schema.field(key).type), "scalar": pa.array(names, pa.string()), "v": pa.array(values, pa.float64())})
