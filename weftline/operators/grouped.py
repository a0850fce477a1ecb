"""Operators on small groups whose steps depend on each other: numpy inside Spark's grouped maps."""

from __future__ import annotations

import hashlib
import lzma
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.operators.features import KEY, dealt, in_batches

BT_ROUNDS = 200


def strengths(wins: np.ndarray, rounds: int = BT_ROUNDS) -> np.ndarray:
    """Bradley-Terry by minorization; wins[i, j] of i over j, a tie half each.

    Strengths are scaled to a geometric mean of 1 over those above 0: who never won has 0 and no part in the mean, who
    met nobody keeps 1 before scaling.
    """
    s, games, own = np.ones(len(wins)), wins + wins.T, wins.sum(1)
    for _ in range(rounds):
        pair = s[:, None] + s[None, :]
        met = np.divide(games, pair, out=np.zeros_like(pair), where=(games > 0) & (pair > 0)).sum(1)
        s = np.where(met > 0, own / np.where(met > 0, met, 1), s)
        if (s > 0).any():
            s = s / np.exp(np.log(s[s > 0]).mean())
    return s


def bradley_terry(votes: DataFrame) -> DataFrame:
    """``variant, config, strength`` of accepted votes; both-bad votes don't count.

    Votes are counted by pair first, so that a group has at most a row for each pair of configurations.
    """
    won = F.when(F.col("choice") == "a", 1.0).when(F.col("choice") == "tie", 0.5).otherwise(0.0)
    pairs = votes.filter("choice in ('a', 'b', 'tie')").groupBy("variant", "config_a", "config_b").agg(F.sum(won).alias("a"), F.count(F.lit(1)).alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["config_a"], *rows["config_b"]})
        at = {x: i for i, x in enumerate(names)}
        wins = np.zeros((len(names), len(names)))
        for a, b, w, n in zip(rows["config_a"], rows["config_b"], rows["a"], rows["n"], strict=True):
            wins[at[a], at[b]] += w
            wins[at[b], at[a]] += n - w
        return pd.DataFrame({"variant": rows["variant"].iloc[0], "config": names, "strength": np.round(strengths(wins), 6)})

    return pairs.groupBy("variant").applyInPandas(fit, "variant string, config string, strength double")


def leaf_order(distance: np.ndarray) -> list[int]:
    """Average-linkage clustering; a merged cluster goes behind all others, and of equal distances the first pair wins."""
    leaves, d = [[i] for i in range(len(distance))], np.array(distance, float)
    while len(leaves) > 1:
        upper = np.where(np.triu(np.ones(d.shape, bool), 1), d, np.inf)
        a, b = divmod(int(upper.argmin()), len(leaves))
        rest = [k for k in range(len(leaves)) if k not in (a, b)]
        n, m = len(leaves[a]), len(leaves[b])
        merged = (n * d[a, rest] + m * d[b, rest]) / (n + m)
        d = np.block([[d[np.ix_(rest, rest)], merged[:, None]], [merged[None], np.zeros((1, 1))]])
        leaves = [leaves[k] for k in rest] + [leaves[a] + leaves[b]]
    return leaves[0] if leaves else []


def upgma_order(cells: DataFrame, missing: float = 0.6) -> DataFrame:
    """``batch, channel, config, place``: the leaves of each matrix; the distance is 1 - median, ``missing`` if unknown."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["config_a"], *rows["config_b"]})
        at = {x: i for i, x in enumerate(names)}
        d = np.full((len(names), len(names)), missing)
        for a, b, m in zip(rows["config_a"], rows["config_b"], rows["median"], strict=True):
            if m is not None and not np.isnan(m):
                d[at[a], at[b]] = d[at[b], at[a]] = round(1 - m, 9)
        return pd.DataFrame({"batch": rows["batch"].iloc[0], "channel": rows["channel"].iloc[0], "config": [names[i] for i in leaf_order(d)], "place": np.arange(len(names))})

    return cells.filter("kind = 'cross'").groupBy("batch", "channel").applyInPandas(order, "batch long, channel string, config string, place long")


#: Earlier places that a search of LZMA's preset 6 looks at, at most.
SEARCHED = 48


def dictionary(n: int) -> int:
    """Bytes of LZMA's dictionary for ``n`` bytes that give the size of its preset, of 8 MB. A smaller one also deals the places
    to fewer lists, so that a search that ends at SEARCHED places may miss another match, though all are within reach."""
    return 1 << 16 if n <= SEARCHED else 1 << 23


def compressed(x: str) -> int:
    data = x.encode()
    return len(lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": dictionary(len(data))}]))


def compression_similarity(x: str, y: str, cx: int, cy: int) -> float:
    """One less the normalized compression distance of two texts with their sizes alone, the mean of both orders."""
    d = np.mean([(compressed(p + q) - min(cx, cy)) / max(cx, cy) for p, q in ((x, y), (y, x))])
    return round(1 - float(min(max(d, 0.0), 1.0)), 6)


def compression_distance(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """``slot_a, slot_b, s`` of given pairs; null where a side has no text."""

    def alone(a: pd.Series) -> pd.Series:
        return a.map(lambda x: compressed(unicodedata.normalize("NFC", x)) if x else None).astype("Int64")

    def similarity(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([compression_similarity(unicodedata.normalize("NFC", x), unicodedata.normalize("NFC", y), cx, cy) if x and y else None for x, y, cx, cy in zip(a, b, n, m, strict=True)], dtype="float64")

    text = cards.select("slot", "html", F.pandas_udf(alone, "long")("html").alias("n"))  # each text alone once
    side = lambda s: text.select(F.col("slot").alias(f"slot_{s}"), F.col("html").alias(s), F.col("n").alias(f"n_{s}"))
    joined = pairs.join(side("a"), "slot_a").join(side("b"), "slot_b")
    return joined.select("slot_a", "slot_b", F.pandas_udf(similarity, "double")("a", "b", "n_a", "n_b").alias("s"))


def compression_pairs(cards: DataFrame) -> DataFrame:
    """:func:`compression_distance` of each two slots of a batch: a text travels once, and not with each of its pairs."""

    def score(table: pa.Table, a: np.ndarray, b: np.ndarray) -> dict[str, pa.Array]:
        texts = [unicodedata.normalize("NFC", x) if x else None for x in table.column("html").to_pylist()]
        n = [compressed(x) if x else 0 for x in texts]
        return {"s": pa.array([compression_similarity(texts[i], texts[j], n[i], n[j]) if n[i] and n[j] else None for i, j in zip(a, b, strict=True)], pa.float64())}

    return in_batches(cards.select(*KEY, "html"), score, "s double").select("slot_a", "slot_b", "s")


def pooled_permutation(blocks: DataFrame, draws: int = 10_000, seed: int = 20_240_101) -> DataFrame:
    """``family, t_obs, p``: signs of block differences drawn anew ``draws`` times; p = (hits + 1) / (draws + 1).

    A hash of seed, 64 draws, unit and block gives a sign to each of them, so that each task adds up its own blocks and
    only a sum for each family and draw is shuffled.
    """
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * odd[1]
        x = (x ^ (x >> np.uint64(27))) * odd[2]
        return x ^ (x >> np.uint64(31))

    words = -(-draws // 64)
    drawn = np.arange(words, dtype=np.uint64) * odd[0]

    def sums(frames):
        held: dict = {}  # of all that the task reads: a sum for each family and draw
        for rows in frames:
            with np.errstate(over="ignore"):
                each = mixed(rows["unit"].to_numpy(np.uint64) * odd[0] + rows["block"].to_numpy(np.uint64) + np.uint64(seed))
                for family, at in rows.groupby("family").indices.items():
                    d, t = rows["d"].to_numpy(float)[at], np.zeros(64 * words)
                    for i in range(0, len(at), 512):
                        part = at[i : i + 512]
                        sign = np.unpackbits(mixed(each[part][:, None] + mixed(drawn)[None]).astype("<u8").view(np.uint8), axis=1)
                        t += (2 * d[i : i + 512]) @ sign
                    so_far, n = held.get(family, (np.zeros(draws + 1), 0))
                    held[family] = so_far + np.append(d.sum(), t[:draws] - d.sum()), n + len(d)
        for family, (t, n) in held.items():
            yield pd.DataFrame({"family": family, "draw": np.arange(-1, draws), "t": t, "n": n})

    parts = blocks.select((F.col("unit") % 16).alias("family"), "unit", "block", (F.col("run_q") - F.col("run_min")).alias("d")).filter("d is not null")
    total = dealt(parts, "unit").mapInPandas(sums, "family long, draw long, t double, n long").groupBy("family", "draw").agg(F.round(F.sum("t"), 9).alias("t"), F.sum("n").alias("n"))
    # a window over the sums: read twice, they would be made twice
    seen = F.max(F.when(F.col("draw") < 0, F.col("t"))).over(Window.partitionBy("family")).alias("t_obs")
    hits = total.select("family", "draw", F.abs("t").alias("t"), seen, "n").filter("draw >= 0").groupBy("family", "t_obs", "n").agg(F.sum((F.col("t") >= F.abs("t_obs") - 1e-9).cast("int")).alias("hits"))
    return hits.select("family", F.round(F.col("t_obs") / F.col("n"), 6).alias("t_obs"), F.round((F.col("hits") + 1) / (draws + 1), 6).alias("p"))


def balanced(n: int) -> list[int]:
    """The bit strings of ``n`` blocks, ascending, in which both orders are as frequent or differ by one."""
    if not 0 < n <= 20:
        raise ValueError("1 to 20 blocks")
    return [x for x in range(1 << n) if abs(n - 2 * x.bit_count()) <= 1]


def assignment_table(configs: DataFrame) -> DataFrame:
    """``config_ord, config_id, seed_assign, omega_size, rank, omega_value, bits`` of ``manifest_hash, config_ord, config_id, n``.

    The seed is the first eight bytes, little-endian, of SHA-256 over the separated fields; each configuration draws one
    rank from a PCG64 stream of its own. bits has the leading bit of the value first.
    """

    def draw(frames):
        for rows in frames:
            out = []
            for r in rows.itertuples(index=False):
                payload = b"\0".join((b"assign", bytes.fromhex(r.manifest_hash), unicodedata.normalize("NFC", r.config_id).encode(), bytes([r.n])))
                seed, omega = int.from_bytes(hashlib.sha256(payload).digest()[:8], "little"), balanced(r.n)
                rank = int(np.random.Generator(np.random.PCG64(seed)).integers(0, len(omega)))
                out.append((r.manifest_hash, r.config_ord, r.config_id, str(seed), len(omega), rank, omega[rank], f"{omega[rank]:0{r.n}b}"))
            yield pd.DataFrame(out, columns=["manifest_hash", "config_ord", "config_id", "seed_assign", "omega_size", "rank", "omega_value", "bits"])

    return configs.select("manifest_hash", "config_ord", "config_id", "n").mapInPandas(draw, "manifest_hash string, config_ord int, config_id string, seed_assign string, omega_size int, rank int, omega_value int, bits string")


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row in a least-cost assignment (shortest augmenting paths); rows at most columns.

    Costs may be whole numbers of any size (an array of objects), and are exact then.
    """
    n, m = cost.shape
    u, v, match = np.zeros(n + 1, cost.dtype), np.zeros(m + 1, cost.dtype), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf, cost.dtype), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.where(used[1:], np.inf, low[1:]).argmin())
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def first_assignment(cost: np.ndarray) -> list[int]:
    """Among all least-cost assignments the lexicographically least; ``cost`` in whole numbers.

    The columns of an assignment, as digits of one number, are added below the last place of the costs.
    """
    n, m = cost.shape
    base = m + 1
    return assignment(np.array([[int(cost[i, j]) * base**n + j * base ** (n - 1 - i) for j in range(m)] for i in range(n)], object).reshape(n, m))


#: Points up to which all choices among each point's cheapest hours are compared.
FEW = 5


def first_assignments(cost: np.ndarray) -> np.ndarray:
    """:func:`first_assignment` of many matrices of one shape (units, points, hours).

    With the columns added below the last place no two assignments cost the same, and in the best one each of n points
    has one of its n cheapest hours, as the others take n - 1 at most: for few points all such choices are compared.
    """
    n, m = cost.shape[1:]
    base = m + 1
    if n > FEW or n * (cost.max(initial=0) + 1) * float(base) ** n >= 2**62:
        return np.array([first_assignment(c) for c in cost], np.int64).reshape(len(cost), n)
    exact = cost.astype(np.int64) * base**n + np.arange(m) * base ** np.arange(n - 1, -1, -1)[:, None]
    near = np.argsort(exact, 2)[:, :, :n]
    first = np.sort(near[:, :, 0], 1)
    clash = (first[:, 1:] == first[:, :-1]).any(1)
    if not clash.all():  # each point has the hour it likes best
        hours = near[:, :, 0].copy()
        if clash.any():
            hours[clash] = first_assignments(cost[clash])
        return hours
    least = np.take_along_axis(exact, near, 2)
    choice = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(n)] * n, indexing="ij")])
    best, hours = np.full(len(cost), np.iinfo(np.int64).max), np.zeros((len(cost), n), np.int64)
    for i in range(0, choice.shape[1], 625):
        c = choice[:, i : i + 625]
        at = near[:, np.arange(n)[:, None], c]
        total = least[:, np.arange(n)[:, None], c].sum(1)
        for x in range(n):
            for y in range(x):
                total[at[:, x] == at[:, y]] = np.iinfo(np.int64).max
        k = total.argmin(1)
        value = np.take_along_axis(total, k[:, None], 1)[:, 0]
        better = value < best
        best[better], hours[better] = value[better], np.take_along_axis(at, k[:, None, None], 2)[better, :, 0]
    return hours


def hourly_assignment(points: DataFrame) -> DataFrame:
    """``unit, point, hour, cost``: each point of a unit to an hour of its own, with the least sum of squares, counted in
    millionths; of equally good ones the first in the order of points and hours.

    A unit of more than 24 points has no such assignment: an error.
    """

    def solve(frames):
        for rows in frames:
            if rows["n"].max() > 24:
                at = int(rows["n"].to_numpy().argmax())
                raise ValueError(f"unit {rows['unit'].iloc[at]} has {rows['n'].iloc[at]} points for 24 hours")
            for n, at in rows.groupby("n").indices.items():
                for i in range(0, len(at), 256):
                    part = rows.iloc[at[i : i + 256]]
                    value = np.array([[p["value"] for p in ps] for ps in part["points"]], float)
                    cost = (value[:, :, None] - np.linspace(0, 97, 24)) ** 2
                    hour = first_assignments(np.rint(cost * 1e6))
                    yield pd.DataFrame({
                        "unit": np.repeat(part["unit"].to_numpy(), n), "point": [p["point"] for ps in part["points"] for p in ps], "hour": hour.ravel(),
                        "cost": np.round(np.take_along_axis(cost, hour[:, :, None], 2).ravel(), 6),
                    })

    listed = dealt(points, "unit").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("point", F.col("value").cast("double").alias("value")))).alias("points"), F.count(F.lit(1)).alias("n"))
    return listed.mapInPandas(solve, "unit long, point long, hour long, cost double")


def visual_signatures(vectors: DataFrame) -> DataFrame:
    """``vec_id, phash, dhash, mean, edge``: an 8 x 8 grid's cosine-transform signs, its neighbour signs, mean and edges."""
    k = np.arange(8)
    dct = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 16) * np.sqrt(2 / 8)
    dct[0] /= np.sqrt(2)

    def bits(x: np.ndarray) -> str:
        return np.packbits(x.ravel()).tobytes().hex()

    def run(frames):
        for rows in frames:
            grid = np.stack([np.asarray(x, float) for x in rows["embedding"]]).reshape(-1, 8, 8)
            c = np.round(dct @ grid @ dct.T, 9)
            edge = np.hypot(np.diff(grid, axis=2)[:, :7], np.diff(grid, axis=1)[:, :, :7]).sum((1, 2))
            yield pd.DataFrame({"vec_id": rows["vec_id"], "phash": [bits(x > np.median(x)) for x in c], "dhash": [bits(x[:, 1:] > x[:, :-1]) for x in grid], "mean": np.round(grid.mean((1, 2)), 6), "edge": np.round(edge, 5)})

    return vectors.mapInPandas(run, "vec_id long, phash string, dhash string, mean double, edge double")


#: Pairs of grids that a task compares at a time.
PAIRS_HELD = 512


def structural_similarity(pairs: DataFrame, window: int = 3) -> DataFrame:
    """``a, b, s``: SSIM of two 8 x 8 grids over uniform windows with sample covariance, mapped to [0, 1]."""

    def boxes(x: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, (window, window), axis=(1, 2)).reshape(len(x), -1, window * window)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS_HELD):  # what is made of a pair is some 36 x 9 x 8 doubles
                rows = batch.slice(i, PAIRS_HELD)
                x, y = (boxes(pc.list_flatten(rows.column(c)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, 8, 8)) for c in ("x", "y"))
                mx, my, n = x.mean(2), y.mean(2), window * window
                vx, vy = x.var(2, ddof=1), y.var(2, ddof=1)
                cov = ((x - mx[:, :, None]) * (y - my[:, :, None])).sum(2) / (n - 1)
                c1, c2 = 0.01**2, 0.03**2
                s = ((2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean(1)
                yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b"), pa.array(np.round(np.clip((s + 1) / 2, 0, 1), 6))], ["a", "b", "s"])

    return pairs.mapInArrow(run, "a long, b long, s double")
