"""Random tables with both margins fixed, and random orders worked out by position, without copying a row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgrid.operators.scans import Scan, running
from cohortgrid.session import cut_lineage

#: Shuffles drawn at once, and cells of a leaf of the tree on average.
BLOCK, CHUNK = 50, 4096
#: Counts up to which numpy draws; above, see `hypergeometric`.
NUMPY_LIMIT = 10**9 - 1
#: Positions of one part of a cell, and positions worked on at once.
PART, AT_ONCE = 4096, 1 << 18
#: Distinct ranks of the other side that are handed to the tasks; beyond, both meet by a join.
SHARED_RANKS = 4_000_000
ROUNDS = 8


# ---- counts ---------------------------------------------------------------------------------------------
#: Logarithms of the first factorials.
LOG_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1024)))])


def _log_factorial(x: np.ndarray) -> np.ndarray:
    b = np.maximum(x, 1) + 1.0
    series = (b - 0.5) * np.log(b) - b + 0.5 * np.log(2 * np.pi) + 1 / (12 * b) - 1 / (360 * b**3) + 1 / (1260 * b**5)
    return np.where(x < len(LOG_FACTORIALS), LOG_FACTORIALS[np.clip(x, 0, len(LOG_FACTORIALS) - 1)], series)


def _log_ratio(base: np.ndarray, by: np.ndarray) -> np.ndarray:
    """log((base + by)! / base!): for large bases from Stirling's series term by term, so that nothing large cancels."""
    b, t = np.maximum(base, 1023) + 1.0, by.astype(float)
    tail = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = np.minimum(base, base + by) < len(LOG_FACTORIALS)
    t_large = np.where(small, 0.0, t)
    large = t_large * np.log(b) + (b + t_large - 0.5) * np.log1p(t_large / b) - t_large + tail(b + t_large) - tail(b)
    return np.where(small, _log_factorial(base + by) - _log_factorial(base), large)


def _by_ratio_of_uniforms(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hypergeometric draws by ratio of uniforms around the mode, for counts of any size."""
    whole = good + bad
    few, of = np.minimum(good, bad), np.minimum(size, whole - size)  # the smaller colour, and the smaller of drawn and left
    mode = ((of + 1.0) * (few + 1.0) / (whole + 2.0)).astype(np.int64)
    share = few / whole
    spread = np.sqrt((whole - of) / (whole - 1.0) * of * share * (1 - share) + 0.5)
    centre, width = of * share + 0.5, 1.7155277699214135 * spread + 0.8989161620588988
    lowest, highest = np.maximum(0, of - (whole - few)), np.minimum(of, few)
    out, left = np.empty(len(good), np.int64), np.arange(len(good))
    while len(left):
        u, v = rng.random(len(left)), rng.random(len(left))
        x = np.floor(centre[left] + width[left] * (v - 0.5) / np.maximum(u, 1e-300))
        inside = (x >= lowest[left]) & (x <= highest[left])
        k = np.where(inside, x, mode[left]).astype(np.int64)
        m, step = mode[left], k - mode[left]
        rest = whole[left] - few[left] - of[left]
        t = -(_log_ratio(m, step) + _log_ratio(few[left] - m, -step) + _log_ratio(of[left] - m, -step) + _log_ratio(rest + m, step))
        good_draw = inside & (2 * np.log(np.maximum(u, 1e-300)) <= t)
        out[left[good_draw]] = k[good_draw]
        left = left[~good_draw]
    out = np.where(good > bad, of - out, out)
    return np.where(of < size, good - out, out)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of the first colour among `size` drawn from good + bad rows, for counts of any size."""
    if np.max(good) <= NUMPY_LIMIT and np.max(bad) <= NUMPY_LIMIT:
        return rng.hypergeometric(good, bad, size)
    good, bad, size = np.broadcast_arrays(*(np.asarray(x, np.int64) for x in (good, bad, size)))
    large = (np.maximum(good, bad) > NUMPY_LIMIT) & (np.minimum(good, bad) > 0) & (size > 0) & (size < good + bad)
    plain = np.where(bad == 0, size, np.where(size == good + bad, good, 0))
    small = ~large & (np.maximum(good, bad) <= NUMPY_LIMIT)
    out = plain.copy()
    out[small] = rng.hypergeometric(good[small], bad[small], size[small])
    # A few rows of a colour, or few drawn, among very many: drawn one by one, exactly, since a series is not.
    thin = large & (np.minimum(np.minimum(good, bad), np.minimum(size, good + bad - size)) < 64)
    out[thin] = [_one_by_one(rng, *x) for x in zip(good[thin].tolist(), bad[thin].tolist(), size[thin].tolist())]
    thick = large & ~thin
    if thick.any():
        out[thick] = _by_ratio_of_uniforms(rng, good[thick], bad[thick], size[thick])
    return out


def _one_by_one(rng: np.random.Generator, good: int, bad: int, size: int) -> int:
    whole = good + bad
    if min(good, bad) < 64:
        few, drawn, left = min(good, bad), 0, size
        for i in range(few):  # is each row of the smaller colour among those drawn?
            hit = rng.random() * (whole - i) < left
            drawn, left = drawn + hit, left - hit
        return drawn if good <= bad else size - drawn
    if whole - size < size:
        return good - _one_by_one(rng, good, bad, whole - size)
    got = 0
    for i in range(size):
        got += rng.random() * (whole - i) < good - got
    return int(got)


def dealt(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """Group counts of `size` rows taken without replacement from `left` (one row per shuffle), which is lowered."""
    out, need, total = np.zeros_like(left), np.full(len(left), size), left.sum(axis=1)
    for g in range(left.shape[1] - 1):
        total = total - left[:, g]
        out[:, g] = hypergeometric(rng, left[:, g], total, need)
        need = need - out[:, g]
    out[:, -1] = need
    left -= out
    return out


def _paths(cells: DataFrame, count: str, depth: int) -> DataFrame:
    """_chunk, _path: for each leaf the rows under the left branch at each node on the way to it, from the root down."""
    leaves = cells.groupBy("_chunk").agg(F.sum(count).alias("_rows"))
    levels = leaves.select("_chunk", "_rows", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("_level"))
    above = lambda up: F.call_function("shiftright", F.col("_chunk"), (F.lit(up) - F.col("_level")).cast("int"))
    node, leftward = above(depth), above(depth - 1) % 2 == 0
    levels = levels.select("_chunk", "_level", node.alias("_node"), F.when(leftward, F.col("_rows")).otherwise(0).alias("_rows"))
    lefts = levels.groupBy("_level", "_node").agg(F.sum("_rows").alias("_left"))
    on = levels.select("_chunk", "_level", "_node").join(lefts, ["_level", "_node"])
    return on.groupBy("_chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_level", "_left"))), lambda x: x["_left"].cast("long")).alias("_path"))


def shuffled_counts(cells: DataFrame, keys: Sequence[str], sizes: Sequence[int], n_perm: int, seed: int = 0, count: str = "n") -> DataFrame:
    """Rows of each group per cell in n_perm shuffles of the groups over the rows: (perm, *keys, _c0, _c1, ...).

    `cells` counts the rows per `keys`, `sizes` the rows per group. The tables are drawn with both
    margins fixed, as shuffling the rows would give them; no row is copied. Cells lie in the leaves of
    a binary tree; a node's counts are divided between its branches by a draw of its own, the same in
    every task, so a leaf is reached in as many draws as the tree is deep and nothing is gathered.
    """
    ks, sizes = list(keys), np.array([int(x) for x in sizes], np.int64)
    depth = max(0, int(cells.count() // CHUNK).bit_length())
    spread = cells.select(*ks, count).withColumn("_chunk", F.pmod(F.xxhash64(*ks), F.lit(1 << depth)))
    path = _paths(spread, count, depth) if depth else spread.select("_chunk", F.array().cast("array<long>").alias("_path")).distinct()
    whole = spread.join(path, "_chunk").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n_perm - 1) // BLOCK))))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, block = int(key[0]), int(key[1])
        pdf = pdf.sort_values(ks).reset_index(drop=True)
        perms = np.arange(block * BLOCK + 1, min(n_perm, (block + 1) * BLOCK) + 1)
        left = np.tile(sizes, (len(perms), 1))
        for level, rows in enumerate(pdf["_path"].iloc[0]):
            node = chunk >> (depth - level)
            branch = dealt(np.random.default_rng([seed, block, level, node]), left, int(rows))
            if chunk >> (depth - level - 1) & 1 == 0:
                left = branch
        rng = np.random.default_rng([seed, block, depth, chunk])
        drawn = np.stack([dealt(rng, left, int(n)) for n in pdf[count]])
        out = pdf.loc[np.repeat(np.arange(len(pdf)), len(perms)), ks].reset_index(drop=True)
        out.insert(0, "perm", np.tile(perms, len(pdf)))
        return out.assign(**{f"_c{i}": drawn[..., i].ravel() for i in range(len(sizes))})

    kinds = dict(spread.dtypes)
    return whole.groupBy("_chunk", "_block").applyInPandas(draw, ", ".join(["perm long", *(f"`{k}` {kinds[k]}" for k in ks), *(f"_c{i} long" for i in range(len(sizes)))]))


# ---- orders ---------------------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shuffled_positions(at: np.ndarray, n: int, perm: int, seed: int) -> np.ndarray:
    """Where the rows at these positions of 0 to n - 1 go in a shuffle: each task works it out for its own rows.

    A balanced network of ROUNDS rounds over the next even number of bits; what falls outside goes round again.
    """
    half = np.uint64(max(2, -(-max(1, int(n - 1).bit_length()) // 2)))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + perm * 0xD1B54A32D192ED03) % 2**64))
    out, todo = at.astype(np.uint64), np.arange(len(at))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & low
        for k in keys:
            a, b = b, a ^ (_mixed(b ^ k) & low)
        out[todo] = a << half | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _slices(begin: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Part numbers and positions of parts, AT_ONCE positions or so at once."""
    ends = np.cumsum(rows)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE, "right")))
        which = np.repeat(np.arange(a, b), rows[a:b])
        first = np.concatenate([[0], np.cumsum(rows[a:b])[:-1]])
        yield which, begin[which] + np.arange(len(which)) - first[which - a]
        a = b


def shuffled_products(x: DataFrame, y: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """(perm, xy): sum of value products when the rows of `y` are shuffled over those of `x`.

    Both are (value, n) with one row per distinct value and as many rows in all. A cell of many rows
    is dealt in parts of PART positions. `y` is handed to the tasks up to SHARED_RANKS values (counted);
    beyond, positions meet it by a join. The shuffles, and so the result, are the same either way.
    """
    placed = lambda d: cut_lineage(running(d, [], [F.col("value")], {"upto": Scan("sum", F.col("n"))}).select("value", "n", (F.col("upto") - F.col("n")).alias("begin")))
    px, py = placed(x), placed(y)
    n = int(px.agg(F.sum("n")).first()[0] or 0)
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART))).alias("_i")
    parts = px.select("value", "begin", "n", cut).select("value", (F.col("begin") + F.col("_i") * PART).alias("begin"), F.least(F.lit(PART), F.col("n") - F.col("_i") * PART).alias("rows"))
    spark = x.sparkSession
    # A stated number of partitions: the work is rows times shuffles, which the bytes don't show.
    dealt_out = cut_lineage(parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "begin"))

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for pdf in batches:
            value, begin, rows = (pdf[c].to_numpy() for c in ("value", "begin", "rows"))
            for which, at in _slices(begin, rows):
                for perm in range(1, n_perm + 1):
                    yield perm, value[which], shuffled_positions(at, n, perm, seed)

    if py.count() <= SHARED_RANKS:
        # A row each of 16 bytes, so 64 MB at most.
        table = py.orderBy("begin").toPandas()
        sent = spark.sparkContext.broadcast((table["begin"].to_numpy(), table["value"].to_numpy(float)))

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            begin, value = sent.value
            total = np.zeros(n_perm + 1)
            for perm, own, to in positions(batches):
                total[perm] += own @ value[np.searchsorted(begin, to, "right") - 1]
            yield pd.DataFrame({"perm": np.arange(1, n_perm + 1), "xy": total[1:]})

        return dealt_out.mapInPandas(products, "perm long, xy double").groupBy("perm").agg(F.sum("xy").alias("xy"))

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for perm, own, to in positions(batches):
            yield pd.DataFrame({"perm": perm, "own": own, "to": to, "bucket": to // PART})

    rows = dealt_out.mapInPandas(moved, "perm long, own double, to long, bucket long")
    last = F.col("begin") + F.col("n") - 1
    spans = py.select("value", "begin", last.alias("last"), F.explode(F.sequence(F.floor(F.col("begin") / PART), F.floor(last / PART))).alias("bucket"))
    met = rows.join(spans, "bucket").where((F.col("to") >= F.col("begin")) & (F.col("to") <= F.col("last")))
    return met.groupBy("perm").agg(F.sum(F.col("own") * F.col("value")).alias("xy"))
