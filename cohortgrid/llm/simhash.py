"""SimHash near-dedup: tiled exact comparison with exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.components import components
from cohortgrid.llm.shared import Written, small_batches

SEED = 42
#: Fingerprints of one cell that one tile holds, on average.
TILE = 32768
#: Rows of a tile that are compared at once.
BLOCK = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def simhash(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist())
        h = np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed long, in Arrow batches."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(simhash(t, shingle)) for t in texts], dtype="int64")

    return run(text)


def _sorted(members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members by the bit counts of their quarters, and the least and largest counts of each block."""
    quarters = np.bitwise_count(members.view("<u2").reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T)
    members, quarters = members[order], quarters[order]
    cuts = np.arange(0, len(members), BLOCK)
    return members, np.minimum.reduceat(quarters, cuts), np.maximum.reduceat(quarters, cuts)


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after linking u[i] with v[i]: every label is the least index of its group."""
    while True:
        a, b = label[u], label[v]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        open_ = lo < hi
        if not open_.any():
            return label
        u, v = u[open_], v[open_]
        np.minimum.at(label, hi[open_], lo[open_])
        while not np.array_equal(label, nxt := label[label]):
            label = nxt


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within `radius` bits between two tiles (right None: within one), as a spanning forest.

    Block pairs whose bit counts differ by more than the radius are skipped: the counts of the
    quarters can't differ by more than the bits do. All other pairs are compared exactly. A group
    of m linked members gives m - 1 links, not m squared.
    """
    a, a_min, a_max = _sorted(left)
    b, b_min, b_max = (a, a_min, a_max) if right is None else _sorted(right)
    shift = 0 if right is None else len(a)
    label = np.arange(len(a) + (0 if right is None else len(b)))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i in range(len(a_min)):
        gap = np.maximum(0, np.maximum(a_min[i] - b_max, b_min - a_max[i])).sum(axis=1)
        x = a[i * BLOCK : (i + 1) * BLOCK]
        for j in np.flatnonzero(gap <= radius).tolist():
            if right is None and j < i:
                continue
            near = np.bitwise_count(x[:, None] ^ b[None, j * BLOCK : (j + 1) * BLOCK]) <= radius
            u, v = np.nonzero(near)
            if len(u):
                waiting.append((u + i * BLOCK, v + j * BLOCK + shift))
                held += len(u)
            if held > 1 << 18:
                label, waiting, held = _merge(label, *map(np.concatenate, zip(*waiting))), [], 0
    if waiting:
        label = _merge(label, *map(np.concatenate, zip(*waiting)))
    values = a if right is None else np.concatenate([a, b])
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def links(values: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct longs `fp` that differ in at most `radius` bits.

    The bit counts of the two halves name a cell; two values within the radius lie in cells whose
    counts differ by no more than it, so a cell meets only such cells (41 at radius 4). Large
    cells are dealt by hash into tiles of about `tile` values. Every pair of tiles that may hold a
    link is one unit of work, compared exactly; the links come back as one spanning forest a pair.
    """
    cells = values.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
    )
    # 33 x 33 cells at most, whatever the data.
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    salted = cells.join(F.broadcast(sizes), ["hi", "lo"]).withColumn("salt", F.expr("CAST(pmod(xxhash64(fp, 7), tiles) AS INT)"))
    tiles = Written(salted.groupBy("hi", "lo", "salt").agg(F.collect_list("fp").alias("fps")))
    key = F.struct("hi", "lo", "salt")
    near = [(x, y) for x in range(-radius, radius + 1) for y in range(abs(x) - radius, radius - abs(x) + 1)]
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in near])
    pairs = (
        tiles.df.select(key.alias("one"), F.explode(steps).alias("d"))
        .select("one", (F.col("one.hi") + F.col("d.x")).alias("hi"), (F.col("one.lo") + F.col("d.y")).alias("lo"))
        .join(tiles.df.select("hi", "lo", "salt"), ["hi", "lo"])
        .select("one", key.alias("two"))
        .where("one <= two")
    )
    full = (
        pairs.join(tiles.df.select(key.alias("one"), F.col("fps").alias("left")), "one")
        .join(tiles.df.select(key.alias("two"), F.col("fps").alias("right")), "two")
        .select("left", F.when(F.col("one") != F.col("two"), F.col("right")).alias("right"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two in zip(batch["left"], batch["right"]):
                other = None if two is None else np.asarray(two, np.int64).view("<u8")
                a, b = tile_links(np.asarray(one, np.int64).view("<u8"), other, radius)
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = Written(full.mapInPandas(compare, "a long, b long"))
    tiles.drop()
    return found.df


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document row.

    Whole texts; A-Z lower-cased; words are runs without ASCII white space; `shingle` words in a
    row (repeats count), a shorter text is one shingle. Null and word-less texts have fingerprint
    0 and link like any other. component_id is the smallest doc_id reachable over links of at most
    `radius` bits; null ids are never chosen (a group of null ids only has null). Repeated rows
    come back as often as given. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kept = Written(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col).cast("string"), shingle).alias("fp")))
    least = Written(kept.df.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(least.df.select("fp"), radius))
    rooted = Written(least.df.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id"))
    group = Written(rooted.df.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = Written(rooted.df.join(group.df, "root").select("fp", "component_id"))
    for table in (least, rooted, group):
        table.drop()
    return kept.df.join(named.df, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """`docs` with one document of each near-duplicate group, the one with the smallest doc_id.

    Every column of `docs` is kept, whatever its name. Rows that share a doc_id are one document. A
    row without a doc_id can't be named by a group and stays. Null and empty texts are near-duplicates
    of each other; an empty table gives an empty result.
    """
    groups = near_duplicates(docs, radius, shingle)
    losers = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(losers, F.col("row.doc_id").cast("long") == F.col("_gone"), "left_anti").select("row.*")
