"""Ordered work inside groups that may hold any share of the rows.

A plain window puts a whole group into one task. Here every input, whatever its size, is dealt by
range over (keys, order) and written once to the shared folder with the number of the range each row
fell in, so the ranges are the same however often they are read. Each range of a group is scanned on
its own, and the ranges are tied together by one total per range. A group may lie in as many ranges
as it needs; the number of ranges is the session's number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.session import cut_lineage

#: Rows of a group that one task may sort on its own, and numbers by which groups are counted together beforehand.
GROUP_ROWS, GROUP_BUCKETS = 100_000, 1 << 16


@dataclass(frozen=True)
class Scan:
    """One running value: `fn` is sum, min, max or last; `back` runs from the end of the order."""

    fn: str
    value: Column
    back: bool = False


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys) if keys else ["_whole"]


def place(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """Add `_o` (the order as one comparable struct) and `_b` (the range the row falls in).

    `order` must be unique within a key and ascending; negate a number to sort it downwards.
    `ranges` is the number of ranges, by default that of the session's shuffle partitions.
    """
    d = df.withColumn("_o", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    if not keys:
        d = d.withColumn("_whole", F.lit(0))
    by = [*_keys(keys), "_o"]
    dealt = d.repartitionByRange(ranges, *by) if ranges else d.repartitionByRange(*by)
    return cut_lineage(dealt.withColumn("_b", F.spark_partition_id()))


def scan_placed(placed: DataFrame, keys: Sequence[str], scans: dict[str, Scan], totals: dict[str, Column] | None = None) -> DataFrame:
    """Running values over placed rows, plus group totals (sums) where asked for."""
    ks = _keys(keys)
    totals = totals or {}
    own, carry, within, both = [], [], [], []
    for name, s in scans.items():
        t, c, v = f"_t_{name}", f"_c_{name}", f"_v_{name}"
        order = F.col("_b").desc() if s.back else F.col("_b").asc()
        before = Window.partitionBy(*ks).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        row_order = F.col("_o").desc() if s.back else F.col("_o").asc()
        upto = Window.partitionBy(*ks, "_b").orderBy(row_order).rowsBetween(Window.unboundedPreceding, 0)
        if s.fn == "last":
            pick = F.min_by if s.back else F.max_by
            own.append(pick(s.value, F.when(s.value.isNotNull(), F.col("_o"))).alias(t))
            carry.append(F.last(t, ignorenulls=True).over(before).alias(c))
            within.append((v, F.last(s.value, ignorenulls=True).over(upto)))
            both.append((name, F.coalesce(F.col(v), F.col(c)), v, c))
        else:
            agg = {"sum": F.sum, "min": F.min, "max": F.max}[s.fn]
            own.append(agg(s.value).alias(t))
            carry.append(agg(t).over(before).alias(c))
            within.append((v, agg(s.value).over(upto)))
            joined = {
                "sum": F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(v), F.lit(0)),
                "min": F.least(F.col(c), F.col(v)),
                "max": F.greatest(F.col(c), F.col(v)),
            }[s.fn]
            both.append((name, joined, v, c))
    for name, value in totals.items():
        own.append(F.sum(value).alias(f"_s_{name}"))
        carry.append(F.sum(f"_s_{name}").over(Window.partitionBy(*ks)).alias(name))
    per_bucket = placed.groupBy(*ks, "_b").agg(*own).select(*ks, "_b", *carry)
    out = placed.join(per_bucket, [*ks, "_b"])
    for v, expr in within:
        out = out.withColumn(v, expr)
    for name, expr, _, _ in both:
        out = out.withColumn(name, expr)
    return out.drop(*[x for _, _, v, c in both for x in (v, c)])


def clean(df: DataFrame) -> DataFrame:
    return df.drop("_o", "_b", "_whole")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    scans: dict[str, Scan],
    totals: dict[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Running sums, minima, maxima or last values per key in a unique order."""
    return clean(scan_placed(place(df, keys, order, ranges), keys, scans, totals))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank", total: str | None = None, at_most: int | None = None, **kw) -> DataFrame:
    """Row number per key in a unique order, with the group size on request.

    Groups known to have `at_most` GROUP_ROWS rows are sorted where they are, without being dealt by range.
    """
    one = F.lit(1).cast("long")
    if keys and at_most is not None and at_most <= GROUP_ROWS and not kw.get("ranges"):
        w = Window.partitionBy(*keys)
        d = df.withColumn(rank, F.row_number().over(w.orderBy(*order)).cast("long"))
        return d.withColumn(total, F.sum(one).over(w)) if total else d
    return running(df, keys, order, {rank: Scan("sum", one)}, {total: one} if total else None, **kw)


def finite(column: str | Column) -> Column:
    """Neither null nor NaN nor infinite."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows per (key, distinct value), counted before the shuffle; `weight` stands for that many rows."""
    ok = df.where(finite(value))
    n = F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))
    return ok.groupBy(*keys, value).agg(n.alias("n_ties"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, **kw) -> DataFrame:
    """One row per (key, distinct value): number of ties, tie-averaged rank, rows in the group; `weight` as in `value_counts`."""
    return _ranks(value_counts(df, keys, value, weight), keys, value, **kw)


def _ranks(d: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    r = running(d, keys, [F.col(value)], {"n_upto": Scan("sum", F.col("n_ties"))}, {"n_group": F.col("n_ties")}, **kw)
    return r.withColumn("avg_rank", F.col("n_upto") - (F.col("n_ties") - 1) / 2.0)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count: str | None = None, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key; `weight` stands for that many equal rows.

    Rows are counted per distinct value and the quantiles read off the cumulative counts, so no
    group is gathered anywhere.
    """
    if keys and not weight and not ranges:
        return _quantiles(df, keys, [value], probs, count)
    d = value_counts(df, keys, value, weight)
    r = _ranks(d, keys, value, ranges=ranges)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n_group") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("n_upto") > pos) & (F.col("n_upto") - F.col("n_ties") <= pos)
            picks.append(F.max(F.when(hit, F.col(value))).cast("double").alias(f"_{name}_{side}"))
    picks.append(F.max("n_group").alias("_n"))
    g = r.groupBy(*keys).agg(*picks) if keys else r.agg(*picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    if count:
        out.append(F.col("_n").alias(count))
    return g.select(*keys, *out)


def _quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: dict[str, float], count: str | None = None) -> DataFrame:
    """Exact quantiles per key of one column, or of several with one probability, which then keep their names.

    The rows are written once and counted by a hash of their key, in GROUP_BUCKETS numbers whatever the
    number of keys. Keys whose number stands for at most GROUP_ROWS rows are dealt by key and sorted
    where they are; keys of any more rows are read off the cumulative counts of their ranges.
    """
    k = list(keys)
    rows = cut_lineage(df.select(*k, *columns, F.xxhash64(*k).alias("_k")))
    bucket = F.pmod("_k", F.lit(GROUP_BUCKETS))
    large = sorted(r[0] for r in rows.groupBy(bucket.alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select("_g").collect())
    wanted = [(c if len(columns) > 1 else name, c, float(p)) for c in columns for name, p in probs.items()]
    small = rows.where(~bucket.isin(large)) if large else rows
    whole = Window.partitionBy("_k", *k)
    small = small.withColumns({f"_n{i}": F.count_if(finite(c)).over(whole) for i, c in enumerate(columns)})
    for i, c in enumerate(columns):
        small = small.withColumn(f"_r{i}", F.row_number().over(whole.orderBy(finite(c).desc(), F.col(c).cast("double"))))
    picks, out = [], []
    for i, (_, c, p) in enumerate(wanted):
        j = list(columns).index(c)
        at = F.lit(p) * (F.col(f"_n{j}") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when(F.col(f"_r{j}") == pos + 1, F.when(finite(c), F.col(c).cast("double")))).alias(f"_{side}{i}"))
    picks += [F.max(f"_n{j}").alias(f"_n{j}") for j in range(len(columns))]
    g = small.groupBy("_k", *k).agg(*picks).where(F.greatest(F.lit(0), *[F.col(f"_n{j}") for j in range(len(columns))]) > 0)
    for i, (label, c, p) in enumerate(wanted):
        at = F.lit(p) * (F.col(f"_n{list(columns).index(c)}") - 1)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))).alias(label))
    done = g.select(*k, *out, *([F.col("_n0").alias(count)] if count else []))
    if not large:
        return done
    rest, ranges = rows.where(bucket.isin(large)), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if len(columns) > 1:
        return done.unionByName(medians(rest, k, columns, ranges=ranges))
    return done.unionByName(exact_quantiles(rest, k, columns[0], probs, count, ranges=ranges))


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], count: str | None = None, **kw) -> DataFrame:
    """Exact medians of several columns: the columns become rows, so one pass serves all of them."""
    if keys and not count and not kw.get("ranges"):
        return _quantiles(df, keys, columns, {columns[0]: 0.5})
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in columns])).alias("_p")
    stacked = df.select(*keys, pairs).select(*keys, "_p.*")
    q = exact_quantiles(stacked, [*keys, "_col"], "_val", {"_med": 0.5}, **kw)
    wide = q.groupBy(*keys).pivot("_col", list(columns)).agg(F.first("_med")) if keys else q.groupBy().pivot("_col", list(columns)).agg(F.first("_med"))
    if not count:
        return wide
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return sizes.join(wide, list(keys), "left")


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery rather than a join."""
    return df.withColumn("_row", one_row.select(F.struct(*one_row.columns)).scalar()).select(*df.columns, "_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a stated order. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The k first rows per key; Spark cuts every group to k rows before the shuffle. None: all rows, ranked."""
    if k is None:
        return ranked(df, keys, order, rank)
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def bh_q(df: DataFrame, keys: Sequence[str], p: str, ties: Sequence[str], q: str = "q", **kw) -> DataFrame:
    """Benjamini-Hochberg q over all tests sharing `keys`; `ties` make the order unique."""
    placed = place(df, keys, [F.col(p), *[F.col(c) for c in ties]], kw.get("ranges"))
    one = F.lit(1).cast("long")
    r = scan_placed(placed, keys, {"_rank": Scan("sum", one)}, {"_tests": one})
    r = scan_placed(r.withColumn("_raw", F.col(p) * F.col("_tests") / F.col("_rank")), keys, {q: Scan("min", F.col("_raw"), back=True)})
    return clean(r.withColumn(q, F.least(F.col(q), F.lit(1.0)))).drop("_rank", "_tests", "_raw")
