"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.shared import Written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def _star(edges: DataFrame, rows: DataFrame, by: str, other: str) -> tuple[DataFrame, Written]:
    """Every row of `rows` joined to the smallest node next to its `by` node.

    The smallest neighbours are summed up before the shuffle and written, so that the join has a
    plain exchange on both sides and a node with very many edges can be split.
    """
    least = Written(edges.groupBy(F.col(by).alias("node")).agg(F.min(other).alias("least")))
    return rows.join(least.df, F.col(by) == F.col("node")), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b: long); root is the least node reachable.

    Large-star then small-star rounds, each written to the shared folder, until the edges no
    longer change: the number of rounds grows with the logarithm of the longest path, and no round
    makes more edges than it was given. Rows with a null end are left out; a == b gives no edge;
    an empty table gives an empty result. Edges are never gathered on the driver.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = Written(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = _state(now.df)
    while before[0]:
        e = now.df
        both = e.select(F.col("hi").alias("x"), F.col("lo").alias("y")).union(e.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        joined, large = _star(both, e.select(F.col("lo").alias("x"), F.col("hi").alias("y")), "x", "y")
        grown = Written(joined.select(F.col("y").alias("hi"), F.least("x", "least").alias("lo")).distinct())
        e = grown.df
        joined, small = _star(e.select(F.col("hi").alias("x"), F.col("lo").alias("y")), e.select(F.col("hi").alias("x"), F.col("lo").alias("y")), "x", "y")
        pairs = joined.select(F.explode(F.array(F.struct(F.col("x").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("y").alias("hi"), F.col("least").alias("lo")))).alias("p")).select("p.hi", "p.lo")
        nxt = Written(pairs.where("hi <> lo").distinct())
        after = _state(nxt.df)
        for table in (large, grown, small, now):
            table.drop()
        now = nxt
        if after == before:
            break
        before = after
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
