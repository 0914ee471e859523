"""Contiguous shards of near equal bytes, cut from a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.llm.shared import Written

GROUP = ["h", "text_crc32", "size"]
#: Groups of equal texts that stand first in the order, largest first (some 50 KB).
HEAVY = 1000


def _own_shards(heavy: DataFrame, total: int, n_shards: int) -> tuple[int, int]:
    """How many groups have more bytes than an equal share of what is left, and the bytes left.

    There are fewer of them than shards, so only that many rows come to the driver.
    """
    own, left = 0, total
    for row in heavy.where(F.col("first") < n_shards - 1).orderBy("first").collect():
        if row["bytes"] * (n_shards - own) <= left:
            break
        own += 1
        left -= row["bytes"]
    return own, left


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row per row of `docs`.

    A row's size is the UTF-8 bytes of its text plus 1 (null: 1). Rows stand in one global order:
    the HEAVY largest groups of equal texts, largest first, so that cuts fall between small groups;
    then all others by the text's hash; in a group by doc_id. Equal texts share a shard.
    Per-partition totals of bytes and rows give every group its place in the global prefix sum;
    the order is cut at equal targets, and a group goes where its middle lies. A group larger than
    an equal share gets a shard of its own, and the targets are those of the rest. Slots number a shard's rows from 0 without gaps, repeated rows one by one, rows without an id first. With
    fewer groups than shards some shards have no rows; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
    )
    narrow = Written(rows)
    groups = narrow.df.groupBy(*GROUP).agg(F.sum("size").alias("bytes"))
    heaviest = groups.orderBy(F.desc("bytes"), *GROUP).limit(HEAVY)
    heavy = Written(heaviest.withColumn("first", F.row_number().over(Window.orderBy(F.desc("bytes"), *GROUP)) - 1))
    own, left = _own_shards(heavy.df, narrow.df.agg(F.sum("size")).head()[0] or 0, n_shards)
    ranked = narrow.df.join(F.broadcast(heavy.df.select(*GROUP, "first")), GROUP, "left").withColumn("first", F.coalesce("first", F.lit(HEAVY)))
    order = ["first", *GROUP, "doc_id"]
    dealt = ranked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    placed = Written(dealt.select("*", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    narrow.drop()
    heavy.drop()

    def offsets(of: DataFrame, total: str, name: str) -> DataFrame:
        """Sums over the earlier parts; one row for each part, as many as shuffle partitions."""
        return F.broadcast(of.select("part", (F.sum(total).over(Window.orderBy("part")) - F.col(total)).alias(name)))

    rows_before = offsets(placed.df.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "rows", "rows_before")
    # A group counts where its first row stands.
    groups = placed.df.groupBy("first", *GROUP).agg(F.min("m").alias("m"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = Written(groups.withColumn("part", F.shiftright("m", 33)).withColumn("place", F.col("m").bitwiseAND(F.lit((1 << 33) - 1))))
    weight = F.when(F.col("first") >= own, F.col("bytes")).otherwise(0)
    bytes_before = offsets(groups.df.groupBy("part").agg(F.sum(weight).alias("bytes")), "bytes", "bytes_before")
    inside = F.sum(weight).over(Window.partitionBy("part").orderBy("m")) - weight
    middle = F.col("bytes_before") + F.col("inside") + F.col("bytes") / 2
    share = F.floor(middle * (n_shards - own) / F.lit(max(1, left)))
    shard = F.when(F.col("first") < own, F.col("first")).otherwise(F.least(F.lit(n_shards - 1), own + share)).cast("int")
    cut = Written(
        groups.df.withColumn("inside", inside)
        .join(bytes_before, "part")
        .join(rows_before, "part")
        .select(*GROUP, shard.alias("shard"), (F.col("rows_before") + F.col("place")).alias("at"))
    )
    groups.drop()
    begins = F.broadcast(cut.df.groupBy("shard").agg(F.min("at").alias("begin")))
    numbered = placed.df.join(rows_before, "part").select("doc_id", *GROUP, (F.col("rows_before") + F.col("place")).alias("at"))
    return numbered.join(cut.df.select(*GROUP, "shard"), GROUP).join(begins, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("begin")).alias("slot"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
