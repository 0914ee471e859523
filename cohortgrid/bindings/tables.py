"""The given tables in the shapes the operators take, with the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(words: list[str | None], at: Column) -> Column:
    """words[at % len] as an expression."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))


def pick_sql(words: list[str | None], at: str) -> str:
    items = ", ".join("NULL" if w is None else "'" + w.replace("'", "''") + "'" for w in words)
    return f"([{items}])[CAST(({at}) % {len(words)} AS INTEGER) + 1]"


def feature_name(pos: Column) -> Column:
    return F.concat(F.lit("g"), F.lpad(pos.cast("string"), 2, "0"))


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """sample_id, cohort, cluster, subtype, label, feature, value: one row per embedding position."""
    e = table(spark, folder, "embeddings").where(F.col("embedding").isNotNull())
    return e.select(
        F.col("vec_id").alias("sample_id"),
        "label",
        (F.col("vec_id") % 2).alias("cohort"),
        (F.col("label") % 4).alias("cluster"),
        (F.col("label") % 5).alias("subtype"),
        F.posexplode("embedding").alias("pos", "raw"),
    ).select("sample_id", "label", "cohort", "cluster", "subtype", feature_name(F.col("pos")).alias("feature"), F.col("raw").cast("double").alias("value"))


M = """m AS (
  SELECT vec_id AS sample_id, label, vec_id % 2 AS cohort, label % 4 AS cluster, label % 5 AS subtype,
         'g' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, CAST(raw AS DOUBLE) AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS raw, generate_subscripts(embedding, 1) - 1 AS pos
        FROM embeddings WHERE embedding IS NOT NULL))"""


def survival(spark: SparkSession, folder: str) -> DataFrame:
    """id, time (days), event (0/1), grp: orders as follow-up rows, priority as group."""
    o = table(spark, folder, "orders")
    days = F.date_diff(F.lit("2001-12-31").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    return o.select(
        F.col("o_orderkey").alias("id"),
        days.alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_custkey").alias("custkey"),
        (F.col("o_orderstatus") == "P").cast("int").alias("event2"),
    )


S = """s AS (
  SELECT o_orderkey AS id, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS DOUBLE) AS time,
         CAST(o_orderstatus = 'F' AS INTEGER) AS event, o_orderpriority AS grp, o_custkey AS custkey,
         CAST(o_orderstatus = 'P' AS INTEGER) AS event2
  FROM orders)"""


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, places) + F.lit(0.0)


def drug_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their part as a named compound."""
    li = table(spark, folder, "lineitem")
    p = table(spark, folder, "part")
    name = F.lower(F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 50).cast("string")))
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        name.alias("canonical"), "l_returnflag", "p_size", "l_discount", "l_tax", "l_quantity", "l_suppkey", "p_brand", "p_type", "l_orderkey", "l_linenumber", "l_partkey")


def ranked_list(rows: DataFrame) -> DataFrame:
    """A compound list with the columns of a reversal ranking."""
    from cohortgrid.operators.windows import rank_percentile

    g = rows.groupBy("canonical").agg(
        F.round(F.avg(F.col("l_discount") * F.col("l_quantity")), 9).alias("reversal_score"), F.count(F.lit(1)).alias("n_signatures"),
        F.count_distinct(F.col("l_suppkey") % 3).alias("n_cell_lines"), F.avg((F.col("l_discount") > 0.05).cast("double")).alias("consistency"),
        F.array_sort(F.collect_set("p_brand")).alias("targets"))
    g = g.select("*", F.col("canonical").alias("drug"), F.when(F.length("canonical") % 3 == 0, "cluster_drug_table").otherwise("compact_gctx").alias("source"))
    return rank_percentile(g, "reversal_score", ["canonical"])


def drug_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = drug_rows(spark, folder)
    return (ranked_list(d.where((F.col("l_returnflag") == "A") & (F.col("p_size") <= 40))),
            ranked_list(d.where((F.col("l_returnflag") == "R") & (F.col("p_size") >= 10))))


def _list_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT *, canonical AS drug, CASE WHEN length(canonical) % 3 = 0 THEN 'cluster_drug_table' ELSE 'compact_gctx' END AS source,
    row_number() OVER (ORDER BY reversal_score DESC, canonical) AS rank,
    1.0 - (row_number() OVER (ORDER BY reversal_score DESC, canonical) - 1.0) / greatest(count(*) OVER () - 1, 1) AS percentile
  FROM (SELECT canonical, round(avg(l_discount * l_quantity), 9) AS reversal_score, count(*) AS n_signatures, count(DISTINCT l_suppkey % 3) AS n_cell_lines,
    avg(CAST(l_discount > 0.05 AS INTEGER)) AS consistency, list_sort(list(DISTINCT p_brand)) AS targets FROM d WHERE {where} GROUP BY 1))"""


D = """d AS (SELECT lower(concat(p_name, ' ', p_partkey % 50)) AS canonical, l_returnflag, p_size, l_discount, l_tax, l_quantity, l_suppkey, p_brand, p_type, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
LISTS = D + ", " + _list_sql("l1", "l_returnflag = 'A' AND p_size <= 40") + ", " + _list_sql("l2", "l_returnflag = 'R' AND p_size >= 10")
