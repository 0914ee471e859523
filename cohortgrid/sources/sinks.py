"""Writers: ledgers, nested documents, flat evidence exports and partitioned assignment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_ledger(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Non-finite floats to null at any depth, so that every document is valid JSON."""

    def fix(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: fix(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: fix(v, t.valueType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
        return c

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_documents(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One JSON document per row; `partition` gives one folder per cohort."""
    w = json_safe(df).write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).json(path)


EVIDENCE_COLUMNS = ["canonical", "nomination_rank", "support_class", "weaker_percentile", "rank_product", "evidence_tier", "targets", "notes"]


def flatten_evidence(nominations: DataFrame) -> DataFrame:
    """Nested nomination rows to a fixed flat column list with arrays joined by `;`."""
    types = dict(nominations.dtypes)
    return nominations.select(*[F.array_join(c, ";").alias(c) if types[c].startswith("array") else F.col(c).cast("string").alias(c) for c in EVIDENCE_COLUMNS])


def export_evidence(nominations: DataFrame, path: str) -> None:
    flatten_evidence(nominations).write.mode("overwrite").csv(path, header=True)


def write_assignments(df: DataFrame, path: str) -> None:
    """Assignments of every configuration, one folder per configuration, rows spread within each."""
    df.write.mode("overwrite").partitionBy("config_id").parquet(path)
