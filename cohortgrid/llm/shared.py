"""Small helpers of the text operators: bound expressions, row keys, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgrid.session import shared_folder

#: What ASCII lower-casing maps, as text.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows handed to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python workers in batches of BATCH_ROWS at most, so that several workers fit beside one heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(word: Column) -> Column:
    """A-Z to a-z, every other letter unchanged."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_hash: rows of one id with different texts stay apart.

    Every other column is left out, so extra columns of any name cannot clash.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
    )


def hash_number(seed: int, key: Column, group: int = 0) -> Column:
    """The given 8-digit group of the hex sha256 of `seed:key` as an unsigned number; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


#: Bytes of text worked on at once in a Python worker; a longer text stands alone.
BLOCK_BYTES = 1 << 18


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and ends in them; a null text is empty."""
    whole = texts.fill_null("") if texts.null_count else texts
    _, offsets, data = whole.buffers()
    wide = pa.types.is_large_string(whole.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64) if len(whole) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of BLOCK_BYTES together, or one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = b


class Written:
    """A table in the folder named by spark.checkpoint.dir, which can be removed again."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
