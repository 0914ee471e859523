"""Line dedup: lines found in many documents stay in one document only. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.shared import Written, ascii_lower, keyed, let

#: What is stripped at both ends of a line: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Seed of the second half of a key's hash.
SECOND = 1


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The lines' keys: stripped at both ends, A-Z lower-cased."""
    return F.transform(F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(BLANKS))), ascii_lower)


def shared_lines(rows: DataFrame, min_docs: int, min_chars: int) -> Written:
    """doc_id, text_hash, pos of the lines to drop, one row for each.

    Counting rows per 64-bit hash leaves out the lines that can't reach `min_docs`; only the others
    are counted by document, under a hash of 128 bits.
    """
    keys = keys_of(F.col("text"))
    long_keys = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    hashes = rows.select(F.explode(F.array_distinct(F.transform(long_keys, lambda k: F.xxhash64(k)))).alias("h"))
    often = Written(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h"))
    found = rows.select("doc_id", "text_hash", F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    found = found.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(SECOND), "key").alias("h2"))
    held = Written(found.join(often.df, "h"))
    often.drop()
    by_doc = held.df.select("h", "h2", "doc_id").distinct()
    last = by_doc.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    # Written first: a join of two plain shuffles is one whose hot keys Spark splits.
    keepers = Written(last.select("h", "h2", "keeper"))
    gone = held.df.join(keepers.df, ["h", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    dropped = Written(gone.select("doc_id", "text_hash", "pos"))
    held.drop()
    keepers.drop()
    return dropped


def drop_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: one row per row of `docs`.

    Texts are split at \\n. A key of at least `min_chars` code points found in at least `min_docs`
    documents loses all its lines except those of the largest doc_id holding it, which keeps every
    one, repeats included. The other lines stay, joined by \\n; if none stays, `kept` is empty.

    A null or empty text is one empty line. Rows of one doc_id count as one document and each gets
    its own result, repeated rows one by one. Rows without an id together count as one document,
    which comes before all others. An empty table gives an empty result; other columns of `docs`
    are left out and can have any name.
    """
    rows = keyed(docs, id_col, text_col)
    dropped = shared_lines(rows, min_docs, min_chars)
    gone = dropped.df.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    # The list of one text at most: identical rows name the same positions.
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.text_hash").eqNullSafe(F.col("g.text_hash"))
    both = rows.alias("d").join(gone.alias("g"), same, "left").select("d.doc_id", "d.text", "g.gone")
    rest = let(
        lines_of(F.col("text")),
        lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)), "\n"),
    )
    return both.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(rest).alias("kept"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def lines_sql(min_docs: int = 3, min_chars: int = 20) -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT r, doc_id, pos, line, keeper IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
