"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.shared import Written, ascii_lower, keyed, let

# Fixed value: what parts words once A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word: in the index it stands after a document's last word, so that its place is their number.
END = ""
#: Index terms that are sent to every task (some 10 MB); more are joined by a shuffle.
SHARED_TERMS = 200_000


def words_of(text: Column) -> Column:
    """Words in order, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _common(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return let(equal, lambda e: let(F.array_position(e, False), lambda p: F.when(p == 0, F.size(e)).otherwise((p - 1).cast("int"))))


def _shared(df: DataFrame) -> DataFrame:
    """`df` for a join: broadcast after counting it, if it is small."""
    return F.broadcast(df) if df.limit(SHARED_TERMS + 1).count() <= SHARED_TERMS else df


def _tokens(rows: DataFrame) -> DataFrame:
    """One row a word, and one for the END of each document."""
    return rows.select("*", F.posexplode_outer(F.array_append("words", F.lit(END))).alias("pos", "term"))


def phrase_pairs(items: DataFrame, frequencies: DataFrame, window: int) -> DataFrame:
    """item_id, pair, width, q0, q1, term0, term1, item_before, item_after: the two rarest terms of every window.

    `items` has item_id and lower-cased words. q0 and q1 are places in the item (q1 null where a
    window is one word); item_before and item_after are the item's words around q0, nearest first, as many
    as a window can reach. Equally frequent terms are taken in order.
    """
    placed = items.select("item_id", "words", F.posexplode("words").alias("q", "term")).join(frequencies, "term", "left")
    rare = placed.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("terms"))
    order = F.transform("terms", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"), x["q"].alias("q")))
    width = F.least(F.lit(window), F.size("words"))
    windows = F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("width") + 1),
        lambda s: let(F.sort_array(F.slice("order", s, F.col("width"))), lambda z: F.struct(F.get(z, F.lit(0))["q"].alias("q0"), F.get(z, F.lit(1))["q"].alias("q1"))),
    )
    pairs = rare.select("item_id", "words", width.alias("width"), order.alias("order")).select("item_id", "words", "width", F.explode(F.array_distinct(windows)).alias("p"))
    reach = F.least(F.col("p.q0"), F.col("width") - 1)
    return pairs.select(
        "item_id",
        F.xxhash64("item_id", "words", "p.q0", "p.q1").alias("pair"),
        "width",
        "p.q0",
        "p.q1",
        F.get("words", F.col("p.q0")).alias("term0"),
        F.get("words", F.col("p.q1")).alias("term1"),
        F.reverse(F.slice("words", F.col("p.q0") - reach + 1, reach)).alias("item_before"),
        F.slice("words", F.col("p.q0") + 2, F.col("width") - 1).alias("item_after"),
    )


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, text_hash, pos, before, after: the index, for the terms of `terms` (term, reach).

    before and after are the `reach` words on either side, nearest first, so that a phrase can be
    checked without the text. The END of a document is one of its terms.
    """
    hit = _tokens(rows).join(_shared(terms), "term")
    back = F.least("pos", "reach")
    return hit.select(
        "term",
        "doc_id",
        "text_hash",
        "pos",
        F.reverse(F.slice("words", F.col("pos") - back + 1, back)).alias("before"),
        F.slice("words", F.col("pos") + 2, F.col("reach")).alias("after"),
    )


def build_index(docs: DataFrame, items: DataFrame, window: int) -> tuple[Written, Written]:
    """The written postings of all documents and the written phrase pairs of all items.

    `docs` has doc_id, text, text_hash; `items` has item_id, text. First the benchmark's terms are
    counted over the whole corpus; then every window's two rarest terms are indexed.
    """
    rows = docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    own = items.select("item_id", words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0).distinct()
    known = Written(own)
    terms = known.df.select(F.explode("words").alias("term")).distinct()
    seen = rows.select(F.explode_outer("words").alias("term"))
    frequencies = Written(seen.join(_shared(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    pairs = Written(phrase_pairs(known.df, frequencies.df, window))
    wanted = pairs.df.select(F.col("term0").alias("term"), (F.col("width") - 1).alias("reach")).union(pairs.df.where("term1 IS NOT NULL").select("term1", F.lit(0)))
    wanted = wanted.union(docs.sparkSession.range(1).select(F.lit(END), F.lit(0)))
    index = Written(postings(rows, wanted.groupBy("term").agg(F.max("reach").alias("reach"))))
    known.drop()
    frequencies.drop()
    return index, pairs


def candidates(index: DataFrame, pairs: DataFrame, slop: int = 0) -> DataFrame:
    """Postings of a window's rarest term, with its item, where its second rarest stands as in the item.

    Positions are adjusted by the term's place in the item, so that words in the item's order share
    one offset; the two lists are intersected on (document, pair, offset). With `slop`, offsets may
    differ by so many words and meet in buckets of slop + 1. Windows of one word have one list.
    """
    bucket = lambda x: F.floor(x / F.lit(slop + 1)).cast("long")
    first = index.join(pairs, F.col("term") == F.col("term0")).withColumn("offset", F.col("pos") - F.col("q0")).withColumn("meet", bucket(F.col("offset")))
    second = (
        index.select("term", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "pos")
        .join(pairs.select(F.col("pair").alias("p"), "q1", "term1"), F.col("term") == F.col("term1"))
        .select("d", "t", "p", (F.col("pos") - F.col("q1")).alias("other"))
        .select("*", F.explode(F.array(*[bucket(F.col("other")) + i for i in ([0] if slop == 0 else [-1, 0, 1])])).alias("m"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("pair") == F.col("p")) & (F.col("meet") == F.col("m"))
    both = first.where("q1 IS NOT NULL").join(second, same & (F.abs(F.col("offset") - F.col("other")) <= slop), "left_semi")
    return both.union(first.where("q1 IS NULL"))


def _runs(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, first, last: the candidates that hold a whole window around their rarest term."""
    found = candidates(index, pairs)
    left, right = _common(F.col("before"), F.col("item_before")), _common(F.col("after"), F.col("item_after"))
    run = found.select("doc_id", "text_hash", "item_id", "width", "pos", left.alias("left"), right.alias("right"))
    return run.where("left + right + 1 >= width").select("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, text_hash, item_id, first, last: runs of document words that hold whole item windows.

    `docs` as from shared.keyed; `items` has item_id, text. Every occurrence of a window of
    `window` words (of the whole item, if that is shorter) lies in such a run.
    """
    index, pairs = build_index(docs, items, window)
    return _runs(index.df, pairs.df)


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2) -> DataFrame:
    """doc_id, text_hash, item_id, pos: where a window's two rarest terms stand at their distance in
    the item, give or take `slop` words; pos is the place of the rarest."""
    index, pairs = build_index(docs, items, window)
    return candidates(index.df, pairs.df, slop).select("doc_id", "text_hash", "item_id", "pos").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    One row per row of `docs`, repeated rows included. Null texts have no words; null, empty and
    word-less items have no windows. An item without an id marks words, but is neither counted nor
    listed; repeated item_ids count once. Empty tables give no rows or no hits. Other columns are
    ignored.
    """
    rows = keyed(docs, id_col, text_col)
    index, pairs = build_index(rows, items.select(F.col("item_id").cast("string").alias("item_id"), "text"), window)
    matches = _runs(index.df, pairs.df)
    spans = matches.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_set("item_id").alias("ids"), F.collect_set(F.struct("first", "last")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    hits = spans.select("d", "t", F.array_sort("ids").alias("ids"), covered.cast("long").alias("hit"))
    lengths = index.df.where(F.col("term") == END).select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    joined = lengths.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    item_ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """`docs`, all columns whatever their names, without the documents that hold a window of any item.

    Null and empty texts stay, as do all texts where `items` is empty. Repeated rows stay or go
    together; an empty table gives an empty result.
    """
    text = F.col("row.text").cast("string")
    matches = phrase_matches(keyed(docs, "doc_id", "text"), items.select(F.col("item_id").cast("string").alias("item_id"), "text"), window)
    bad = matches.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(bad, F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t")), "left_anti").select("row.*")
