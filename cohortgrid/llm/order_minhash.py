"""Document fingerprints by Order MinHash, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.llm.shared import Written, keyed, let

#: Words of a k-mer, bins of a fingerprint, k-mers chosen in a bin.
K, BINS, CHOSEN = 3, 64, 2
#: A word of more bytes is cut into pieces, so that text without blanks has k-mers too: before a character
#: wherever the hash of it and the two before it is divisible by EVERY.
PIECE, EVERY = 24, 8


def _number(row: Column, at: Column, bits: Column) -> Column:
    """A hash with its lowest bits replaced by a position."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return row.bitwiseOR(low) - low + at


def _position(packed: Column, bits: Column) -> Column:
    return packed.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")


def _upper(packed: Column, bits: Column) -> Column:
    return F.call_function("shiftright", packed, bits)


def _cut(word: Column) -> Column:
    """A long word with blanks between its pieces. The places depend on the characters around them alone."""
    here = lambda c, x, i: (i > 0) & (F.pmod(F.xxhash64(F.get(c, i - 2), F.get(c, i - 1), x), F.lit(EVERY)) == 0)
    return let(F.split(word, ""), lambda c: F.array_join(F.transform(c, lambda x, i: F.when(here(c, x, i), F.concat(F.lit(" "), x)).otherwise(x)), ""))


def _kmers(text: Column, k: int) -> Column:
    """Hashes of the k-mers of a text's pieces, in order; fewer than k pieces are one k-mer."""
    words = F.array_remove(F.split(text, r"\s+"), "")
    long = lambda x: F.octet_length(x) > PIECE
    cut = lambda w: F.split(F.array_join(F.transform(w, lambda x: F.when(long(x), _cut(x)).otherwise(x)), " "), " ")
    pieces = let(words, lambda w: F.when(F.exists(w, long), cut(w)).otherwise(w))
    run = lambda p: F.transform(F.slice(p, 1, F.size(p) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(p, i + j) for j in range(1, k)]))
    return let(pieces, lambda p: F.when(F.size(p) >= k, run(p)).otherwise(F.array(F.xxhash64(text))))


def _occurrences(order: Column, bits: Column) -> Column:
    """Packed (k-mer, place), sorted, to structs (place, occurrence number).

    First occurrences are number 0. The repeats among them form runs; a repeat's number is its
    distance from the start of its run, found by doubling steps, so that a text made of one line
    many times takes n log n work too.
    """
    is_first = lambda x, i: (i == 0) | (_upper(x, bits) != _upper(F.get(order, i - 1), bits))
    firsts = F.transform(F.filter(order, is_first), lambda x: F.struct(_position(x, bits).alias("at"), F.lit(0).alias("number")))

    def numbered(again: Column) -> Column:
        starts = F.transform(again, lambda x, i: F.when((i == 0) | (_upper(x, bits) != _upper(F.get(again, i - 1), bits)), i).otherwise(0))

        def step(now: Column, j: Column) -> Column:
            back = F.call_function("shiftleft", F.lit(1), j)
            return F.when(F.size(now) <= back, now).otherwise(F.transform(now, lambda x, i: F.greatest(x, F.coalesce(F.get(now, i - back), F.lit(0)))))

        runs = F.aggregate(F.sequence(F.lit(0), F.lit(29)), starts, step)
        return F.zip_with(again, runs, lambda x, s: F.struct(_position(x, bits).alias("at"), s.alias("start")))

    repeats = let(
        F.filter(order, lambda x, i: ~is_first(x, i)),
        lambda again: F.transform(numbered(again), lambda y, i: F.struct(y["at"].alias("at"), (i - y["start"] + 1).alias("number"))),
    )
    return F.concat(firsts, repeats)


def fingerprint(text: Column, k: int = K, bins: int = BINS) -> Column:
    """array<int> of `bins` entries, each a bin and a hash of its chosen k-mers.

    k-mers are numbered by occurrence; the hash of (k-mer, number) names a bin and an order in it.
    Each bin chooses the two least from its start on; a bin of fewer goes on with those of the next
    bins, the first after the last, so every entry has two k-mers at any length of text. They are
    hashed in the order of the text, so an entry survives only where both stay and keep their order:
    moved, inserted and deleted text costs likeness, as it does edit distance. `bins` is a power of
    two up to 64. Null: null.
    """
    shift = 64 - (bins - 1).bit_length()

    def with_kmers(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h) + 1)).cast("int")
        return let(bits, lambda b: let(F.sort_array(F.transform(h, lambda x, i: _number(x, i, b))), lambda order: entries(h, b, order)))

    def entries(h: Column, bits: Column, order: Column) -> Column:
        ranked = F.sort_array(F.transform(_occurrences(order, bits), lambda o: _number(F.xxhash64(F.get(h, o["at"]), o["number"]), o["at"], bits)))
        bin_of = lambda x: F.shiftrightunsigned(x, shift)

        def pick(r: Column) -> Column:
            new = lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(r, i - 1)))
            heads = F.filter(F.transform(r, lambda x, i: F.when(new(x, i), F.struct(bin_of(x).alias("bin"), i.alias("at")))), lambda y: y.isNotNull())

            def entry(number: Column, i: Column) -> Column:
                a = _position(F.get(r, i), bits)
                b = F.when(F.size(r) > 1, _position(F.get(r, F.pmod(i + 1, F.size(r))), bits))
                mixed = F.xxhash64(F.get(h, F.least(a, b)), F.when(b.isNotNull(), F.get(h, F.greatest(a, b))))
                low = F.shiftrightunsigned(mixed, 6).bitwiseAND(F.lit((1 << 26) - 1))
                return (number * (1 << 26) + low - (1 << 31)).cast("int")

            def start(begun: Column, number: Column) -> Column:
                later = F.get(F.filter(begun, lambda y: y["bin"] >= number), F.lit(0))
                return F.coalesce(later["at"], F.get(begun, F.lit(0))["at"])

            # Hashes are sorted as signed numbers, so that the bins of the second half stand first.
            return let(F.sort_array(heads), lambda begun: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda n: let(start(begun, n), lambda i: entry(n, i))))

        return let(ranked, pick)

    return let(_kmers(text, k), with_kmers)


def likeness(a: Column, b: Column) -> Column:
    """Equal entries as a share of the bins that either fingerprint fills: 0 to 1."""
    bin_of = lambda x: F.call_function("shiftright", x, F.lit(26))
    filled = F.size(F.array_union(F.transform(a, bin_of), F.transform(b, bin_of)))
    return F.size(F.array_intersect(a, b)) / filled


def as_text(entries: Column) -> Column:
    """A fingerprint as 8 hex digits an entry."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + (1 << 31))), 8, "0")), "")


def successors(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, next_id, next_hash, need: each distinct document and the next in descending order.

    `rows` has doc_id, text_hash, n_chars. Rows are dealt by range, numbered inside each part and
    by the parts' totals; the last is followed by the first. Only keys and lengths are shuffled.
    """
    order = [F.desc_nulls_last("doc_id"), F.desc("text_hash")]
    dealt = rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    numbered = Written(dealt.select("*", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    # One row for each part: their number is the session's number of shuffle partitions.
    totals = numbered.df.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = totals.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    placed = Written(numbered.df.join(F.broadcast(before), "part").select("doc_id", "text_hash", "n_chars", (F.col("before") + F.col("place")).alias("rank"), "all"))
    numbered.drop()
    after = placed.df.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.pmod(F.col("rank") - 1, F.col("all")).alias("rank"))
    return placed.df.join(after, "rank").select("doc_id", "text_hash", "next_id", "next_hash", F.floor(F.col("n_chars") / 2).cast("int").alias("need"))


def edited_fingerprints(docs: DataFrame, k: int = K, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, in descending doc_id, after the last the first. Whole texts, one
    row per row of `docs`; null counts as empty. Rows with equal id and text are one document in
    the order; rows of one id with different texts follow by the hash of the text; rows without
    an id come last. A single document is its own next one. An empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    order = Written(successors(rows.select("doc_id", "text_hash", F.char_length("text").alias("n_chars"))))
    # Shuffled once by document; both uses below read the same exchange.
    marked = rows.select("doc_id", "text_hash", "text", fingerprint(F.col("text"), k, bins).alias("own"))
    same = lambda i, h: F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h))
    own = order.df.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "next_id", "next_hash", "need")
    left = marked.join(own, same("i", "h"))
    asked = order.df.select(F.col("next_id").alias("i"), F.col("next_hash").alias("h"), F.col("doc_id").alias("for_id"), F.col("text_hash").alias("for_hash"), "need")
    right = marked.join(asked, same("i", "h")).select("for_id", "for_hash", F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("own").alias("next_own"))
    right = right.dropDuplicates(["for_id", "for_hash"])
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.col("need")), "head")
    joined = left.join(right, same("for_id", "for_hash")).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    marked_twice = joined.select("*", fingerprint(F.col("edited"), k, bins).alias("other"))
    return marked_twice.select(
        "doc_id",
        "n_chars",
        "edited",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    done = edited_fingerprints(docs)
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
