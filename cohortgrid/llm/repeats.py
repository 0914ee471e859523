"""Substring dedup by seed and extend: winnowed anchors, extended both ways to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.shared import Written, small_batches

#: Words of an anchor.
GRAM = 8
#: Odd multipliers of the word-sequence hashes (any odd numbers will do).
ONE, TWO = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _inverse(m: int) -> int:
    return pow(m, -1, 1 << 64)


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, m, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word hashes of one text, and hashes of any run of its words."""

    def __init__(self, words: list[bytes], multiplier: int = ONE):
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(map(digest, words), np.uint64, len(words))
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * _powers(multiplier, self.n), out=self.sums[1:])
        self.back = _powers(_inverse(multiplier), self.n)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of words[start:end], equal wherever the words are equal."""
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def split_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space; other space characters are part of words."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start, context hash for every winnowed anchor.

    Each window of `window` words picks its least gram (the leftmost of equal ones). That depends
    on the window's words alone, so equal windows pick equal grams at equal places. The windows
    that share a pick are neighbours; their union is the anchor's context.
    """
    grams = words.n - gram + 1
    at = np.arange(grams)
    h = words.runs(at, at + gram)
    per = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(h, per)
    pick = np.concatenate([v.argmin(axis=1) for v in np.array_split(view, max(1, len(view) >> 13))]) + np.arange(len(view))
    first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
    last = np.concatenate((first[1:], [len(pick)])) - 1
    where = pick[first]
    # The place of the anchor in its context is part of the hash.
    context = words.runs(first, last + window) ^ _mix((where - first).astype(np.uint64))
    return h[where], first, last, context


def spans_of(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside any [start, end)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, context, doc_id, part, first, last: one row per anchor of each document."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, part, text in zip(batch["doc_id"], batch["part"], batch["text"]):
                words = split_words(text)
                if len(words) >= window:
                    a, first, last, context = anchors(Words(words), window, gram)
                    n = len(a)
                    rows.append((a.view(np.int64), context.view(np.int64), np.full(n, doc, np.int64), np.full(n, part, np.int32), first.astype(np.int32), last.astype(np.int32)))
            if rows:
                yield pd.DataFrame(dict(zip(("anchor", "context", "doc_id", "part", "first", "last"), map(np.concatenate, zip(*rows)))))

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(find, "anchor long, context long, doc_id long, part int, first int, last int")


def _extended(leads: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """w1, w2, doc_id, part, start: the windows of the contexts in `leads`.

    The documents' words are read again only here, to extend anchors both ways as far as their context.
    """
    wanted = leads.groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, part, text, spans in zip(batch["doc_id"], batch["part"], batch["text"], batch["spans"]):
                words = split_words(text)
                inside = spans_of(np.array([p["first"] for p in spans]), np.array([p["last"] + 1 for p in spans]), len(words) - window + 1)
                at = np.flatnonzero(inside)
                one = Words(words, ONE).runs(at, at + window)
                two = Words(words, TWO).runs(at, at + window) >> np.uint64(33)
                yield pd.DataFrame({"w1": one.view(np.int64), "w2": two.astype(np.int32), "doc_id": doc, "part": np.int32(part), "start": at.astype(np.int32)})

    joined = docs.join(wanted, ["doc_id", "part"]).dropDuplicates(["doc_id", "part"])
    return joined.mapInPandas(extend, "w1 long, w2 int, doc_id long, part int, start int")


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """doc_id, part, first, last: runs of window starts whose windows also start in a smaller doc_id.

    `docs` has doc_id, part, text. Anchors are winnowed so that every window has one, and joined
    where they occur in two documents. An anchor with one context everywhere needs nothing more:
    the smallest id keeps it, and all its windows in the others are repeats. The same holds for
    equal contexts of the other anchors. Only where equal anchors stand in unequal contexts, at the
    edges of repeats, are they extended both ways window by window, for the first document of each
    context. All steps sum up before they shuffle; no pairs of documents are made. Runs of words
    are compared by hashes of 95 bits or more.
    """
    small_batches(docs.sparkSession)
    seeds = Written(_seeds(docs, window, gram))
    by_anchor = seeds.df.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min("context") != F.max("context")).alias("mixed"))
    shared = Written(by_anchor.where("least < most").select("anchor", "least", "mixed"))
    found = Written(seeds.df.join(shared.df, "anchor"))
    seeds.drop()
    shared.drop()
    mixed = found.df.where("mixed")
    kinds = Written(mixed.groupBy("anchor", "context").agg(F.min("doc_id").alias("lead_id")))
    told = Written(mixed.join(kinds.df, ["anchor", "context"]).select("doc_id", "part", "first", "last", "lead_id"))
    kinds.drop()
    windows = Written(_extended(told.df.where("doc_id = lead_id"), docs, window))
    firsts = Written(windows.df.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least"))
    columns = ["doc_id", "part", "first", "last"]
    alone = found.df.where("NOT mixed AND doc_id > least").select(columns)
    equal = told.df.where("doc_id > lead_id").select(columns)
    edges = windows.df.join(firsts.df, ["w1", "w2"]).where("doc_id > least").select("doc_id", "part", F.col("start").alias("first"), F.col("start").alias("last"))
    return alone.union(equal).union(edges)


def _cutter(window: int):
    """(text, spans) to the words' number, the number removed and the words kept."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, spans):
            words = split_words(text)
            gone = 0
            n = len(words)
            if found is not None and len(found):
                pairs = np.array([(p["first"], p["last"]) for p in found], np.int64)
                mask = spans_of(pairs[:, 0], pairs[:, 1] + window, n)
                gone = int(mask.sum())
                words = [w for w, m in zip(words, mask.tolist()) if not m]
            out.append((n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return cut


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, n_words, n_removed, kept: one row per row of `docs`; part tells texts of one id apart.

    Words are runs without ASCII white space, unchanged, of whole texts. A word goes if a window
    of `window` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. kept: the other words joined by one space. Null: no words. Repeats within
    one document, or between rows of one id, stay. Rows without an id neither lose nor take words.
    Repeated rows come back as often as given. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("part"), text.alias("text"))
    spans = repeated_spans(rows, window, gram).groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    joined = rows.join(spans, ["doc_id", "part"], "left")
    return joined.select("doc_id", "part", _cutter(window)("text", "spans").alias("c")).select("doc_id", "part", "c.n_words", "c.n_removed", "c.kept")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """`docs`, all columns, with repeated passages cut out of text.

    A document that loses words gets the other words, joined by one space, as text and their
    length as n_chars (where there is such a column); one that loses all goes; every other row,
    null and empty texts included, stays as it is. Which words go is as in remove_repeats.
    """
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("part"), text.alias("text"))
    spans = repeated_spans(rows.select("doc_id", "part", "text"), window).groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    cut = F.col("spans").isNotNull()
    joined = rows.join(spans, ["doc_id", "part"], "left").select("row", "text", cut.alias("cut"), _cutter(window)(F.when(cut, F.col("text")), "spans").alias("c"))
    new = {"text": F.when(F.col("cut"), F.col("c.kept")).otherwise(F.col("text"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("cut"), F.char_length("c.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.where("NOT cut OR c.n_words > c.n_removed").select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
