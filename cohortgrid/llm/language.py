"""Language ID by rank-order profiles of frequent letter n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.llm.shared import small_batches

UNKNOWN = "und"
#: N-grams of a profile.
TOP = 300
#: Rows of the n-gram counts a task holds before it hands them on.
HELD = 1 << 20
WORD = re.compile(r"[^\W\d_]+").findall


def grams(text: str | None) -> np.ndarray | None:
    """Keys of all letter 1- to 3-grams of the text's words, word ends included; None without a letter.

    A key packs the code points, 21 bits each. Grams that reach over a word end are left out.
    """
    words = WORD((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return None
    line = " ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass")
    u = np.frombuffer(line, "<u4").astype(np.int64)
    blank = u == 32
    two = u[:-1] << 21 | u[1:]
    three = two[:-1] << 21 | u[2:]
    return np.concatenate([u[~blank], two, three[~blank[1:-1]]])


def ranked(keys: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent keys, most frequent first, equal ones by key."""
    key, n = np.unique(keys, return_counts=True)
    if len(key) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        key, n = key[n >= least], n[n >= least]
    return key[np.lexsort((key, -n))][:top]


class Profiles:
    """Ranks of each language's most frequent grams."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top = top
        self.names = sorted({lang for lang, _, _ in rows})
        self.keys, self.ranks = [], []
        for name in self.names:
            own = sorted((key, rank) for lang, key, rank in rows if lang == name)
            self.keys.append(np.array([k for k, _ in own], np.int64))
            self.ranks.append(np.array([r for _, r in own], np.int64))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language with the least out-of-place distance, and 1 minus that distance's share of the worst."""
        found = grams(text)
        if found is None or not self.names:
            return UNKNOWN, 0.0
        own = ranked(found, self.top)
        place = np.arange(len(own))
        best, name = None, UNKNOWN
        for lang, keys, ranks in zip(self.names, self.keys, self.ranks):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            away = np.where(keys[at] == own, np.abs(ranks[at] - place), self.top).sum()
            if best is None or away < best:
                best, name = away, lang
        return name, float(1 - best / (self.top * len(own)))


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, top: int = TOP) -> list[tuple[str, int, int]]:
    """(lang, key, rank): the `top` most frequent grams of each language over all rows of `docs` (lang, text).

    Tasks count whole texts and hand on sums; what comes to the driver is `top` rows a language.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def sums() -> pd.DataFrame:
            parts = []
            for lang, keys in held.items():
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                parts.append(pd.DataFrame({"lang": lang, "key": key, "n": n}))
            held.clear()
            return pd.concat(parts)

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                keys = grams(text)
                if keys is not None:
                    held.setdefault(lang, []).append(keys)
                    size += len(keys)
                if size > HELD:
                    yield sums()
                    size = 0
        if held:
            yield sums()

    counts = docs.where("lang IS NOT NULL").select("lang", "text").mapInPandas(count, "lang string, key long, n long")
    total = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    best = total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top)
    return [(r["lang"], r["key"], r["rank"]) for r in best.select("lang", "key", "rank").collect()]


def predict(text: Column, profiles: Profiles) -> Column:
    """struct(lang_pred string, score double) of whole texts."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(text)


def profiles_of(docs: DataFrame, top: int = TOP) -> Profiles:
    """Profiles of all rows with a lang and a doc_id that are not held out (crc32 of the doc_id's digits mod 4 is 2)."""
    small_batches(docs.sparkSession)
    known = docs.where(~_held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return Profiles(learn(known, top), top)


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """`docs` with held_out, lang_pred and score in one struct column `_language`.

    Profiles are learnt as in `profiles_of`; prediction looks at the text alone. Null texts and texts
    without a letter are `und` with score 0; so are all where no row has a language. Equal distances go
    to the first name. Rows without a doc_id are not learnt from and not held out.
    """
    answer = docs.select("*", predict(F.col("text").cast("string"), profiles_of(docs, top)).alias("_answer"))
    return answer.withColumn("_language", F.struct(_held_out(F.col("doc_id")).alias("held_out"), "_answer.lang_pred", "_answer.score")).drop("_answer")


def languages(docs: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of `docs`; an empty table gives none."""
    return identify(docs.select("doc_id", "text", "lang"), top).select("doc_id", "_language.*")


def keep_known(docs: DataFrame, top: int = TOP) -> DataFrame:
    """`docs`, all columns whatever their names, without the texts whose language can't be told.

    Null texts and texts without a letter go. Where no language is learnt (no row has a lang, or all
    that have are held out), every text with a letter stays. Repeated rows stay as often as given; an
    empty table gives an empty result.
    """
    profiles = profiles_of(docs, top)
    row = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row.text").cast("string")
    kept = predict(text, profiles)["lang_pred"] != UNKNOWN if profiles.names else F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return row.where(kept).select("row.*")
