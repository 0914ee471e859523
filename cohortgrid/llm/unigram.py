"""Token counts: Viterbi over a unigram vocabulary that carries the best score and its piece count."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgrid.llm.shared import small_batches

#: What stands for a blank.
BLANK = "▁"
#: By how much an unknown character scores below the lowest piece.
UNKNOWN = 10.0
#: Segments whose counts a Python worker keeps.
CACHE = 1 << 17


class Counter:
    """Counts the pieces of the best segmentation without building it.

    A text is its blanks replaced by U+2581, with one in front. Of two segmentations that end at
    the same place with equal scores the one whose last piece starts first stays, as a later one
    must score higher. A character without a piece of its own is unknown and counts as its
    UTF-8 bytes (byte fallback).
    """

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        # Where no piece reaches over, and sums of whole-number scores are exact, parts are counted alone.
        inner = {c for p, _ in pieces if len(p) > 1 for c in p}
        parted = all(float(s).is_integer() for _, s in pieces) and not any(BLANK in p.lstrip(BLANK) for p, _ in pieces)
        alone = re.escape("".join(c for c in "\t\n\r" if c not in inner))
        self.split = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" + (f"|[{alone}]" if alone else "")).findall if parted else (lambda text: [text])
        self.counts: dict[str, int] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation.

        The automaton gives the pieces that end at each place, the longest first.
        """
        if not self.single.issuperset(text):
            return self._best_with_unknown(text)
        score, count, at = [0.0], [0], -1
        for last, (length, value) in self.automaton.iter(text):
            begin = last + 1 - length
            s = score[begin] + value
            if last != at:
                at = last
                score.append(s)
                count.append(count[begin] + 1)
            elif s > score[-1]:
                score[-1], count[-1] = s, count[begin] + 1
        return score[-1], count[-1]

    def _best_with_unknown(self, text: str) -> tuple[float, int]:
        ends: dict[int, list[tuple[int, float]]] = {}
        for last, match in self.automaton.iter(text):
            ends.setdefault(last + 1, []).append(match)
        score, count = [0.0], [0]
        for end, c in enumerate(text, 1):
            ways = [(score[end - n] + value, count[end - n] + 1) for n, value in ends.get(end, ())]
            if c not in self.single:
                ways.append((score[-1] + self.unknown, count[-1] + len(c.encode("utf-8", "surrogatepass"))))
            best = max(ways, key=lambda w: w[0])  # the first of equal ones
            score.append(best[0])
            count.append(best[1])
        return score[-1], count[-1]

    def count(self, text: str) -> int:
        counts, n = self.counts, 0
        for part in self.split(BLANK + text.replace(" ", BLANK)):
            found = counts.get(part)
            if found is None:
                found = self.best(part)[1]
                if len(counts) < CACHE and len(part) <= 64:
                    counts[part] = found
            n += found
        return n


@functools.lru_cache(maxsize=2)
def counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    """One for each Python worker: its cache lives as long as the worker."""
    return Counter(pieces)


def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a SentencePiece model file, read on the driver: a few MB, whatever the data."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


def token_count(text: Column, spark: SparkSession, path: str) -> Column:
    """Number of pieces of whole texts, as a long; null and empty texts have none."""
    small_batches(spark)
    pieces = spark.sparkContext.broadcast(vocabulary(path))

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        c = counter(pieces.value)
        return pd.Series([c.count(t) if t else 0 for t in texts], dtype="int64")

    return run(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens: one row per row of `docs`.

    Whole texts; null and empty ones have 0 of both. Repeated rows come back as often as given;
    other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), token_count(text, docs.sparkSession, path).alias("n_tokens"))
