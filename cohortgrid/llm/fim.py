"""Fill-in-the-middle: two cuts at token boundaries, found by rank queries on a wavelet matrix of character classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.shared import blocks, hash_number, text_bytes

#: Classes of code points: no letter A-Z or a-z, the first letter of a run, a later letter of a run.
OTHER, FIRST, LATER = 0, 1, 2
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARKS = ("<P>", "<S>", "<M>")


class Bits:
    """A bit sequence in 64-bit words, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class WaveletMatrix:
    """A sequence of small numbers, one bit sequence for each of their bits, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            one = (symbols >> b & 1).astype(bool)
            self.levels.append((b, Bits(one), len(one) - int(np.count_nonzero(one))))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each position."""
        begin, end = np.zeros_like(at), at
        for b, bits, zeros in self.levels:
            if symbol >> b & 1:
                begin, end = zeros + bits.ones(begin), zeros + bits.ones(end)
            else:
                begin, end = begin - bits.ones(begin), end - bits.ones(end)
        return end - begin


class Cutter:
    """The texts of one block as one sequence of character classes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = (data & 0xC0) != 0x80  # first bytes of code points
        places = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=places[1:])
        self.begin, self.end = places[offsets[:-1]], places[offsets[1:]]
        letter = LETTER[data[lead]]
        follows = np.zeros(len(letter), bool)
        follows[1:] = letter[:-1]
        follows[self.begin[self.begin < len(letter)]] = False
        self.classes = WaveletMatrix(np.where(letter, np.where(follows, LATER, FIRST), OTHER).astype(np.uint8), 2)
        self.tokens_before = self._tokens(self.begin)
        self.n_tokens = self._tokens(self.end) - self.tokens_before

    def _tokens(self, at: np.ndarray) -> np.ndarray:
        """Tokens that begin before each position of the block."""
        return self.classes.rank(OTHER, at) + self.classes.rank(FIRST, at)

    def cut_after(self, k: np.ndarray) -> np.ndarray:
        """Code points of each text's first k tokens, by bisection on the ranks."""
        low, high = self.begin.copy(), self.end.copy()
        for _ in range(int((self.end - self.begin).max(initial=0)).bit_length()):
            middle = (low + high) // 2
            open_ = low < high
            # The last position asked, middle + 1, is the end of the block at most where low < high.
            past = self._tokens(np.where(open_, middle + 1, self.begin)) - self.tokens_before > k
            high = np.where(open_ & past, middle, high)
            low = np.where(open_ & ~past, middle + 1, low)
        return low - self.begin


def cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """n, first, second of each text: its tokens, and the code points before its two cuts."""
    data, offsets = text_bytes(texts)
    one, two = (np.asarray(h, np.int64) for h in (h1, h2))
    out = np.zeros((3, len(texts)), np.int64)
    for a, b in blocks(offsets):
        cutter = Cutter(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = cutter.n_tokens
        k1, k2 = one[a:b] % (n + 1), two[a:b] % (n + 1)
        out[:, a:b] = n, cutter.cut_after(np.minimum(k1, k2)), cutter.cut_after(np.maximum(k1, k2))
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "second"])


def _part(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output: one row per row of `docs`.

    Tokens are runs of letters A-Z and a-z, and all other code points one by one; n is their number.
    Two hashes of `seed` and the id, each modulo n + 1, say after how many tokens prefix and middle
    end. `form` is plain (the text itself) for empty texts, for those that hold a marker and for
    `plain_percent` of the others; else spm in `spm_percent` of the cases, psm in the rest.

    A null text counts as empty, a null id as empty text in the hash. Repeated rows each give a row,
    an empty table an empty result; other columns are left out and can have any name.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h = [hash_number(seed, F.col("doc_id"), i) for i in range(4)]
    find = F.arrow_udf(cuts, "struct<n: long, first: long, second: long>")
    cut = rows.select("*", find("text", h[0], h[1]).alias("cut"), h[2].alias("h3"), h[3].alias("h4"))
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = cut.select("doc_id", "text", "cut.*", form.alias("form"))
    text, first, second = F.col("text"), F.col("first"), F.col("second")
    prefix, middle, suffix = _part(text, F.lit(0), first), _part(text, first, second), F.substring(text, (second + 1).cast("int"), F.char_length(text))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    cutting = F.col("form") != "plain"
    return cut.select("doc_id", "text", "n", "form", F.when(cutting, first).alias("prefix_chars"), F.when(cutting, second - first).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone. No part holds a marker, so the first of each divides."""
    p, s, m = MARKS
    rest = F.substring(output, 4, 2**31 - 1)
    outer = lambda mark: F.split(rest, mark, 2)
    inner = lambda mark: F.split(F.get(outer(mark), F.lit(1)), m, 2)
    psm = F.concat(F.get(outer(s), F.lit(0)), F.get(inner(s), F.lit(1)), F.get(inner(s), F.lit(0)))
    spm = F.concat(F.get(inner(p), F.lit(0)), F.get(inner(p), F.lit(1)), F.get(outer(p), F.lit(0)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    done = transform(docs).drop("text")
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return done.select(*kept, F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def digests_sql(seed: int = 1) -> str:
    """The same rows in DuckDB SQL."""
    numbers = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (SELECT doc_id, t, w, len(w) AS n, {numbers} FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (
  SELECT *, coalesce(array_to_string(w[1 : a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1 : b], ''), '') AS middle, coalesce(array_to_string(w[b + 1 : n], ''), '') AS suffix
  FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
