"""Importance resampling towards a target text distribution, over hashed n-gram features.

n-grams are interned batch by batch in an open-addressed table of NumPy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortgrid.llm.shared import BLOCK_BYTES, Written, blocks, hash_number, text_bytes
from cohortgrid.operators.scans import ranked

#: Words of a feature at most.
LONGEST = 3
#: Bytes as words have them: A-Z lower-cased; a byte is part of a word if it is 0-9, a-z or not ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: The lowest 0 to 8 bytes of a number.
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: The primes of XXH64. Fixed values.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


class Words:
    """The words of some texts, one space between those of a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        inside = IN_WORD[low]
        after = np.zeros(len(data) + 1, bool)  # a word's byte stands just before
        after[1:] = inside
        edges = np.unique(offsets)
        after[edges] = False
        first = inside & ~after[:-1]
        last = inside & ~np.append(inside[1:], False)
        last[edges[(edges > 0)] - 1] = inside[edges[(edges > 0)] - 1]
        keep = inside | after[:-1]
        place = np.cumsum(keep) - 1
        self.bytes = np.where(inside, low, 32)[keep].astype(np.uint8)
        self.begin, self.end = place[first], place[last] + 1
        self.text = np.searchsorted(offsets, np.flatnonzero(first), "right") - 1

    def features(self, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of all runs of 1 to LONGEST words; those that end in the first `carried` words are left out."""
        firsts, lasts = [], []
        for n in range(1, LONGEST + 1):
            last = np.arange(max(carried, n - 1), len(self.begin))
            last = last[self.text[last] == self.text[last - n + 1]]
            firsts.append(last - n + 1)
            lasts.append(last)
        return np.concatenate(firsts), np.concatenate(lasts)


def _pieces(text: np.ndarray) -> Iterator[tuple[Words, int]]:
    """The words of a long text in parts cut between words, each after the last words of the one before, and how many those are."""
    carry, carried, a = np.zeros(0, np.uint8), 0, 0
    while a < len(text):
        b = a + BLOCK_BYTES
        while b < len(text):
            gap = np.flatnonzero(~IN_WORD[LOWER[text[b : b + BLOCK_BYTES]]])
            if len(gap):
                b += int(gap[0])
                break
            b += BLOCK_BYTES
        part = np.concatenate([carry, text[a:b]])
        words = Words(part, np.array([0, len(part)]))
        yield words, carried
        carried = min(LONGEST - 1, len(words.begin))
        carry = words.bytes[words.begin[-carried] : words.end[-1]] if carried else carry[:0]
        a = b


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Words, int]]:
    """first text, texts, words and carried words of parts that hold BLOCK_BYTES or so."""
    for a, b in blocks(offsets):
        whole = data[offsets[a] : offsets[b]]
        if len(whole) <= BLOCK_BYTES:
            yield a, b - a, Words(whole, offsets[a : b + 1] - offsets[a]), 0
        else:
            for words, carried in _pieces(whole):
                yield a, 1, words, carried


class Bytes:
    """The bytes of some texts, with the eight from each place on as one number."""

    def __init__(self, data: np.ndarray):
        self.whole = data.tobytes()
        self.data = data
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.whole + bytes(8), strides=(1,))

    def xxh64(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XXH64 (seed 0) of many spans: those under 32 bytes together, the longer ones by the library."""
        acc = length.astype(np.uint64) + P5
        for i in range(3):
            on = np.flatnonzero(length >= 8 * (i + 1))
            mixed = _turn(self.eight[begin[on] + 8 * i] * P2, 31) * P1
            acc[on] = _turn(acc[on] ^ mixed, 27) * P1 + P4
        at, left = begin + (length & ~7), length & 7
        on = np.flatnonzero(left >= 4)
        acc[on] = _turn(acc[on] ^ (self.eight[at[on]] & BYTES[4]) * P1, 23) * P2 + P3
        at, left = at + (left & 4), left & 3
        for i in range(3):
            on = np.flatnonzero(left > i)
            acc[on] = _turn(acc[on] ^ self.data[at[on] + i].astype(np.uint64) * P5, 11) * P1
        for shift, factor in ((33, P2), (29, P3)):
            acc = (acc ^ (acc >> np.uint64(shift))) * factor
        acc ^= acc >> np.uint64(32)
        for i in np.flatnonzero(length >= 32).tolist():
            acc[i] = xxh64_intdigest(self.whole[begin[i] : begin[i] + length[i]])
        return acc


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _crc_shifts(most: int) -> np.ndarray:
    """[n, k, b]: what byte k of a CRC-32, if b, becomes when n zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(most):
        out[n + 1] = out[n] >> np.uint32(8) ^ step[out[n] & np.uint32(255)]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row, from theirs and the length of the second."""
    out, left = first, length
    while True:
        n = np.minimum(left, len(SHIFTS) - 1)
        out = SHIFTS[n, 0, out & 255] ^ SHIFTS[n, 1, out >> 8 & 255] ^ SHIFTS[n, 2, out >> 16 & 255] ^ SHIFTS[n, 3, out >> 24]
        left = left - n
        if not left.any():
            return out ^ second


#: Shifts by up to so many bytes at once, and the CRC-32 of a space.
SHIFTS, SPACE = _crc_shifts(64), crc32(b" ")


class Interned:
    """An open-addressed table of the features of some words. `slot` holds each occurrence's place; `bucket` and `count` are by place."""

    def __init__(self, words: Words, carried: int, buckets: int):
        bytes_ = Bytes(words.bytes)
        self.eight = bytes_.eight
        self.first, self.last = words.features(carried)
        self.text = words.text[self.last]
        self.begin = words.begin[self.first]
        self.length = words.end[self.last] - self.begin
        self.key = bytes_.xxh64(self.begin, self.length)
        n = len(self.begin)
        size = 1 << max(1, (2 * n - 1).bit_length())
        self.owner = np.full(size, -1, np.int32)
        self.slot = np.empty(n, np.int32)
        at, left = (self.key & np.uint64(size - 1)).astype(np.int32), np.arange(n, dtype=np.int32)
        while len(left):
            free = np.flatnonzero(self.owner[at] < 0)
            self.owner[at[free]] = left[free]  # one of those that want a free place gets it
            same = self._equal(self.owner[at], left)
            self.slot[left[same]] = at[same]
            left, at = left[~same], at[~same] + 1 & size - 1
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        used = np.flatnonzero(self.owner >= 0)
        self.bucket[used] = self._crc(words, bytes_.whole, self.owner[used]) % buckets

    def _crc(self, words: Words, whole: bytes, owner: np.ndarray) -> np.ndarray:
        """CRC-32 of the strings numbered `owner`: the words' own, joined to those of the runs."""
        # Single words are the first features; each distinct one is its slot's owner once. Carried words are in runs alone.
        crc = np.empty(len(words.begin), np.uint32)
        carried = len(words.begin) - np.searchsorted(self.last - self.first, 1)
        one = self.owner[self.slot[: len(crc) - carried]]
        own = np.flatnonzero(one == np.arange(len(one)))
        single = np.empty(len(one), np.uint32)
        single[own] = [crc32(whole[a:b]) for a, b in zip(words.begin[carried + own].tolist(), words.end[carried + own].tolist())]
        crc[carried:] = single[one]
        crc[:carried] = [crc32(whole[a:b]) for a, b in zip(words.begin[:carried].tolist(), words.end[:carried].tolist())]
        first, last = self.first[owner], self.last[owner]
        out = crc[last]
        length = (words.end - words.begin)[last]
        for back in range(1, LONGEST):
            on = np.flatnonzero(last - first >= back)
            word = last[on] - back
            spaced = joined_crc(crc[word], np.uint32(SPACE), np.ones(len(on), np.int64))
            out[on] = joined_crc(spaced, out[on], length[on])
            length[on] += (words.end - words.begin)[word] + 1
        return out

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings numbered a and b are the same: the hashes, then the lengths, then every byte, eight at once."""
        same = a == b
        ask = np.flatnonzero(~same & (self.key[a] == self.key[b]))
        left = self.length[a[ask]]
        fits = left == self.length[b[ask]]
        ask, left = ask[fits], left[fits]
        same[ask] = True
        x, y = self.begin[a[ask]], self.begin[b[ask]]
        while len(ask):
            differs = ((self.eight[x] ^ self.eight[y]) & BYTES[np.minimum(left, 8)]) != 0
            same[ask[differs]] = False
            more = ~differs & (left > 8)
            ask, left, x, y = ask[more], left[more] - 8, x[more] + 8, y[more] + 8
        return same


def bucket_counter(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of one text column to (bucket, n): one row for each bucket that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words, carried in parts(*text_bytes(batch.column(0))):
                table = Interned(words, carried, buckets)
                used = np.flatnonzero(table.count)
                np.add.at(n, table.bucket[used], table.count[used])
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["bucket", "n"])

    return run


def weigher(gains: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """n_words, n_features and weight (the sum of the features' gains) of each text."""

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), np.int64)
        for first, n, words, carried in parts(*text_bytes(texts)):
            table = Interned(words, carried, len(gains))
            gain = gains[table.bucket][table.slot]  # of each occurrence, by its slot
            out[0, first : first + n] += np.bincount(words.text[carried:], minlength=n)
            out[1, first : first + n] += np.bincount(table.text, minlength=n)
            # Whole numbers far below 2**53, so the sums of doubles are exact.
            out[2, first : first + n] += np.bincount(table.text, gain, minlength=n).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n_words", "n_features", "weight"])

    return run


def bucket_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features per bucket over all texts: `buckets` numbers, whatever the size of the table."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(bucket_counter(buckets), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    b = len(source)
    whole_s, whole_t = float(source.sum()) + b, float(target.sum()) + b
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole_s / ((s + 1.0) * whole_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(h: Column) -> Column:
    """floor(1000 times a Gumbel variate) of a hash below 2**32."""
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    buckets: int = 10_000,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of `docs`.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all that isn't ASCII; features are all runs of
    1 to 3 words. `weight` is the sum of the gains of a text's features, `score` adds Gumbel noise
    drawn from `seed` and the id. Of the N texts of `min_words` words or more the floor(percent N /
    100) highest scores are drawn; `rank` numbers them from 1, ties to the smaller id, a missing id
    last, then by fewer features. The others have no rank.

    A null or empty text has no features and weight 0; with an empty target or table all buckets
    have equal chances there. Repeated rows each count and each have a rank. An empty table gives an
    empty result; other columns are left out and can have any name.
    """
    gains = bucket_gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_text_col))
    weigh = F.arrow_udf(weigher(gains), "struct<n_words: long, n_features: long, weight: long>")
    rows = docs.select(F.col(id_col).alias("doc_id"), weigh(F.col(text_col).cast("string")).alias("w")).select("doc_id", "w.*")
    scored = Written(rows.withColumn("score", F.col("weight") + noise(hash_number(seed, F.col("doc_id")))))
    enough = F.col("n_words") >= min_words
    draws = (scored.df.where(enough).count() * percent) // 100
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features"), F.monotonically_increasing_id()]
    drawn = ranked(scored.df.where(enough), [], order)
    rank = F.when(F.col("rank") <= draws, F.col("rank"))
    few = scored.df.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", rank).unionByName(few).select("doc_id", "n_features", "weight", "score", "rank")
