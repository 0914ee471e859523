"""Byte-level BPE as a streaming transducer with a bounded lookahead."""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgrid.llm.shared import small_batches

# Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the same pattern spelt out for text below U+0250, without the fractions and
# superscripts there and the separators U+001C to U+001F, on which the two regex modules differ.
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
BLANK = "\t-\r \x85\xa0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{BLANK}{LATIN}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
OTHER = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]"
#: Entries of the piece cache of one Python worker (about 30 MB); beyond it pieces are worked out again.
CACHE = 1 << 17
#: Bytes that a long piece is read ahead of the lookahead at once.
STEP = 4096
#: Pieces up to this many bytes are merged by scanning, longer ones with a heap.
SHORT = 48
#: Ids handed to the byte-to-text machine at once.
IDS = 1 << 14


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after which tokens can no longer change, whatever follows.

    Take two texts with a common start and apply the merges in order. At first their tokens agree
    up to the end of the common start. A merge (u, v) moves that frontier left only when the last
    agreed token is u and it is joined to v across the frontier in one of the texts; the frontier
    then moves by the length of u. In the next such merge, v must begin with the token at the
    frontier, so u of the earlier merge lies on the left spine of v. The longest chain of this
    kind, in merge order, bounds how far the frontier can move.
    """
    best: dict[str, int] = {}
    left: dict[str, str] = {}
    most = 0
    for u, v in merges:
        reach, part = 0, v
        while part:
            reach = max(reach, best.get(part, 0))
            part = left.get(part, "")
        best[u] = max(best.get(u, 0), reach + len(u))
        most = max(most, best[u])
        left.setdefault(u + v, u)
    return most


class Pieces(dict):
    """Ids of pieces as little-endian bytes, worked out when first asked for; bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= 64 and len(self) < CACHE:
            self[piece] = ids
        return ids


class Transducer:
    """Encoder and decoder of one tokenizers file (byte-level BPE without a normalizer)."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer and prefix space")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {u + v: k for k, (u, v) in reversed(list(enumerate(merges)))}
        if len(made) < len(merges) or any(made.get(x, -1) >= k for k, m in enumerate(merges) for x in m):
            raise ValueError("a merge uses a token that a later merge makes")
        vocab = model["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.lengths = {i: len(b) for i, b in self.bytes_of.items()}
        # (left << 20 | right) -> (rank << 20 | merged)
        self.rules = {vocab[u] << 20 | vocab[v]: k << 20 | vocab[u + v] for k, (u, v) in enumerate(merges)}
        self.longest = max(self.lengths.values())
        self.lookahead = sufficient_lookahead(merges)
        self.special = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that strip or look at words aren't supported")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.any_split, self.latin_split, self.other = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall, re.compile(OTHER).search
        self.pieces = Pieces(lambda data: self.stream(data))

    def _scan(self, data: bytes) -> list[int]:
        """Merge a short run: the lowest rank first, the leftmost of equal ones."""
        ids = [self.first[b] for b in data]
        get, none = self.rules.get, 1 << 62
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            ids[at : at + 2] = [low & 0xFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | ids[at], none)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 20 | ids[at + 1], none)
        return ids

    def _heap(self, data: bytes) -> list[int]:
        """The same with a heap, for long runs."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rules.get
        heap = [(r >> 20, i, r & 0xFFFFF, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, merged, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for x, y in ((prior[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r >> 20, x, r & 0xFFFFF, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """The tokens of one piece, each once no following byte can change it.

        At most lookahead + STEP bytes are looked at together. A boundary between final tokens
        cuts the piece in two parts that are merged independently, so the rest starts anew there.
        """
        step = max(STEP, self.longest)
        window = self.lookahead + step
        at = 0
        while len(data) - at > window:
            end = at + step
            for token in self._heap(data[at : at + window]):
                size = self.lengths[token]
                if at + size > end:
                    break
                at += size
                yield token
        rest = data[at:]
        yield from self._scan(rest) if len(rest) <= SHORT else self._heap(rest)

    def split(self, text: str) -> list[str]:
        return self.any_split(text) if self.other(text) else self.latin_split(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.pieces.__getitem__
        if self.marks is None or not self.marks.search(text):
            return b"".join(map(get, self.split(text)))
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += map(get, self.split(text[at : m.start()]))
            out.append(array("I", [self.special[m[0]]]).tobytes())
            at = m.end()
        return b"".join([*out, *map(get, self.split(text[at:]))])

    def decode(self, ids: bytes) -> str:
        """Text of ids: a UTF-8 machine is fed the tokens' bytes and keeps an open character only."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get, out = self.bytes_of.__getitem__, []
        for at in range(0, len(ids), 4 * IDS):
            out.append(machine.decode(b"".join(map(get, array("I", ids[at : at + 4 * IDS])))))
        return "".join(out) + machine.decode(b"", True)


@functools.lru_cache(maxsize=2)
def transducer(definition: str) -> Transducer:
    """One for each Python worker: its cache lives as long as the worker."""
    return Transducer(definition)


def _definition(spark: SparkSession, path: str):
    """The tokenizer file, read on the driver: a few MB, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(text: Column, spark: SparkSession, path: str) -> Column:
    """struct(ids binary, decoded string) of whole texts in one pass; null counts as empty.

    ids are little-endian unsigned 32-bit integers, decoded is the text of those ids. Special
    tokens' strings in a text are those tokens. `path` is a tokenizers file.
    """
    small_batches(spark)
    definition = _definition(spark, path)

    @F.pandas_udf("ids binary, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        t = transducer(definition.value)
        ids = [t.encode(x or "") for x in texts]
        return pd.DataFrame({"ids": ids, "decoded": [t.decode(x) for x in ids]}, columns=["ids", "decoded"])

    return run(text)


def decode(ids: Column, spark: SparkSession, path: str) -> Column:
    """Text of a binary column of ids; null stays null."""
    definition = _definition(spark, path)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        t = transducer(definition.value)
        return pd.Series([None if x is None else t.decode(bytes(x)) for x in values], dtype=object)

    return run(ids)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of `docs`.

    Null and empty texts have no tokens. Repeated rows come back as often as given; other columns
    are ignored; an empty table gives an empty result.
    """
    done = docs.select(F.col(id_col).alias("doc_id"), encode_decode(F.col(text_col).cast("string"), docs.sparkSession, path).alias("bpe"))
    return done.select(
        "doc_id",
        (F.octet_length("bpe.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
