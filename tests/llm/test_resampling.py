import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from cohortgrid.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def features(t):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=5, least=20, b=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % b
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([t for _, t in rows], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (ss + b) / ((s[k] + 1) * (tt + b))))
    out = []
    for d, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(k)) for k in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, x) in zip(out, rows) if len(words(x)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def some_texts(rng, n):
    vocabulary = ["the", "The", "é", "É", "naïve", "x1", "a", "b", "0", "long" * 12, "日本", "\xa0z"]
    gaps = [" ", "  ", "\n", ", ", "-", "_", "\x00", "\t", "."]
    return ["".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_brute_force(make, spark):
    rng = random.Random(5)
    rows = list(enumerate(some_texts(rng, 300)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "w " * 30), (None, "w " * 30), (7, rows[7][1]), (7, rows[8][1])]
    target = some_texts(rng, 20) + [None, ""]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    for percent, least in ((5, 20), (50, 1), (100, 0)):
        got = resampling.resample(make(rows), bench, percent, least)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, percent, least)


def test_words_and_features_of_any_block_size(monkeypatch):
    rng = random.Random(6)
    texts = [*some_texts(rng, 60), None, "", "a", "..a..b c", "é" * 400, "x" * 500 + " y", " ".join(some_texts(rng, 20))]
    run = resampling.weigher(np.arange(10_000) % 97)
    want = [(len(words(t)), len(f := features(t)), sum(zlib.crc32(x.encode()) % 10_000 % 97 for x in f)) for t in texts]
    for size in (1, 7, 64, 300, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK_BYTES", size)
        monkeypatch.setattr("cohortgrid.llm.shared.BLOCK_BYTES", size)
        got = run(pa.array(texts)).to_pylist()
        assert [(r["n_words"], r["n_features"], r["weight"]) for r in got] == want


def test_strings_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(resampling.Bytes, "xxh64", lambda self, begin, length: np.full(len(begin), 5, np.uint64))
    texts = ["one two three one two four", "one two"]
    got = resampling.weigher(np.arange(10_000))(pa.array(texts)).to_pylist()
    assert [r["weight"] for r in got] == [sum(zlib.crc32(x.encode()) % 10_000 for x in features(t)) for t in texts]


def test_table_counts_and_slots():
    x = resampling.Words(np.frombuffer(b"a b a b a", np.uint8), np.array([0, 9]))
    table = resampling.Interned(x, 0, 10_000)
    got = {bytes(x.bytes[table.begin[o] :][: table.length[o]]): (table.bucket[p], table.count[p]) for p, o in enumerate(table.owner) if o >= 0}
    assert got == {f.encode(): (zlib.crc32(f.encode()) % 10_000, n) for f, n in Counter(features("a b a b a")).items()}


def test_hashes_of_spans_of_any_length():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    begin = rng.integers(0, 300, 400)
    length = rng.integers(0, 200, 400)
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for a, n in zip(begin, length)]
    assert resampling.Bytes(data).xxh64(begin, length).tolist() == want
    first, second = rng.bytes(30), [rng.bytes(int(n)) for n in length]
    got = resampling.joined_crc(np.full(400, zlib.crc32(first), np.uint32), np.array([zlib.crc32(x) for x in second], np.uint32), length)
    assert got.tolist() == [zlib.crc32(first + x) for x in second]


def test_very_long_text(make, spark):
    rng = random.Random(7)
    long = " ".join(rng.choice(["alpha", "beta", "Ωmega", "x" * 40]) for _ in range(300_000))
    rows = [(1, long), (2, "y" * 3_000_000), (3, "alpha beta " * 12)]
    bench = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    assert sorted(map(tuple, resampling.resample(make(rows), bench, 50).collect()), key=str) == brute(rows, ["alpha beta gamma"], 50)


def test_empty_tables_and_clashing_columns(make, spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert resampling.resample(make([]), none).collect() == []
    odd = spark.createDataFrame([(1, "b a " * 20, 4, 9.5, "x")], "doc_id long, text string, score int, weight double, rank string")
    got = resampling.resample(odd, none, 100)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert list(map(tuple, got.collect())) == brute([(1, "b a " * 20)], [], 100)
