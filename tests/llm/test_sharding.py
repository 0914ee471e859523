import random
import zlib

from cohortgrid.llm import sharding


def check(rows, got, n):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["shard"] for r in got} <= set(range(n))
    for s in range(n):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    home = {}
    for r in got:
        assert home.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    return [sum(r["size"] for r in got if r["shard"] == s) for s in range(n)]


def test_near_equal_bytes_and_groups_together(make):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 60) + str(i)) for i in range(2000)]
    rows += [(3000 + i, "copy") for i in range(300)] + [(4000, None), (4001, ""), (4002, "é" * 30), (4002, "é" * 30)]
    got = sharding.digests(make(rows)).collect()
    totals = check(rows, got, 8)
    assert max(totals) - min(totals) <= 2 * 70 and all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)


def test_groups_larger_than_a_share(make):
    rows = [(i, "big" * 20) for i in range(500)] + [(600 + i, "second" * 10) for i in range(300)] + [(1000 + i, f"t{i}") for i in range(900)]
    totals = check(rows, sharding.shards(make(rows), 8).collect(), 8)
    assert sorted(totals)[-2:] == [300 * 61, 500 * 61]
    rest = sorted(totals)[:-2]
    assert min(rest) > 0 and max(rest) - min(rest) < 60


def test_few_rows(make, spark):
    assert sharding.digests(make([])).count() == 0
    for n in (1, 2, 5):
        rows = [(i, "a" * (i + 1)) for i in range(n)]
        check(rows, sharding.shards(make(rows), 8).collect(), 8)
    odd = spark.createDataFrame([(1, "a", 9, "x")], "doc_id long, text string, size int, h string")
    assert sharding.shards(odd).head()["size"] == 2
