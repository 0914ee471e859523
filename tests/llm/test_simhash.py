import random

import xxhash

from cohortgrid.llm import simhash
from cohortgrid.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.randint(1, 120))
        rows.append((i, " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 6])):
            copy = list(words)
            if c % 2:
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((1000 + 10 * i + c, "\t ".join(copy).upper() if c == 2 else " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "alone here"), (5003, "É é ß"), (5003, "É é ß"), (5004, "one two three four " * 3000)]
    return rows


def test_matches_all_pairs(make, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rows = corpus()
    got = simhash.near_duplicates(make(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_small_tiles_lose_no_link(make, spark):
    rows = corpus(2)
    values = spark.createDataFrame([(simhash._signed(f),) for f in {plain(t) for _, t in rows}], "fp long")
    one = {tuple(r) for r in components(simhash.links(values)).collect()}
    many = {tuple(r) for r in components(simhash.links(values, tile=3)).collect()}
    assert one == many and one


def test_empty_and_extra_columns(make, spark):
    assert simhash.near_duplicates(make([])).count() == 0
    odd = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a b c", "y", 2)], "doc_id long, text string, component_id string, fp int")
    assert {tuple(r) for r in simhash.near_duplicates(odd).select("doc_id", "component_id").collect()} == {(1, 1), (2, 1)}
    assert [r["component_id"] for r in simhash.keep_one(odd).collect()] == ["x"]


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (None, 1), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {901: 900}


def test_stage_keeps_columns_of_any_name(spark):
    odd = spark.createDataFrame([(1, "a b c", 7, "p"), (2, "a b c", 8, "q"), (3, "quite another text", 9, "r")], "doc_id long, text string, _gone int, row string")
    assert sorted(tuple(r) for r in simhash.keep_one(odd).collect()) == [(1, "a b c", 7, "p"), (3, "quite another text", 9, "r")]
