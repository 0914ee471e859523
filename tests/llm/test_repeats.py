import random

from cohortgrid.llm import repeats


def plain(rows, size):
    """(doc_id, n_words, n_removed, kept) by looking every window up in a dictionary."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(5, 40))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(1, 25))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, 150), rng.choice(["  ", "\n", "\t"]).join(parts)))
    rows += [(i, passages[0] + " " + passages[0]) for i in (500, 499, 501)] + rows[:5]
    return rows + [(None, passages[0]), (700, None), (701, ""), (702, "é\u00a0b " * 40), (703, "é\u00a0b " * 41)]


def test_matches_every_window(make):
    for seed, size, gram in ((1, 6, 2), (2, 9, 3), (3, 7, 7)):
        rows = corpus(seed)
        got = repeats.remove_repeats(make(rows), size, gram).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, size)


def test_production_window(make):
    rng = random.Random(9)
    body = [str(rng.randrange(10**6)) for _ in range(400)]
    rows = [(2, " ".join(body)), (1, " ".join(body[100:160])), (3, " ".join(["x"] + body[5:54])), (4, " ".join(body[5:55] + ["y"])), (5, " ".join(body[90:170]))]
    got = repeats.remove_repeats(make(rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 50)


def test_empty_and_extra_columns(make, spark):
    assert repeats.digests(make([])).count() == 0
    odd = spark.createDataFrame([(1, "a b", 1, "x")], "doc_id long, text string, part int, spans string")
    assert repeats.digests(odd).head()["n_words"] == 2
