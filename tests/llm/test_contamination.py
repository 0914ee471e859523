import hashlib
import random
import re

from cohortgrid.llm import contamination
from cohortgrid.llm.shared import keyed

WORD = re.compile("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            n = min(size, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        ids |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "c", "É", "dd", "x1"] + [f"r{i}" for i in range(30)]
    text = lambda k: rng.choice([" ", ", ", "-"]).join(rng.choices(vocab, weights=[9] * 6 + [1] * 30, k=k))
    items = [(i, text(rng.randint(1, 14))) for i in range(25)] + [(3, "B c"), (90, None), (91, ""), (None, "r1 r2 r3"), (92, "zz zz zz zz zz")]
    docs = []
    for i in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.4 else text(rng.randint(1, 30)) for _ in range(4)]
        docs.append((i // 2, " ".join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    return docs + docs[:3] + [(None, items[5][1]), (80, None), (81, "..."), (82, "zz " * 500)], items


def test_matches_every_window(make, spark):
    for seed, size in ((1, 3), (2, 5), (3, 1), (4, 10)):
        docs, items = corpus(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = contamination.contamination(make(docs), bench, size)
        rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated) for r in got.collect()]
        assert sorted(rows, key=str) == plain(docs, items, size)


def test_many_terms_use_a_shuffle(make, spark, monkeypatch):
    monkeypatch.setattr(contamination, "SHARED_TERMS", 1)
    docs, items = corpus(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.digests(make(docs), bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items, 10)


def test_proximity(make, spark):
    bench = spark.createDataFrame([(1, "red fox jumps")], "item_id long, text string")
    docs = keyed(make([(1, "a red fox jumps"), (2, "red old fox jumps high"), (3, "fox red far far far far jumps")]), "doc_id", "text")
    near = {r["doc_id"] for r in contamination.proximity_matches(docs, bench, 3, slop=1).collect()}
    assert {1, 2} <= near and 3 not in near


def test_empty_and_clashing_columns(make, spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.digests(make([]), bench).count() == 0
    assert contamination.digests(make([(1, "a b")]), none).head()["contaminated"] is False
    odd = spark.createDataFrame([(1, "a b", 1, "x"), (2, "c", 2, "y")], "doc_id long, text string, pos int, term string")
    assert [r["term"] for r in contamination.keep_clean(odd, bench).collect()] == ["y"]
    named = spark.createDataFrame([(1, "a b", 1, "x", "v"), (2, "c", 2, "y", "w"), (None, None, 3, "z", "u")], "doc_id long, text string, _d int, _t string, row string")
    assert sorted(contamination.keep_clean(named, bench).select("_d", "_t", "row").collect()) == [(2, "y", "w"), (3, "z", "u")]
