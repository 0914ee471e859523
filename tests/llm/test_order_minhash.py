import hashlib
import math
import random

from pyspark.sql import functions as F

from cohortgrid.llm import order_minhash as om


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(vocab, k=rng.randint(0, 200)))) for i in range(60)]
    rows += [(70, rows[3][1]), (71, None), (72, ""), (73, " "), (74, "x" * 5000), (75, "one two three four\n" * 400), (76, "🎉文"), (None, "last one here"), (3, rows[4][1]), rows[5]]
    return rows


def plain_edit(rows, spark):
    """Edited text and next text of every distinct document, in descending order."""
    keys = sorted({(d, t or "") for d, t in rows}, key=str)
    df = spark.createDataFrame(keys, "d long, t string")
    ordered = [(r["d"], r["t"]) for r in df.orderBy(F.desc_nulls_last("d"), F.desc(F.xxhash64("t"))).collect()]
    out = {}
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        out[d, t] = (t[: len(t) - half] + nxt[:half], nxt)
    return out


def test_edits_and_likeness(make, spark):
    rows = corpus()
    edits = plain_edit(rows, spark)
    got = om.edited_fingerprints(make(rows)).collect()
    want = sorted((d, len(t or ""), edits[d, t or ""][0]) for d, t in rows if d is not None)
    assert sorted((r["doc_id"], r["n_chars"], r["edited"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(rows)
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    long_ = [r for r in got if r["n_chars"] > 300 and r["doc_id"] not in (74, 75)]
    assert sum(r["near_edited"] for r in long_) > 5 * sum(r["near_next"] for r in long_) > -1
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (3, 5)}
    assert by_id[71]["fingerprint"] == by_id[72]["fingerprint"] != by_id[73]["fingerprint"]
    digest = {r["doc_id"]: r["edited_sha256"] for r in om.digests(make(rows)).collect() if r["doc_id"] == 75}
    assert digest[75] == hashlib.sha256(edits[75, rows[65][1]][0].encode()).hexdigest()


def test_occurrences_match_counting(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 300):
        values = [rng.choice([-5, 9, 1 << 40, -(1 << 50)]) << 12 for _ in range(n)]
        df = spark.createDataFrame([(values,)], "h array<long>")
        bits = F.lit(12)
        packed = F.sort_array(F.transform("h", lambda x, i: om._number(x, i, bits)))
        out = df.select(om.let(packed, lambda order: om._occurrences(order, bits)).alias("o")).head()["o"]
        seen, want = {}, {}
        for i, v in enumerate(values):
            want[i] = seen.get(v, 0)
            seen[v] = want[i] + 1
        assert {x["at"]: x["number"] for x in out} == want


def test_order_matters_and_copies_agree(make):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), "  ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:399]), " ".join(sorted(words, key=lambda w: hashlib.md5(w.encode()).digest()))]
    df = make(list(enumerate(texts)))
    prints = {r["doc_id"]: r["f"] for r in df.select("doc_id", om.fingerprint(F.col("text")).alias("f")).collect()}
    near = lambda a, b: len(set(prints[a]) & set(prints[b])) / 64
    assert prints[0] == prints[1] and near(0, 3) > 0.9 > near(0, 2) > 0.2 > near(0, 4)


def test_small_tables_and_clashing_columns(make, spark):
    assert om.digests(make([])).count() == 0
    one = om.digests(make([(1, "a b c d e f")])).head()
    assert one["near_next"] == 1.0
    odd = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 2, "y")], "doc_id long, text string, need int, own string")
    assert om.digests(odd).count() == 2


def prints_of(make, texts):
    df = make(list(enumerate(texts)))
    return {r["doc_id"]: r["f"] for r in df.select("doc_id", om.fingerprint(F.col("text")).alias("f")).collect()}


def near(a, b):
    return len(set(a) & set(b)) / 64


def test_two_kmers_in_every_bin_at_any_length(make):
    for n in (5, 10, 40, 80, 160, 1000, 5000):
        words = [f"w{i}" for i in range(n)]
        quarter = n // 4
        parts = [words[i * quarter : (i + 1) * quarter] for i in range(3)] + [words[3 * quarter :]]
        texts = [words, words[n // 2 :] + words[: n // 2], sum(reversed(parts), []), words[: n // 2] + ["new"] + words[n // 2 :]]
        p = prints_of(make, [" ".join(t) for t in texts])
        assert all(len(x) == 64 for x in p.values())
        # Moved halves and quarters lose the order of pairs that lie apart; one more word costs little in long texts.
        assert near(p[0], p[1]) < 0.68 and near(p[0], p[2]) < 0.55, (n, near(p[0], p[1]), near(p[0], p[2]))
        if n >= 40:
            assert near(p[0], p[3]) > near(p[0], p[1]) and near(p[0], p[3]) > 0.55, (n, near(p[0], p[3]))


def test_one_insertion_early_in_a_long_unspaced_text(make):
    rng = random.Random(9)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "acgt", "日本語文字列中国"):
        text = "".join(rng.choice(letters) for _ in range(5000))
        p = prints_of(make, [text, text[:5] + "x" + text[5:], "".join(rng.choice(letters) for _ in range(5000))])
        assert near(p[0], p[1]) > 0.9 and near(p[0], p[2]) < 0.2


def test_brute_force_fingerprints(make, spark):
    """Another way to the same entries: k-mers numbered by a dict, bins filled by going round a sorted list."""
    rows = [(d, t) for d, t in corpus(7) if t and len(t) < 3000]
    texts = sorted({t for _, t in rows if max(len(w.encode()) for w in t.split() or [""]) <= om.PIECE})
    kmers = {}
    for t in texts:
        w = t.split()
        kmers[t] = [w[i : i + 3] for i in range(len(w) - 2)] or [[t]]
    flat = [(t, i, k, n) for t in texts for i, (k, n) in enumerate(zip(kmers[t], [kmers[t][:i].count(k) for i, k in enumerate(kmers[t])]))]
    df = spark.createDataFrame(flat, "t string, i int, k array<string>, n int")
    three = F.when(F.size("k") == 3, F.xxhash64(*[F.get("k", F.lit(j)) for j in range(3)])).otherwise(F.xxhash64(F.get("k", F.lit(0))))
    held = {}
    for r in df.select("t", "i", "n", three.alias("h")).collect():
        held.setdefault(r["t"], []).append((r["i"], r["n"], r["h"]))
    pairs, wanted = [], {}
    for t, own in held.items():
        bits = math.ceil(math.log2(len(own) + 1))
        own.sort()
        h = [x[2] for x in own]
        low = (1 << bits) - 1
        kept = spark_hashes(spark, own)
        order = sorted(((g | low) - low + x[0], x[0]) for x, g in zip(own, kept))
        bins = [(v >> 58) & 63 for v, _ in order]
        for b in range(64):
            firsts = sorted({bins[i]: i for i in reversed(range(len(order)))}.items())
            start = next((i for own_bin, i in firsts if own_bin >= b), firsts[0][1])
            one, two = order[start][1], order[(start + 1) % len(order)][1]
            pairs.append((t, b, h[min(one, two)], h[max(one, two)] if len(order) > 1 else None))
    mixed = spark.createDataFrame(pairs, "t string, b int, x long, y long").select("t", "b", F.xxhash64("x", "y").alias("m"))
    for r in mixed.collect():
        wanted.setdefault(r["t"], {})[r["b"]] = r["b"] * (1 << 26) + (((r["m"] % 2**64) >> 6) & ((1 << 26) - 1)) - (1 << 31)
    got = {r["text"]: r["f"] for r in make(list(enumerate(texts))).select("text", om.fingerprint(F.col("text")).alias("f")).collect()}
    assert all(got[t] == [wanted[t][b] for b in range(64)] for t in texts)


def spark_hashes(spark, own):
    df = spark.createDataFrame([(i, x[2], x[1]) for i, x in enumerate(own)], "i int, h long, n int")
    return [r[0] for r in df.select(F.xxhash64("h", "n"), "i").orderBy("i").collect()]
