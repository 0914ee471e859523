import hashlib
import random

from cohortgrid.llm import lines

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=3, min_chars=20):
    """Expected (doc_id, n_lines, n_dropped, kept) rows, None counted as one document before all others."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    order = lambda d: (d is not None, d or 0)
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(held.get(key(x), ())) < min_docs or max(held[key(x)], key=order) == d]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept")) for r in df.collect()), key=str)


def test_brute_force_on_mixed_lines(make):
    rng = random.Random(3)
    pool = [f"a line that many documents share, number {i}" for i in range(6)]
    pool += ["short", "", "exactly twenty chars", "nineteen characters", "É" * 20, "é" * 20, "ÀB" * 10, "àb" * 10, "\xa0" + "x" * 20]
    dress = [lambda x: x, lambda x: " \t" + x.upper() if x.isascii() else x, lambda x: x + "\r", lambda x: "\x0b\x0c" + x + "  "]
    rows = []
    for i in range(200):
        rows.append((rng.choice([i, i, i // 2, None]), "\n".join(rng.choice(dress)(rng.choice([*pool, f"only here {i} {rng.random()}"])) for _ in range(rng.randint(0, 12)))))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, pool[0]), (503, pool[0]), (504, "\n".join([pool[1]] * 50))]
    rng.shuffle(rows)
    want = brute(rows)
    assert any(w[2] for w in want)
    assert got(lines.drop_lines(make(rows))) == want
    assert got(lines.drop_lines(make(rows), min_docs=5, min_chars=1)) == brute(rows, 5, 1)


def test_the_largest_id_keeps_repeats(make):
    x = "this line stands in three documents"
    rows = [(1, x), (2, f"{x}\nown\n{x}"), (9, f"{x}\n{x.upper()}\nend")]
    assert got(lines.drop_lines(make(rows))) == [(1, 1, 1, ""), (2, 3, 2, "own"), (9, 3, 0, f"{x}\n{x.upper()}\nend")]
    twice = [(1, x), (1, x), (2, x)]
    assert all(r[2] == 0 for r in got(lines.drop_lines(make(twice))))


def test_long_texts_and_a_line_of_all_documents(make):
    x = "one line that stands in every document of all"
    long = "\n".join(f"row {i} of a very long text, told once" for i in range(60_000))
    rows = [(i, f"{x}\nunique line with number {i}") for i in range(3000)] + [(4000, long), (4001, f"{long}\n{x}"), (4002, "w" * 2_000_000)]
    assert got(lines.drop_lines(make(rows))) == brute(rows)


def test_empty_table_and_clashing_columns(make, spark):
    assert lines.digests(make([])).collect() == []
    x = "a line that stands in all three rows"
    odd = spark.createDataFrame([(i, x, 1, 2, 3, "k") for i in range(3)], "doc_id long, text string, h int, gone int, pos int, key string")
    out = lines.digests(odd)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    empty, whole = (hashlib.sha256(t.encode()).hexdigest() for t in ("", x))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 1, empty), (1, 1, 1, empty), (2, 1, 0, whole)]
