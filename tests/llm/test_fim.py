import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortgrid.llm import fim


def brute(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
        p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            out.append((d, len(w), "plain", None, None, t))
        elif h4 % 100 < 20:
            out.append((d, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            out.append((d, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    return sorted(out, key=str)


def texts(rng):
    few = "ab Zé<>PSM\n€😀0"
    yield from ["", "a", "é", "😀", "abc", "<P>", "x<S>", "<M", "<<S", "a<M>b", "A" * 100, "é" * 100, " " * 70, "ab" * 32, "a " * 64]
    for _ in range(600):
        yield "".join(rng.choice(few) for _ in range(rng.randint(0, 150)))


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        x = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fim.WaveletMatrix(x, 3)
        for c in range(8):
            want = np.concatenate([[0], np.cumsum(x == c)])
            assert (matrix.rank(c, np.arange(n + 1)) == want).all()


def test_brute_force_and_round_trip(make):
    rows = [*enumerate(texts(random.Random(2))), (None, "no id here"), (3, None), (3, "abc"), (3, "abc")]
    done = fim.transform(make(rows))
    out = [r.asDict() for r in done.select("*", fim.restore(done["output"], done["form"]).alias("restored")).collect()]
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=str) == brute(rows)
    assert all(r["restored"] == r["text"] for r in out) and {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_blocks_do_not_matter(monkeypatch):
    rows = list(texts(random.Random(4)))
    ask = [pa.array(x) for x in (rows, range(len(rows)), range(7, 7 + len(rows)))]
    whole = fim.cuts(*ask)
    for size in (1, 50, 1000):
        monkeypatch.setattr("cohortgrid.llm.shared.BLOCK_BYTES", size)
        assert fim.cuts(*ask) == whole
    assert fim.cuts(*(x.slice(5, 40) for x in ask)) == whole.slice(5, 40)


@pytest.mark.parametrize("unit", ["word and more. ", "x", "é"])
def test_very_long_text(make, unit):
    rows = [(7, unit * 300_000), (8, "short")]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.transform(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(make, spark):
    assert fim.digests(make([])).collect() == []
    odd = spark.createDataFrame([(1, "some text", 4, "x", 5)], "doc_id long, text string, n int, form string, cut int")
    row = fim.digests(odd).head()
    assert row.n == 3 and row.restored_sha256 == hashlib.sha256(b"some text").hexdigest()
