import random
import zlib

import numpy as np
import pytest

from cohortgrid.llm import toxicity as tx


def corpus(n=500, seed=1):
    """Toxic texts hold bad words or words with a bad beginning; the rest of the words is shared."""
    rng = random.Random(seed)
    syllables = ["an", "er", "on", "the", "in", "ti", "es", "re", "ou", "ha"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(3, len(words) // 10)):
                words.insert(rng.randrange(len(words)), rng.choice(["Scum!", "idiot"]) if i % 2 else "zorg" + word())
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def net():
    rows, labels = corpus()
    return tx.train([(t, y) for (_, t), (_, y) in zip(rows, labels)], epochs=8)


def test_gradients():
    rng = np.random.default_rng(0)
    net = tx.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = rng.integers(0, 3, (4, tx.WINDOW))
    ids[0, 5:] = -1
    label, mask = np.array([1, 0, 1, 0.0]), (ids >= 0).T[..., None]
    gates = net.projected(["a", "bcd", "c"])[ids.T].copy()
    g, d, _ = net.gradients(gates, mask, label)
    spots = [(net.p[k], g[k], tuple(s // 2 for s in net.p[k].shape)) for k in ("out", "attend", "attend_to", "ahead_state", "back_state")]
    spots += [(gates, d, at) for at in ((3, 1, 5), (2, 0, 45), (6, 2, 20))]
    for value, grad, at in spots:
        was = value[at]
        value[at] = was + 1e-4
        up = net.gradients(gates, mask, label)[2]
        value[at] = was - 1e-4
        down = net.gradients(gates, mask, label)[2]
        value[at] = was
        assert grad[at] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-7)


def test_windows_cover_and_overlap():
    for n in (1, 5, tx.WINDOW, tx.WINDOW + 1, 100, 1000):
        w = tx.windows_of(np.arange(n))
        assert set(w[w >= 0]) == set(range(n)) and w.shape[1] == tx.WINDOW


def test_pieces_score_as_whole_texts(net, monkeypatch):
    text = " ".join(t for _, t in corpus(40, 5)[0])
    whole = tx.Scorer(net).scores([text, "the idiot scum", ""])
    monkeypatch.setattr(tx, "PIECE", 20 * tx.STRIDE)
    monkeypatch.setattr(tx, "BATCH", 64)
    cut = tx.Scorer(net).scores([text, "the idiot scum", ""])
    # The last window of a piece may end elsewhere, which adds windows that the whole lacks.
    assert cut[1:] == pytest.approx(whole[1:], abs=1e-5) and cut[0] >= whole[0] - 1e-5


def test_every_window_is_scored_as_by_itself(net):
    table = net.projected(["a", "scum", "zorgan", "the"])
    ids = np.random.default_rng(3).integers(0, 4, 90)
    for n in (1, tx.WINDOW - 1, tx.WINDOW, tx.WINDOW + 1, 90):
        starts = np.arange(max(1, n - tx.WINDOW + 1))
        alone = ids[:n] if n >= tx.WINDOW else np.concatenate([ids[:n], np.full(tx.WINDOW - n, -1)])
        expected = net.logits(table, alone[starts[:, None] + np.arange(tx.WINDOW)])
        got = net.text_logits(table, [ids[:7], ids[:n], ids[5:60]])[1]
        assert got == pytest.approx(expected, abs=1e-4)


def test_one_short_toxic_passage_at_every_offset(net):
    clean = " ".join(t for (_, t), (_, y) in zip(*corpus(60, seed=77)) if not y).split()[:300]
    scores = tx.Scorer(net).scores([" ".join([*clean[:k], "idiot", *clean[k:]]) for k in range(len(clean) + 1)])
    assert tx.Scorer(net).scores([" ".join(clean)])[0] < 0.5 and min(scores) >= 0.5


def test_held_out_accuracy_of_the_query(make, spark):
    rows, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "..."), (None, "scum idiot scum"), (1, rows[1][1])]
    df = tx.toxicity(make(rows + extra), spark.createDataFrame(labels + [(9000, 1), (None, 1)], "doc_id long, toxic int"))
    got = df.collect()
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows) + 5
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[9000] == by[9001] == by[9002] == 0.0 and all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from(make, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in tx.toxicity(make([(1, "a b")]), labels).collect()] == [(1, False, 0.0, 0)]
    assert tx.toxicity(make([]), labels).count() == 0
    odd = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, score string")
    assert tx.toxicity(odd, labels).head()["score"] == 0.0
