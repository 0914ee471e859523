"""op10_toxicity over its limit (FINDINGS_r03): where it is trained, and that cheaper steps give what plain ones do."""

import numpy as np
import pytest
from pyspark import TaskContext

from cohortgrid.llm import toxicity as tx


@pytest.fixture(scope="module")
def net():
    net = tx.Network(["a", "b"], 3)
    for name in ("ahead_in", "back_in", "ahead_state", "back_state", "words", "attend", "attend_to", "out"):
        net.p[name] = net.p[name] * 4
    return net


def test_training_runs_in_a_task(make, spark, monkeypatch):
    train = tx.train

    def in_task(rows):
        assert TaskContext.get() is not None, "trained on the driver"
        return train(rows)

    monkeypatch.setattr(tx, "train", in_task)
    rows = [(i, " ".join(["scum" if i % 2 else "fine", "word", "other"] * 9)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = tx.toxicity(make(rows), labels).collect()
    assert len(got) == 60 and all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_more_new_words_than_are_kept(net, monkeypatch):
    texts = [" ".join(np.random.default_rng(i).choice([f"w{j}" for j in range(50)], 80)) for i in range(4)] + ["a b", ""]
    whole = tx.Scorer(net).scores(texts)
    monkeypatch.setattr(tx, "KEPT", 3)
    monkeypatch.setattr(tx, "PIECE", 30)
    cut = tx.Scorer(net)
    # 30 words a piece make windows that the whole has too; only the last of a text may end elsewhere.
    assert [cut.scores([t])[0] for t in texts] == pytest.approx(whole, abs=1e-5)


def test_character_grams_are_those_of_each_word_alone(net):
    words = ["a", "bcd", "ef", "ghij", "b", "éà", "x" * 40, "\ud800z"]

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
            h ^= h >> 29
        return h % tx.GRAMS

    got = {int(w): sorted(column) for places, buckets in tx.char_grams(words) for w, column in zip(places, buckets.T.tolist())}
    marked = [f"^{w}$" for w in words]
    assert got == {i: sorted(bucket(m[j : j + n]) for n in (3, 4, 5) for j in range(len(m) - n + 1)) for i, m in enumerate(marked)}
    total, root = tx.char_input(tx.char_grams(words), net.p["grams"], len(words))
    for i, m in enumerate(marked):
        assert total[i] == pytest.approx(net.p["grams"][got[i]].sum(axis=0) / np.sqrt(len(got[i])), abs=1e-5) and root[i, 0] == pytest.approx(len(got[i]) ** 0.5)


def test_blocks_of_windows_score_as_one(net, monkeypatch):
    table, ids = net.projected(["a", "b", "cd", "efg", "hij"]), np.random.default_rng(5).integers(0, 5, 300)
    expected = net.logits(table, ids[np.arange(300 - tx.WINDOW + 1)[:, None] + np.arange(tx.WINDOW)])
    for block in (7, 64, 277, 4096):
        monkeypatch.setattr(tx, "BATCH", block)
        assert net.every_window(table, ids) == pytest.approx(expected, abs=1e-4)
