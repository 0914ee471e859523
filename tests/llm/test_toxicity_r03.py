"""op10_toxicity over its limit (CHECK_r03): what is no longer worked out twice, and that windows score as before."""

import numpy as np
import pytest

from cohortgrid.llm import toxicity as tx


@pytest.fixture(scope="module")
def net():
    net = tx.Network(["a", "b"], 3)
    for name in ("ahead_in", "back_in", "ahead_state", "back_state", "words", "attend", "attend_to", "out"):
        net.p[name] = net.p[name] * 4
    return net


def test_equal_texts_are_scored_once(net, monkeypatch):
    texts = [" ".join(np.random.default_rng(i % 3).choice(["a", "b", "cd", "efg"], 200)) for i in range(9)] + [None, ""]
    seen = []
    run = tx.Network.text_logits
    monkeypatch.setattr(tx.Network, "text_logits", lambda self, table, ids: seen.extend(len(x) for x in ids) or run(self, table, ids))
    scorer = tx.Scorer(net)
    first = scorer.scores(texts)
    assert sum(seen) == 3 * 200
    assert scorer.scores(texts) == first and sum(seen) == 3 * 200
    assert first[0] == first[3] == first[6] and first[9] == first[10] == 0.0
    monkeypatch.setattr(tx, "TEXTS", 2)
    assert scorer.scores(["a b", "b a", "a"]) == pytest.approx([tx.Scorer(net).scores([t])[0] for t in ("a b", "b a", "a")], abs=1e-6)


def test_saturated_gates_score_as_windows_by_themselves(net):
    table = net.projected(["a", "b", "cd", "efg", "hij"]) * 3
    ids = np.random.default_rng(5).integers(0, 5, 300)
    gates = table[ids][:, : 2 * tx.STATE]
    assert (gates > 2).any() and (gates < -2).any()
    expected = net.logits(table, tx.windows_of(ids))
    order = tx.window_starts(len(ids))
    assert net.text_logits(table, [ids])[0][order] == pytest.approx(expected, abs=1e-4)
