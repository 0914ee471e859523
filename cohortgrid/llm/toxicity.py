"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgrid.llm.shared import small_batches

WORD = re.compile(r"[^\W_]+").findall
#: Words of a window and between the starts of two windows.
WINDOW, STRIDE = 24, 1
#: Highest windows with which a document of label 0 is trained; one of label 1 is with its highest, which also is the score.
BEST = 3
#: Word table, character n-gram table, sizes of the embeddings, of a state and of the attention.
WORDS, GRAMS, WIDTH, STATE, ATTEND = 20_000, 1 << 15, 8, 8, 8
#: Bounds of the training sample: documents with label 1 and 0, and characters of one.
TOXIC, CLEAN, LONGEST = 1000, 2000, 20_000
#: Distinct words beyond which a Python worker starts anew to keep their inputs, and words of a text read at once.
KEPT, PIECE = 1 << 18, 1 << 15
#: Share of the words of a training step that count as outside the vocabulary.
DROPPED = 0.3
#: Texts whose scores a Python worker keeps, under 128-bit hashes.
TEXTS = 1 << 17
#: Windows run through the network at once, in scoring and in a training step.
BATCH, STEP = 4096, 192


def tokens(text: str | None) -> list[str]:
    return WORD((text or "").lower())


def char_grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of character 3- to 5-grams with the word's ends marked: for each length the words' places and (grams, words) buckets."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    line = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le", "surrogatepass"), "<u4")
    out, at, read = [], 0, 0
    for long, m in zip(*(x.tolist() for x in np.unique(length, return_counts=True))):
        chars = np.empty((long + 2, m), np.uint64)
        chars[0], chars[-1], chars[1:-1] = ord("^"), ord("$"), line[read : read + long * m].reshape(m, long).T
        buckets = []
        for n in range(3, min(5, long + 2) + 1):
            h = np.full((long + 3 - n, m), n, np.uint64)
            for j in range(n):
                h ^= chars[j : j + len(h)]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            buckets.append((h & np.uint64(GRAMS - 1)).astype(np.int64))
        out.append((order[at : at + m], np.concatenate(buckets)))
        at, read = at + m, read + long * m
    return out


def char_input(grams: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the n-grams' vectors over the root of their number, and that root."""
    total, root = np.zeros((n_words, table.shape[1]), np.float32), np.ones((n_words, 1), np.float32)
    for word, bucket in grams:
        rows = max(1, PIECE // len(word))
        for i in range(0, len(bucket), rows):
            total[word] += np.take(table, bucket[i : i + rows], axis=0).sum(axis=0)
        root[word] = np.sqrt(np.float32(len(bucket)))
    return total / root, root


def sums_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` that share an index, for 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[first]] = np.add.reduceat(values[order], first)
    return out


def window_starts(n: int) -> np.ndarray:
    """Overlapping windows over n words; the last ends with the text."""
    return np.array([*range(0, max(1, n - WINDOW), STRIDE), *([n - WINDOW] if n > WINDOW else [])])


def windows_of(ids: np.ndarray) -> np.ndarray:
    """Rows of WINDOW ids, -1 after the end of a text shorter than a window."""
    if len(ids) < WINDOW:
        ids = np.concatenate([ids, np.full(WINDOW - len(ids), -1, ids.dtype)])
    return ids[window_starts(len(ids))[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid: a line of the sigmoid's slope at 0, cut at 0 and 1."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Word and character embeddings, one gated recurrent unit a direction, attention, one output."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.p = {"words": draw(len(vocabulary) + 1, WIDTH, by=0.1), "grams": draw(GRAMS, WIDTH, by=0.1)}
        for d in ("ahead", "back"):
            self.p[f"{d}_in"] = draw(2 * WIDTH, 3 * STATE, by=0.3)
            self.p[f"{d}_state"] = draw(STATE, 3 * STATE, by=0.3)
            self.p[f"{d}_bias"] = np.zeros(3 * STATE, np.float32)
        self.p["attend"], self.p["attend_to"] = draw(2 * STATE, ATTEND, by=0.3), draw(ATTEND, by=0.3)
        self.p["out"], self.p["out_bias"] = draw(2 * STATE, by=0.3), np.zeros(1, np.float32)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Rows of the word table; the last is for words outside the vocabulary."""
        other = len(self.place)
        return np.array([self.place.get(w, other) for w in words], np.int64)

    def inputs(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self.p["words"][self.word_rows(words)], char_input(char_grams(words), self.p["grams"], len(words))[0]], axis=1)

    def projected(self, words: list[str]) -> np.ndarray:
        """Both directions' gate inputs of each word: they don't depend on its neighbours."""
        x = self.inputs(words)
        return np.concatenate([x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"] for d in ("ahead", "back")], axis=1)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction; gates (T, B, 3 STATE), mask (T, B, 1)."""
        u, s = self.p[f"{d}_state"], STATE
        h = np.zeros((gates.shape[1], s), gates.dtype)
        states = np.empty((*gates.shape[:2], s), gates.dtype)
        order = range(len(gates)) if d == "ahead" else range(len(gates) - 1, -1, -1)
        for t in order:
            g, hu = gates[t], h @ u
            zr = _gate(g[:, : 2 * s] + hu[:, : 2 * s])
            z, r = zr[:, :s], zr[:, s:]
            n = _softsign(g[:, 2 * s :] + r * hu[:, 2 * s :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * s :]))
            h = np.where(mask[t], new, h)
            states[t] = h
        return states

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows from projected inputs (T, B, 6 STATE)."""
        kept = {d: [] if keep is not None else None for d in ("ahead", "back")}
        half = 3 * STATE
        states = np.concatenate([self._run(gates[..., :half], mask, "ahead", kept["ahead"]), self._run(gates[..., half:], mask, "back", kept["back"])], axis=2)
        heard = states @ self.p["attend"]
        weight = np.where(mask[..., 0], heard @ self.p["attend_to"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbs->bs", weight, states)
        if keep is not None:
            keep.update(kept=kept, states=states, heard=heard, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def gradients(self, gates: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean log loss: of the parameters above the inputs, and of the gates."""
        k: dict = {}
        p = _sigmoid(self.forward(gates, mask, k))
        loss = float(-np.mean(np.where(label > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        e = ((p - label) / len(label)).astype(gates.dtype)
        g = {"out": k["pooled"].T @ e, "out_bias": e.sum(keepdims=True)}
        d_pooled = e[:, None] * self.p["out"]
        d_weight = np.einsum("bs,tbs->tb", d_pooled, k["states"])
        d_score = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
        g["attend_to"] = np.einsum("tb,tba->a", d_score, k["heard"])
        d_heard = d_score[..., None] * self.p["attend_to"]
        g["attend"] = np.einsum("tbs,tba->sa", k["states"], d_heard)
        d_states = k["weight"][..., None] * d_pooled + d_heard @ self.p["attend"].T
        d_gates = np.zeros_like(gates)
        s = STATE
        for i, d in enumerate(("ahead", "back")):
            u, at = self.p[f"{d}_state"], slice(3 * s * i, 3 * s * (i + 1))
            g[f"{d}_state"] = np.zeros_like(u)
            flow = np.zeros((gates.shape[1], s), gates.dtype)
            for t, h, z, r, n, hn in reversed(k["kept"][d]):
                total = d_states[t][:, s * i : s * (i + 1)] + flow
                on = np.where(mask[t], total, 0)
                dn = on * (1 - z) * (1 - np.abs(n)) ** 2
                dz = on * (h - n) * 0.25 * ((z > 0) & (z < 1))
                dr = dn * hn * 0.25 * ((r > 0) & (r < 1))
                d_gates[t][:, at] = np.concatenate([dz, dr, dn], axis=1)
                d_hu = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"{d}_state"] += h.T @ d_hu
                flow = np.where(mask[t], on * z + d_hu @ u.T, total)
            g[f"{d}_bias"] = d_gates[..., at].sum(axis=(0, 1))
        return g, d_gates, loss

    def step(self, words: list[str], known: np.ndarray, ids: np.ndarray, label: np.ndarray, moments: dict, rate: float, t: int) -> float:
        """One Adam step on windows `ids` (places in `words`, whose rows are `known`, -1: none); some words are known by their characters alone."""
        used, local = np.unique(ids[ids >= 0], return_inverse=True)
        own = [words[i] for i in used]
        rows, grams = known[used], char_grams(own)
        rows[np.random.default_rng(t).random(len(rows)) < DROPPED] = len(self.place)
        chars, root = char_input(grams, self.p["grams"], len(own))
        x = np.concatenate([self.p["words"][rows], chars], axis=1)
        table = np.concatenate([x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"] for d in ("ahead", "back")], axis=1)
        at = np.zeros(ids.shape, np.int64)
        at[ids >= 0] = local
        mask = (ids >= 0).T[..., None]
        g, d_gates, loss = self.gradients(table[at.T], mask, label)
        d_table = sums_by(at.T[mask[..., 0]], d_gates[mask[..., 0]], len(own))
        d_x = np.zeros_like(x)
        for i, d in enumerate(("ahead", "back")):
            part = d_table[:, 3 * STATE * i : 3 * STATE * (i + 1)]
            g[f"{d}_in"] = x.T @ part
            d_x += part @ self.p[f"{d}_in"].T
        g["words"] = sums_by(rows, d_x[:, :WIDTH], len(self.p["words"]))
        word = np.concatenate([np.broadcast_to(w, b.shape).ravel() for w, b in grams])
        bucket = np.concatenate([b.ravel() for _, b in grams])
        g["grams"] = sums_by(bucket, (d_x[:, WIDTH:] / root)[word], GRAMS)
        for name, grad in g.items():
            m, v = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            fixed = m / (1 - 0.9**t), v / (1 - 0.99**t)
            self.p[name] -= (rate * fixed[0] / (np.sqrt(fixed[1]) + 1e-6)).astype(np.float32)
        return loss

    def every_window(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of the windows at each start of a run of WINDOW or more rows of `table`.

        As `forward`, without masks: step t of BATCH neighbouring windows reads one slice. Each gate
        has an array of its own with a window's values side by side, so that slices are contiguous
        and products are of tall matrices, which take half the time of flat ones.
        """
        s, n = STATE, len(ids) - WINDOW + 1
        slope, middle = (np.array(x, np.float32).repeat(s) for x in ([0.25, 0.25, 1], [0.5, 0.5, 0]))
        us = [np.ascontiguousarray((self.p[f"{d}_state"] * slope).reshape(s, 3, s).transpose(1, 0, 2)) for d in ("ahead", "back")]
        attend, out = (self.p["attend"] @ self.p["attend_to"]).reshape(2, s), self.p["out"].reshape(2, s)
        wide = min(BATCH, n)
        # Words' rows and gates, a step's products, values, their sizes, two states by turns.
        shapes = (wide + WINDOW - 1, 6 * s), (2, 3, wide + WINDOW - 1, s), (3, wide, s), (wide, s), (wide, s), (2, wide, s)
        room = [np.empty(x, np.float32) for x in shapes]
        totals, slope, middle = np.empty((3, WINDOW, wide), np.float32), np.tile(slope, 2), np.tile(middle, 2)
        low, high, logits = np.float32(0), np.float32(1), np.empty(n, np.float32)
        for a in range(0, n, BATCH):
            b = min(BATCH, n - a)
            rows, both = room[0][: b + WINDOW - 1], room[1][:, :, : b + WINDOW - 1]
            hu, q, size, turns = (x[..., :b, :] for x in room[2:])
            zr, z, r, hn = hu[:2], hu[0], hu[1], hu[2]
            weight, said, more = totals[..., :b]
            np.take(table, ids[a : a + b + WINDOW - 1], axis=0, out=rows, mode="clip")
            rows *= slope
            rows += middle
            both[:] = rows.reshape(-1, 2, 3, s).transpose(1, 2, 0, 3)
            # A window's first state is that of a word alone.
            first = (1 - both[:, 0].clip(low, high)) * _softsign(both[:, 2])
            for i, order in ((0, range(WINDOW)), (1, range(WINDOW - 1, -1, -1))):
                h = first[i, order[0] : order[0] + b]
                for at in order:
                    if at != order[0]:
                        g, before, h = both[i, :, at : at + b], h, turns[at % 2]
                        np.matmul(before, us[i], out=hu)
                        zr += g[:2]
                        zr.clip(low, high, out=zr)
                        np.multiply(r, hn, out=q)
                        q += g[2]
                        np.abs(q, out=size)
                        size += high
                        q /= size
                        np.subtract(before, q, out=h)
                        h *= z
                        h += q
                    if i == 0:
                        np.matmul(h, attend[0], out=weight[at])
                        np.matmul(h, out[0], out=said[at])
                    else:
                        weight[at] += np.matmul(h, attend[1], out=more[0])
                        said[at] += np.matmul(h, out[1], out=more[1])
            weight -= weight.max(axis=0)
            np.exp(weight, out=weight)
            said *= weight
            logits[a : a + b] = said.sum(axis=0) / weight.sum(axis=0) + self.p["out_bias"][0]
        return logits

    def text_logits(self, table: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of all windows of each text, given as rows of `table`; texts run joined, windows over a joint are left out."""
        out: list = [None] * len(texts)
        long = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
        if long:
            values, at = self.every_window(table, np.concatenate([texts[i] for i in long])), 0
            for i in long:
                out[i] = values[at : at + len(texts[i]) - WINDOW + 1]
                at += len(texts[i])
        short = [i for i, t in enumerate(texts) if len(t) < WINDOW]
        if short:
            for i, value in zip(short, self.logits(table, np.concatenate([windows_of(texts[i]) for i in short]))):
                out[i] = value[None]
        return out

    def logits(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows of rows of `table` (-1: none)."""
        out = []
        for i in range(0, len(ids), BATCH):
            part = ids[i : i + BATCH].T
            out.append(self.forward(table[part], (part >= 0)[..., None]))
        return np.concatenate(out)


def train(rows: list[tuple[str, int]], epochs: int = 10, seed: int = 7) -> Network:
    """A network from (text, label) rows: first on windows drawn from all, then on each document's highest.

    A document's label is given to its highest windows of all: with label 1 to the one that makes its
    score, with label 0 to BEST, so that one odd word in a long clean text doesn't count.
    """
    rng = np.random.default_rng(seed)
    texts = [tokens(t) for t, _ in rows]
    labels = np.array([y for _, y in rows], np.float32)
    seen = Counter(w for t in texts for w in set(t))
    vocabulary = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if n >= 5]
    net = Network(vocabulary, seed)
    words = sorted(seen)
    place, known = {w: i for i, w in enumerate(words)}, net.word_rows(words)
    ids = [np.array([place[w] for w in t], np.int64) for t in texts]
    if not len(rows) or not words:
        return net
    # All texts in a row, short ones filled up with -1; starts of their windows.
    filled = [np.concatenate([x, np.full(max(0, WINDOW - len(x)), -1)]) for x in ids]
    stream = np.concatenate(filled)
    ends = np.cumsum([len(x) for x in filled])
    starts = np.concatenate([np.arange(e - len(x), e - WINDOW + 1) for x, e in zip(filled, ends)])
    owner = np.repeat(np.arange(len(rows)), [len(x) - WINDOW + 1 for x in filled])
    moments, t = {}, 0
    for epoch in range(epochs):
        key = rng.random(len(owner)) if epoch < 3 else -np.concatenate(net.text_logits(net.projected(words), ids))
        order = np.lexsort((key, owner))
        first = np.concatenate(([True], owner[order][1:] != owner[order][:-1]))
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        most = 6 if epoch < 3 else np.where(labels[owner[order]] > 0, 1, BEST)
        chosen = rng.permutation(order[rank < most])
        for at in range(0, len(chosen), STEP):
            part, t = chosen[at : at + STEP], t + 1
            net.step(words, known, stream[starts[part][:, None] + np.arange(WINDOW)], labels[owner[part]], moments, 0.012 if epoch < 7 else 0.004, t)
    return net


class Places(dict):
    """Numbers of words in the order in which they are first asked for; `new` has those asked for lately."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at


class Scorer:
    """Scores texts; keeps the gate inputs of the words it has met until they are more than KEPT."""

    def __init__(self, net: Network):
        self.net = net
        self.table = np.empty((KEPT + 2 * PIECE, 6 * STATE), np.float32)
        self.place = Places()
        self.known: dict[bytes, float] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.place) > KEPT:
            self.place = Places()
        place, at = self.place, len(self.place)
        ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        if place.new:
            if len(place) > len(self.table):
                self.table = np.concatenate([self.table[:at], np.empty((len(place), self.table.shape[1]), np.float32)])
            self.table[at : len(place)] = self.net.projected(place.new)
            place.new = []
        return ids

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of whole texts; 0 without words. Equal texts are scored once, as far as the last TEXTS ones are known."""
        keys = [blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts) if k not in self.known}
        found = dict(zip(new, self._scores(list(new.values()))))
        out = [found[k] if k in found else self.known[k] for k in keys]
        if len(self.known) + len(found) > TEXTS:
            self.known.clear()
        self.known |= found
        return out

    def _scores(self, texts: list[str | None]) -> list[float]:
        """Scores of whole texts. Windows of many texts run together."""
        split = [tokens(t) for t in texts]
        best = np.full(len(texts), -np.inf)
        waiting, owners = [], []

        def flush() -> None:
            if waiting:
                ids = self.ids([w for part in waiting for w in part])
                pieces = np.split(ids, np.cumsum([len(part) for part in waiting])[:-1])
                np.maximum.at(best, owners, [x.max() for x in self.net.text_logits(self.table, pieces)])
                waiting.clear()
                owners.clear()

        held = 0
        for i, words in enumerate(split):
            # Pieces of a long text overlap as its windows do.
            for at in range(0, max(1, len(words) - WINDOW + STRIDE), PIECE):
                part = words[at : at + PIECE + WINDOW - STRIDE]
                if not part:
                    continue
                waiting.append(part)
                owners.append(i)
                held += len(part)
                if held >= PIECE:
                    flush()
                    held = 0
        flush()
        return [float(_sigmoid(b)) if b > -np.inf else 0.0 for b in best]


def _digits(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_digits(doc_id) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, longest: int = LONGEST) -> DataFrame:
    """labelled, text, label: at most `toxic` and `clean` labelled, not held-out texts, of at most `longest` characters.

    They are the ones whose doc_id hashes lowest. toxic + clean ids go to the tasks. A document with
    contrary labels counts as toxic.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("label")).withColumn("order", F.xxhash64("labelled"))
    chosen = known.where("label = 1").orderBy("order", "labelled").limit(toxic).union(known.where("label = 0").orderBy("order", "labelled").limit(clean))
    text = F.col("text").cast("string")
    found = docs.where(text.isNotNull() & (F.char_length(text) <= longest)).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    return found.select("labelled", text.alias("text"), "label").dropDuplicates(["labelled"])


def trained(rows: DataFrame) -> Network | None:
    """The network of a bounded sample, trained in one task; none without a label 1.

    A task's array products run on one thread. On the driver they share all its cores, and waiting for
    each other costs more than they gain.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        known = pd.concat(parts).sort_values("labelled") if parts else None
        if known is not None and known["label"].any():
            yield pd.DataFrame({"network": [pickle.dumps(train(list(zip(known["text"], known["label"]))))]})

    found = rows.repartition(1).mapInPandas(fit, "network binary").collect()
    return pickle.loads(found[0]["network"]) if found else None


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    `labels` has doc_id, toxic (0 or 1). The network is trained on a bounded sample of the rows
    that aren't held out (crc32 of the doc_id's digits mod 5 is 0) and sees the text alone. The
    windows at all starts in whole texts are scored; a document's score is that of its highest window. Null, empty and word-less texts score 0; so does every text when no label 1 is known.
    Rows without a doc_id are scored and not held out. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained(sample(docs, labels)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = None if sent.value is None else Scorer(sent.value)
        for texts in batches:
            yield pd.Series([0.0] * len(texts) if scorer is None else scorer.scores(list(texts)), dtype="float64")

    done = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return done.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
