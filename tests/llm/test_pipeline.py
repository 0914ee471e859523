"""run() against a brute-force version made of the operators' plain twins."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import test_contamination
import test_repeats
import test_simhash
from tokenizers import Tokenizer


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage, items = text(70), [(i, text(25)) for i in range(4)]
    rows = []
    for i in range(60):
        body = text(rng.randint(30, 150))
        if i % 7 == 0:
            body += " " + passage + " " + text(20)
        if i % 11 == 0:
            body += " " + " ".join(items[i % 4][1].split()[5:20])
        rows.append((i, body, "en" if i % 2 else "xx"))
        if i % 9 == 0:
            rows.append((100 + i, body, "en"))
    rows += [(300, None, "en"), (301, "12 34 !!", "en"), (302, "", None), (303, passage, "en"), (None, text(40), "en")]
    return rows, items


def plain(rows, items):
    rows = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    group = {d: g for d, _, g in test_simhash.expected(rows)}
    rows = [(d, t) for d, t in rows if d is None or group[d] == d]
    kept = {d: (n, gone, text) for d, n, gone, text in test_repeats.plain(rows, 50)}
    rows = [(d, kept[d][2] if kept[d][1] else t) for d, t in rows if not kept[d][1] or kept[d][1] < kept[d][0]]
    bad = {d for d, *_, hit in test_contamination.plain(rows, items, 10) if hit}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, t in rows:
        if d not in bad:
            ids = tok.encode(t, add_special_tokens=False).ids
            out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_run(make, spark, tmp_path):
    rows, items = corpus(3)
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    want = plain(rows, items)
    assert sorted(map(tuple, got), key=str) == want
    assert len(want) < len(rows) - 10


def test_stages_keep_the_columns(make, spark, tmp_path):
    docs = make(corpus(4)[0])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, make([]), str(tmp_path)).count() == 0
