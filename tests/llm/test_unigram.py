import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from cohortgrid.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, unk=0, fallback=True):
    tok = Tokenizer(models.Unigram(list(pieces), unk_id=unk, byte_fallback=fallback))
    tok.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return tok


@pytest.fixture(scope="module")
def pair():
    pieces = unigram.vocabulary(PATH)
    return unigram.Counter(pieces), library(pieces)


def same(pair, text):
    assert pair[0].count(text) == len(pair[1].encode(text, add_special_tokens=False).ids), text


SAMPLES = [" ", "  a   b ", "naïve café\n\n\tx", "文字🎉  ", "▁ ▁▁a", "<s> <unk> <0x0A>", "x" * 500, "thnttionwh eringing " * 50]


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(pair, text):
    same(pair, text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(min_size=1, max_size=60))
def test_any_text(pair, text):
    same(pair, text)


def test_documents(pair, spark, folder):
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect():
        if row["text"]:
            same(pair, row["text"])


def test_ties_and_fractions_match_the_library():
    rng = random.Random(3)
    bytes_ = [(f"<0x{b:02X}>", -30.0) for b in range(256)]
    for whole in (True, False):
        for _ in range(30):
            words = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))) for _ in range(25)} | {"▁", "a"}
            pieces = [("<unk>", 0.0), *bytes_, *((w, float(rng.randint(-4, -1)) if whole else -rng.random()) for w in sorted(words))]
            both = unigram.Counter(tuple(pieces)), library(pieces)
            for _ in range(20):
                same(both, "".join(rng.choices("abcd \né", k=rng.randint(1, 30))))


def test_query_rows(make, pair):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "é 文")]
    got = sorted(map(tuple, unigram.token_counts(make(rows), PATH).collect()), key=str)
    want = [(d, len(t or ""), len(pair[1].encode(t, add_special_tokens=False).ids) if t else 0) for d, t in rows]
    assert got == sorted(want, key=str)
    assert unigram.token_counts(make([]), PATH).count() == 0
