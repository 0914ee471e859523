import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Transducer(f.read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def same(ours, theirs, text):
    got = ours.encode(text)
    want = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got, "<u4").tolist() == want
    assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False) == text


SAMPLES = ["", " ", "\n\n \t x", "it's we'll I'd", "a<|endoftext|>b<|endoftext|>", "naïve café 12½ ²³ \x1c\x1d \u2003 文字 ١٢ 🎉", "A" * 300, "don’t  stop", "\u0300\u0301x"]


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(ours, theirs, text):
    same(ours, theirs, text)


def test_every_character_class(ours, theirs):
    points = [c for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 400):
        same(ours, theirs, "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}." for c in points[at : at + 400]))


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(ours, theirs, text):
    same(ours, theirs, text)


@pytest.mark.parametrize("step", [1, 7, 64])
def test_streams_long_pieces_with_the_computed_lookahead(ours, monkeypatch, step):
    monkeypatch.setattr(bpe, "STEP", step)
    rng = random.Random(step)
    for alphabet in ("a", "ab", ["the", "ing", "ation", "er"], "aeiounst"):
        data = "".join(rng.choices(alphabet, k=1500)).encode()
        assert list(ours.stream(data)) == ours._heap(data)
    assert ours._scan(b"interestingly") == ours._heap(b"interestingly")


def test_lookahead_of_a_small_merge_list():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    # x + abc can wait for ab + c, which waits for a + b: 1 + 2 is cut off, then x.
    assert bpe.sufficient_lookahead([("a", "b"), ("ab", "c"), ("x", "abc")]) == 3
    with pytest.raises(ValueError):
        spec = json.loads(open(PATH, encoding="utf-8").read())
        spec["model"]["merges"] = spec["model"]["merges"][::-1]
        bpe.Transducer(json.dumps(spec))


def test_decode_keeps_open_characters_between_steps(ours, monkeypatch):
    monkeypatch.setattr(bpe, "IDS", 1)
    assert ours.decode(ours.encode("🎉文")) == "🎉文"
    assert ours.decode(ours.encode("🎉")[:4]).startswith("\ufffd")


def test_query_rows(make, theirs):
    rows = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x" * 9000), (4, "<|endoftext|>")]
    got = sorted(map(tuple, bpe.token_digests(make(rows), PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for d, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.token_digests(make([]), PATH).count() == 0


def test_decode_column(make, spark):
    df = make([(1, "a é 文"), (2, None)])
    both = df.select(bpe.encode_decode(df["text"], spark, PATH).alias("x")).select("x.ids", "x.decoded")
    assert sorted(r[0] for r in both.select(bpe.decode(both["ids"], spark, PATH)).collect()) == ["", "a é 文"]
