import zlib

import numpy as np

from cohortgrid.llm import language

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other thing that was there with this",
    "de": "der schnelle braune fuchs springt und dann ist das nicht ein hund sondern die katze der welt auch",
    "fr": "le renard brun saute par dessus le chien et les autres sont dans la maison avec une pomme pour elle",
}


def corpus(n=90):
    rows = []
    for i in range(n):
        lang = list(TEXTS)[i % 3]
        w = TEXTS[lang].split()
        rows.append((i, " ".join(w[(i * 7 + j * 3) % len(w)] for j in range(25)), lang))
    return rows


def plain_counts(text):
    out = {}
    for w in language.WORD((text or "").lower()):
        line = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                g = line[i : i + n]
                if g != " ":
                    key = 0
                    for c in g:
                        key = key << 21 | ord(c)
                    out[key] = out.get(key, 0) + 1
    return out


def plain_rank(counts, top):
    return [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:top]


def test_grams_of_a_text():
    text = "Ab é, Ab 12 c"
    want = plain_counts(text)
    key, n = np.unique(language.grams(text), return_counts=True)
    # a blank between words ends one and begins the next, so it counts once for both sides
    assert dict(zip(key.tolist(), n.tolist())) == want
    assert language.grams("12 ² ...") is None and language.grams(None) is None


def test_matches_out_of_place_distances(make):
    rows = corpus() + [(200, None, "en"), (201, "", "de"), (202, "123 !!", None), (203, "der hund", None), (None, "the dog", "fr"), (0, "the dog", "en")]
    top = 40
    profiles = {}
    for d, t, lang in rows:
        if lang and d is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            for k, n in plain_counts(t).items():
                own = profiles.setdefault(lang, {})
                own[k] = own.get(k, 0) + n
    ranks = {lang: {k: i for i, k in enumerate(plain_rank(c, top))} for lang, c in profiles.items()}
    want = []
    for d, t, _ in rows:
        held = d is not None and zlib.crc32(str(d).encode()) % 4 == 2
        own = plain_rank(plain_counts(t), top)
        if not own:
            want.append((d, held, "und", 0.0))
            continue
        away = {lang: sum(abs(r[k] - i) if k in r else top for i, k in enumerate(own)) for lang, r in ranks.items()}
        best = min(sorted(away), key=away.get)
        want.append((d, held, best, round(1 - away[best] / (top * len(own)), 9)))
    got = [(r[0], r[1], r[2], round(r[3], 9)) for r in language.languages(make(rows), top).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_held_out_accuracy(make):
    rows = corpus(150)
    want = {d: lang for d, _, lang in rows}
    got = [r for r in language.languages(make(rows)).collect() if r["held_out"]]
    assert got and all(r["lang_pred"] == want[r["doc_id"]] for r in got)


def test_empty_and_no_languages(make, spark):
    assert language.languages(make([])).count() == 0
    assert [r["lang_pred"] for r in language.languages(make([(1, "abc", None)])).collect()] == ["und"]
    odd = spark.createDataFrame([(1, "abc abc", "en", "x"), (2, "12", "en", "y")], "doc_id long, text string, lang string, score string")
    assert [r["score"] for r in language.keep_known(odd).collect()] == ["x"]


def test_stage_keeps_columns_of_any_name_and_texts_of_no_known_language(make, spark):
    odd = spark.createDataFrame([(1, "abc abc", "en", "x", 5), (2, "12", "en", "y", 6)], "doc_id long, text string, lang string, _answer string, _language int")
    assert [tuple(r) for r in language.keep_known(odd).collect()] == [(1, "abc abc", "en", "x", 5)]
    rows = [(1, "der hund", None), (2, None, None), (3, "12 ² !", None), (4, "", None), (5, "Ω", None), (5, "Ω", None)]
    assert sorted(r["doc_id"] for r in language.keep_known(make(rows)).collect()) == [1, 5, 5]
