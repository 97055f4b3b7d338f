import math
from collections import Counter

import numpy as np

from docloom.llm import langid
from tests.llm.helpers import SF, docs

EN = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun for the rest of the day "
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft er in der warmen sonne den ganzen tag "


def greedy(text, sample):
    """Phrases of the parse, by searching the sample for longer and longer pieces."""
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        count, i = count + 1, i + n
    return count


def test_phrase_counts_equal_search():
    rng = np.random.default_rng(1)
    sample = "".join(rng.choice(list("abcd "), 700))
    texts = ["".join(rng.choice(list("abcd e"), n)) for n in (1, 5, 255, 256, 257, 900)]
    counts, sizes = langid.phrase_counts(texts, (("x", sample),))
    for t, c, n in zip(texts, counts[:, 0], sizes, strict=True):
        assert n == len(t)
        assert c == greedy(t, sample)


def test_lanes_don_t_show():
    """Texts on which parses that begin at different places may never meet, alone and beside others."""
    rng = np.random.default_rng(3)
    samples = (("a", "aaa"), ("ab", "abab" * 5 + "ba"), ("w", "".join(rng.choice(list("abc "), 300))), ("z", "\u4e00" * 5 + "\u4e01\u4e00"))
    texts = ["a" * n for n in (1, 3, 256, 257, 5000)] + ["", "ab" * 900 + "ba" * 700, "\u4e00" * 3000 + "\u4e01", "xyz" * 400]
    texts += ["".join(rng.choice(list("abc "), 3000)) + "a" * 2000 + "".join(rng.choice(list("abc "), 900)) + "a" * 1111 + "b"]
    for group in (texts, texts[::-1], *([t] for t in texts)):
        counts, _ = langid.phrase_counts(group, samples)
        for t, row in zip(group, counts, strict=True):
            assert row.tolist() == [greedy(t, s) for _, s in samples], t[:20]


def test_fewest_normalised_phrases_win():
    model = (("de", DE), ("en", EN))
    for text, want in (("the dog sleeps in the sun", "en"), ("der hund schläft in der sonne", "de"), ("THE DAY", "en")):
        lang, score, bits = langid.judge([text], model)[0]
        rates = {k: langid.phrase_counts([text], model)[0][0][i] * math.log2(max(len(EN), len(DE))) / len(text) for i, (k, _) in enumerate(model)}
        assert lang == want == min(rates, key=rates.get) and 0 < score <= 1 and bits == min(rates.values())


def test_whole_table_equals_brute_force(spark):
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    learned = sorted(langid.learn(docs_).items())
    texts = {r["doc_id"]: r["text"] for r in docs_.where("length(text) < 6000").collect()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op3_language_id(spark, SF).collect()}
    assert len(texts) > 100
    for i, t in texts.items():
        if not langid.LETTER.search(t or ""):
            assert got[i] == ("und", 0.0)
            continue
        counts = [greedy(t.lower(), s) for _, s in learned]
        best = min(range(len(counts)), key=counts.__getitem__)
        rest = min(c for k, c in enumerate(counts) if k != best)
        assert got[i] == (learned[best][0], 1 - counts[best] / rest)


def test_five_scripts(spark):
    rng = np.random.default_rng(5)
    words = {g: ["".join(map(chr, rng.integers(a, b, rng.integers(*n)))) for _ in range(900)] for g, a, b, n in (
        ("en", 97, 123, (2, 8)), ("ru", 0x430, 0x450, (2, 8)), ("zh", 0x4E00, 0x5200, (1, 4)), ("ja", 0x3041, 0x3097, (1, 6)), ("ko", 0xAC00, 0xAF00, (1, 5)),
    )}
    rows = [(i, " ".join(rng.choice(words[g], 120)), g, "a") for i, g in enumerate(list(words) * 60)]
    df = docs(spark, rows)
    learned = langid.learn(df)
    assert len(set("".join(learned.values()))) > 500
    out = langid.identify_languages(df, learned).where(langid.held_out()).collect()
    assert len(out) > 30 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.9


def test_ties_go_to_the_first_language():
    assert langid.judge(["same words", "\u4e00\u4e01"], (("a", EN + "same words"), ("b", EN + "same words"))) == [("a", 0.0, langid.judge(["same words"], (("a", EN + "same words"),))[0][2]), ("a", 0.0, langid.judge(["\u4e00\u4e01"], (("a", EN + "same words"),))[0][2])]


def test_a_short_sample_is_no_advantage():
    lang, _, _ = langid.judge(["1 2 3 4 5 6 7 8 9 the dog sleeps 10 11"], (("en", EN * 30), ("rare", "1 2")))[0]
    assert lang == "en"


def test_samples_beyond_the_tables_are_refused():
    import pytest

    with pytest.raises(ValueError):
        langid.phrase_counts(["a"], (("x", "".join(map(chr, range(0x4E00, 0x4E00 + 20_000))) * 2),))


def test_whole_texts_teach(spark):
    text = "".join(np.random.default_rng(4).choice(list("abcdefgh "), 40_000))
    learned = langid.training_sample(docs(spark, [(1, text, "one", "a")]))
    assert learned == {"one": text[: langid.SAMPLE_CHARS]}


def test_held_out_accuracy(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = langid.op3_language_id(spark, SF).join(rows, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97


def test_held_out_labels_and_ids_teach_nothing(spark):
    rows = [(i, EN, "en", "a") for i in range(40)]
    df = docs(spark, rows)
    out = {r["doc_id"]: r["h"] for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    marked = docs(spark, [(i, DE if out[i] else EN, "de" if out[i] else "en", "a") for i in range(40)])
    assert set(langid.learn(marked)) == {"en"}


def test_sample_is_bounded(spark):
    df = docs(spark, [(i, EN * 400, "en", "a") for i in range(100)] + [(1000, "x" * 10, "tiny", "a")])
    learned = langid.training_sample(df)
    assert len(learned["en"]) <= langid.SAMPLE_CHARS and learned["tiny"] == "x" * 10


def test_nulls_empty_long_repeats_and_clashes(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "123 !!"), (4, EN * 3000), (4, EN * 3000), (None, "é")]).withColumnRenamed("source", "score")
    out = langid.identify_languages(df, {"en": EN, "de": DE})
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score", "lang_bits"]
    got = Counter((r["doc_id"], r["lang_pred"]) for r in out.collect())
    assert got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == 1 and got[(4, "en")] == 2
    assert langid.identify_languages(df.limit(0), {"en": EN}).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(df, {}).collect()} == {"und"}
    assert langid.learn(df.limit(0)) == {}


def test_every_character_of_the_samples_has_a_code():
    # Two large scripts and one small: far more characters than the dense tables have columns.
    rng = np.random.default_rng(2)
    zh = "".join(map(chr, rng.integers(0x4E00, 0x5200, 6000)))
    astral = "".join(map(chr, rng.integers(0x20000, 0x20100, 3000)))
    samples = (("en", EN * 20), ("xx", astral), ("zh", zh))
    texts = [zh[700:1500], astral[50:400] + "\u4e00?", EN, zh[5:90] + EN + astral[7:80], "\U0002ffff" * 9 + zh[:3]]
    counts, _ = langid.phrase_counts(texts, samples)
    for t, row in zip(texts, counts, strict=True):
        for c, (_, s) in zip(row, samples, strict=True):
            assert c == greedy(t.lower(), s.lower())
    judged = langid.judge(texts[:3], samples)
    assert [j[0] for j in judged] == ["zh", "xx", "en"] and max(j[2] for j in judged) < 2
