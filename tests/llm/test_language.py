import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from vecloom.llm import language

VOCABULARY = P.path("piece_bpe_32k.model")
PIECES = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]


def brute(word, k, p):
    """Sum over all ways to cut a word into pieces or, where a letter is none, that letter."""
    if not word:
        return 1.0
    total = sum(p[PIECES.index(word[:n]), k] * brute(word[n:], k, p) for n in range(1, len(word) + 1) if word[:n] in PIECES)
    return total + (0 if word[0] in PIECES else p[len(PIECES), k] * brute(word[1:], k, p))


def test_forward_sums_all_segmentations():
    p = np.random.default_rng(0).random((8, 2))
    words = ["abab", "bacb", "cabb", "abba", "xxxx"]
    got = np.exp(language.score_words(language.Pieces(PIECES), words, p))
    assert np.allclose(got, [[brute("▁" + w, k, p) for k in (0, 1)] for w in words])


def test_expected_counts():
    """Each piece's expected uses are the derivative of the log-sum by its log-probability."""
    p = np.random.default_rng(1).random(8)
    words, freq = ["abab", "abba", "cabb"], np.array([2.0, 1.0, 3.0])
    got = language.expected_counts(language.Pieces(PIECES), words, freq, p)
    for i in range(8):
        up = p.copy()
        up[i] *= 1 + 1e-6
        value = lambda q: sum(f * np.log(brute("▁" + w, 0, q[:, None])) for w, f in zip(words, freq))
        assert got[i] == pytest.approx((value(up) - value(p)) / 1e-6, rel=1e-3, abs=1e-4)


def test_text_scores_and_posterior():
    """A text's score is its words' log-sums by frequency; the winner's share is that of the products themselves."""
    p = np.random.default_rng(3).random((8, 3))
    pieces = language.Pieces(PIECES)
    for text in ("abba ab baab", "a1b_ab! cab", "ba", "cc abab cc abab"):
        table = language.word_table(text)
        scorer = language.Scorer(pieces, p)
        scorer.learn(set(table))
        want = np.array([np.prod([brute("▁" + w, k, p) ** n for w, n in table.items()]) for k in range(3)])
        assert np.allclose(scorer.text(table), np.log(want))
        best, share = language.posterior(scorer.text(table))
        assert best == np.argmax(want) and share == pytest.approx(want.max() / want.sum())


@pytest.mark.parametrize("letter", ["ꦄ", "Ꭰ", "ሀ"])
def test_long_words_of_unknown_letters(letter):
    pieces = language.Pieces(PIECES)
    p = np.vstack([np.full((7, 2), 1 / 7), np.full((1, 2), language.UNKNOWN)])
    words = [letter * language.LONGEST, "ab" * (language.LONGEST // 2)]
    scores = language.score_words(pieces, words, p)
    assert np.isfinite(scores).all() and scores[0, 0] == pytest.approx(math.log(1 / 7) + language.LONGEST * math.log(language.UNKNOWN))
    counts = language.expected_counts(pieces, words, np.array([3.0, 1.0]), p[:, 0])
    assert np.isfinite(counts).all() and counts[-1] == pytest.approx(3 * language.LONGEST)
    assert sum(language.word_table(letter * 5000).values()) == -(-5000 // language.LONGEST)


def test_logarithms_give_the_same(monkeypatch):
    p = np.random.default_rng(4).random((8, 2)) / 1e3
    pieces, words, freq = language.Pieces(PIECES), ["abab", "abxa", "cabb"], np.array([2.0, 1.0, 3.0])
    a = language.score_words(pieces, words, p), language.expected_counts(pieces, words, freq, p[:, 0])
    monkeypatch.setattr(language, "_in_range", lambda total: np.arange(len(total)) == 1)
    b = language.score_words(pieces, words, p), language.expected_counts(pieces, words, freq, p[:, 0])
    assert all(np.allclose(x, y) for x, y in zip(a, b))
    monkeypatch.undo()
    tiny = np.full((8, 2), 1e-30)
    assert np.isfinite(language.score_words(pieces, ["ab" * 20], tiny)).all() and np.isfinite(language.expected_counts(pieces, ["x" * 40], np.ones(1), tiny[:, 0])).all()


def test_odd_letters_in_training_and_prediction_change_no_other_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").limit(600)
    odd = [(10**6 + i, f"{'Ꭰ' * n} the and", "es") for i, n in enumerate((41, 48, 5000))]
    more = docs.union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    a = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, VOCABULARY).collect()}
    b = {r["doc_id"]: r for r in language.identify(more, VOCABULARY).collect()}
    same = [a[i] == b[i]["lang_pred"] for i in a]
    assert len(set(a.values()) - {"und"}) == 4 and np.mean(same) > 0.995
    assert all(np.isfinite(r["score"]) and 0 <= r["score"] <= 1 for r in b.values())


def test_letters_are_of_category_l():
    import unicodedata

    for text in ("½ ² Ⅷ ① _ 12 ٣", ""):
        assert not language.word_table(text)
    assert language.word_table("a½b Ⅷx 一二") == {"a": 1, "b": 1, "x": 1, "一二": 1}
    same = [c for c in map(chr, range(0x110000)) if c.lower() == c]
    assert set(language.word_table(" ".join(same))) == {c for c in same if unicodedata.category(c)[0] == "L"}


def test_remembered_scores_do_not_matter(monkeypatch):
    pieces = language.Pieces.from_sentencepiece(VOCABULARY)
    p = np.random.default_rng(2).random((pieces.unknown + 1, 3)) / 1e4
    tables = [language.word_table(t) for t in ("the cat sat", "le chat noir et le chien", "x" * 200 + " the")]
    whole = language.Scorer(pieces, p)
    whole.learn(set().union(*tables))
    want = [whole.text(t) for t in tables]
    monkeypatch.setattr(language, "REMEMBERED", 1)
    small = language.Scorer(pieces, p)
    for t, w in zip(tables, want):
        small.learn(set(t))
        assert np.allclose(small.text(t), w)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").join(language.identify(docs, VOCABULARY), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert len(held) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (sorted(map(tuple, language.identify(d, VOCABULARY).collect())) for d in (docs, other))
    assert a == b


def test_odd_rows(spark, odd, nothing):
    from pyspark.sql import functions as F

    out = language.identify(odd.withColumn("lang", F.when(F.col("doc_id") < 100, "aa").when(F.col("doc_id") < 250, "bb")), VOCABULARY).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by[300] == by[301] == by[302] == by[303] == [("und", 0.0)]
    assert by[304][0][0] in ("aa", "bb") and len(by[None]) == 3
    assert {r[0] for x in language.identify(odd.withColumn("lang", F.lit(None).cast("string")), VOCABULARY).collect() for r in [(x["lang_pred"],)]} == {"und"}
    assert language.identify(nothing, VOCABULARY).count() == 0
