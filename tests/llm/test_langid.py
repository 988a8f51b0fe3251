import zlib
from collections import Counter

import numpy as np
import pytest

from skein.llm import langid
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


def brute_grams(text):
    """Character n-grams with runs of non-letters as one blank."""
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    if not plain.strip():
        return []
    plain = " " + " ".join(plain.split()) + " "
    return [plain[i : i + n] for n in langid.SIZES for i in range(len(plain) - n + 1)]


@pytest.mark.parametrize("text", ["Hello, World!", "  a  ", "x", "ÀÉ ß 漢字 12ab", "?!", "", "a1b2", "end "])
def test_grams_match_brute_force(text):
    got = [g for block in langid.gram_blocks(text) for g in block.tolist()]
    want = brute_grams(text)
    assert len(got) == len(want)
    pairs = set(zip(sorted(Counter(got).values()), sorted(Counter(want).values())))
    assert all(a == b for a, b in pairs)


def test_blocks_of_a_long_text_lose_no_gram():
    text = "abc def " * 400_000
    whole = Counter()
    for block in langid.gram_blocks(text):
        whole.update(dict(zip(*np.unique(block, return_counts=True))))
    assert sum(whole.values()) == len(brute_grams(text))
    assert len(whole) == len(set(brute_grams(text)))


def test_filters_hold_all_grams_and_correct_for_false_hits():
    grams = np.concatenate([np.concatenate(list(langid.gram_blocks(t))) for t in ("the cat and the dog", "der hund und die katze")])
    first = np.concatenate(list(langid.gram_blocks("the cat and the dog")))
    lang = np.array([0] * len(first) + [1] * (len(grams) - len(first)))
    f = langid.Filters(["en", "de"], lang, grams)
    assert f.decide("the cat and the dog") == ("en", pytest.approx(1.0))
    assert f.decide("der hund und die katze")[0] == "de"
    assert f.decide(None) == ("und", 0.0) == f.decide("12 ?!")
    assert f.decide("zzz qqq")[1] == 0.0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = langid.identify(docs).collect()  # no language at all to learn from
    assert len(got) == docs.count() and {r["lang_pred"] for r in got} == {"und"}
    assert langid.identify(cases.empty(spark)).count() == 0
    en = ["the cat sat on the mat and the dog ran"] * 40
    de = ["der hund und die katze sind nicht auf dem tisch"] * 40
    mixed = cases.documents(spark, [*en, *de, None, "42", "the dog", "die katze"], langs=["en"] * 40 + ["de"] * 40 + ["en", None, None, None])
    by = {r["doc_id"]: r["lang_pred"] for r in langid.identify(mixed).collect()}
    assert (by[80], by[81], by[82], by[83]) == ("und", "und", "en", "de")
    kept = langid.known_language(mixed)
    assert kept.columns == mixed.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 41, 82, 83} <= ids and not ids & {80, 81}


def test_more_languages_than_a_mask_has_bits(spark):
    """One letter triple per language: the filter of language n answers for its texts and no other."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{n:03}" for n in range(150)]
    word = lambda n: alphabet[n // 26] * 3 + alphabet[n % 26] * 3
    rows = [(200 * k + n, " ".join([word(n)] * 5), names[n]) for n in range(150) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    want = {i: lang for i, _, lang in rows}
    assert len(got) == len(rows) and all(r["lang_pred"] == want[r["doc_id"]] for r in got)
    assert langid.known_language(docs).count() == len(rows)


def test_decisions_match_plain_sets(spark):
    """The same languages from sets of n-grams instead of sliced filters."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(400).collect()
    by = {}
    for r in docs:
        if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            by.setdefault(r["lang"], []).append(set(brute_grams(r["text"])))
    known = {}
    for lang, texts in by.items():
        n = Counter(g for t in texts for g in t)
        known[lang] = {g for g, c in n.items() if c >= max(1.0, langid.SHARE * len(texts))}
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(frame).collect()}
    for r in docs:
        grams = brute_grams(r["text"] or "")
        if not grams:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        shares = {lang: sum(g in s for g in grams) / len(grams) for lang, s in known.items()}
        best = max(shares.values())
        assert shares[got[r["doc_id"]]["lang_pred"]] >= best - 0.01
        assert got[r["doc_id"]]["score"] == pytest.approx(best, abs=0.01)
