"""An index of some terms, made for one search, against the whole index."""

import random

from skein.functions import stem as S
from skein.operators import search as Q

FIELDS = ["user_text", "assistant_text"]


def messages(spark):
    rng = random.Random(4)
    words = ["edit", "editing", "edited", "editor", "able", "ability", "abilities", "thane", "thanes", "theme", "them", "with", "wit", "happy", "happiness", "Édit"]
    rows = [("s%d" % (i % 5), i, " ".join(rng.choices(words, k=rng.randrange(9))), rng.choice(words)) for i in range(60)]
    return spark.createDataFrame(rows, "session_id string, msg_index long, user_text string, assistant_text string")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_some_terms_of_a_plain_index(spark):
    some = Q.build_index(messages(spark), FIELDS, stem=False, only=["with"], prefixes=["th", "ed"])
    whole = Q.build_index(messages(spark), FIELDS, stem=False)
    wanted = whole.postings.filter("term = 'with' OR term LIKE 'th%' OR term LIKE 'ed%'")
    assert rows(some.postings) == rows(wanted) and rows(some.corpus) == rows(whole.corpus)
    got, want = (Q.bm25_prefixes(i, ["with"], ["th", "ed"], dict.fromkeys(FIELDS, 1.0)) for i in (some, whole))
    assert rows(got) == rows(want)


def test_some_terms_of_a_stemmed_index(spark):
    terms = Q.query_terms(["editing", "ability", "happiness", "absent"])
    some = Q.build_index(messages(spark), FIELDS, only=terms, prefixes=["the"])
    whole = Q.build_index(messages(spark), FIELDS)
    wanted = whole.postings.filter(whole.postings["term"].isin(terms) | whole.postings["term"].startswith("the"))
    assert wanted.count() > 20 and rows(some.postings) == rows(wanted) and rows(some.corpus) == rows(whole.corpus)


def test_a_stem_begins_like_its_word():
    rng = random.Random(1)
    ends = [*S.STEP2, *S.STEP3, *S.STEP4, "y", "ed", "ing", "s", "es", "ies", "sses", "eed", "ility", "ably", "bly", "ity", "ly", "at", "bl", "iz"]
    for _ in range(40_000):
        word = "".join(rng.choices("abeiotrlnsyzh", k=rng.randrange(6))) + "".join(rng.choices(ends, k=rng.randrange(4)))
        stem = S.porter(word)
        assert word.startswith(stem[: -S.STEM_TAIL]), (word, stem)
