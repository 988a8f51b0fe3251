import random

import public_tokenizers
import pytest

from skein.llm import tokencount
from tests.llm import cases

HOW = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def counter():
    return tokencount.loaded(*HOW)


def check(doc, counter):
    assert doc.tokens == len(counter.encoding.encode_ordinary(doc.text))
    t = doc.tree
    assert t.chars[1] == len(doc.text)
    for n in range(1, t.size):
        assert t.chars[n] == t.chars[2 * n] + t.chars[2 * n + 1] and t.tokens[n] == t.tokens[2 * n] + t.tokens[2 * n + 1]


PIECES = ["word", " word", "'re", "'", "r", "e", "  ", " ", "\n", "\n\n", "1", "23", "!!", "é", "漢", "🙂", "\t", "x" * 60, " don't ", "'ll", "　", "a b c "]


def test_random_edits_equal_counting_again(counter):
    rng = random.Random(17)
    for size in (0, 1, 5, 200, 3000):
        doc = tokencount.Document("".join(rng.choice(PIECES) for _ in range(size)), counter)
        check(doc, counter)
        for _ in range(120):
            at = rng.randrange(len(doc.text) + 3)
            doc.edit(at, rng.choice([0, 0, 1, 2, 7, 300]), "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 1, 3, 90]))))
            check(doc, counter)


def test_small_edits_touch_little_of_a_long_text(counter):
    doc = tokencount.Document("some words of a text that is long. " * 20_000, counter)
    doc.edit(350_000, 3, "abc")
    assert doc.recoded < 2000 and doc.written < 200
    check(doc, counter)


def test_tables(spark, counter):
    docs = cases.awkward(spark)
    trees = tokencount.build_trees(docs, *HOW).withColumn("edits", tokencount.sample_edits())
    rows, after = trees.collect(), tokencount.apply_edits(trees, *HOW).collect()
    assert len(rows) == len(after) == docs.count()
    for a, b in zip(sorted(rows, key=lambda r: (repr(r["doc_id"]), r["text"] or "")), sorted(after, key=lambda r: (repr(r["doc_id"]), -r["tokens_before"])) and sorted(after, key=lambda r: repr(r["doc_id"]))):
        if a["doc_id"] in (20, None):
            continue
        text = a["text"] or ""
        assert b["tokens_before"] == len(counter.encoding.encode_ordinary(text))
        for e in a["edits"]:
            at = min(e["position"], len(text))
            text = text[:at] + e["insert"] + text[at + e["delete"] :]
        assert b["text"] == text and b["tokens_after"] == len(counter.encoding.encode_ordinary(text))
    again = spark.createDataFrame(after, tokencount.apply_edits(trees, *HOW).schema).selectExpr(
        "doc_id", "text", "chars", "tokens", "array(null, named_struct('position', null, 'delete', null, 'insert', null)) AS edits"
    )
    assert sorted(r["tokens_after"] for r in tokencount.apply_edits(again, *HOW).collect()) == sorted(r["tokens_after"] for r in after)
    assert tokencount.build_trees(cases.empty(spark), *HOW).count() == 0


def test_query_over_the_table(spark, counter):
    from skein.llm.plans import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op6_edited_counts"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["tokens_before"] == len(counter.encoding.encode_ordinary(texts[r["doc_id"]]))
