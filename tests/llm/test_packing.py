import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skein.llm import packing
from skein.llm.plans import WORD_TOKENIZER
from tests.llm import cases

ODD = [
    "don't STOP, it's 3.14!! naïve café́ <|endoftext|> x<|startoftext|>y", "ΑΣ ΑΣ. ΟΔΟΣ", "a b c　d\x0be\x1cf\x85g",
    "é ́x", "﻿bom", "tab\tnew\nline\r\n", "漢字かな交じり 文", "🙂🙃 👩‍👩‍👧", "a" * 500, "1234567890 ½ ²", "​zero‍width", "İstanbul ǅ ŉ",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_TOKENIZER)


def test_ids_are_the_tokenizers(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.collect()] + ODD + [t or "" for t in cases.TEXTS]
    ids = packing.Ids(WORD_TOKENIZER)
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        for t, got in zip(part, ids.of(part)):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:80]
    assert list(ids.of(texts[:50])) == list(ids.of(texts[:50])) and list(ids.of([""])) == [b""]  # nothing new to learn


def test_simple_texts_are_cut_as_the_tokenizer_cuts(tokenizer):
    ids = packing.Ids(WORD_TOKENIZER)
    simple = [c for c in map(chr, range(0x2100)) if packing._SIMPLE.fullmatch(c)]
    assert len(simple) > 700 and not {"Σ", "İ", "²", "\u0301", "\xad"} & set(simple)
    texts = [t for c in simple for t in (c, f"a{c}b", f"({c}t{c}).", f"{c}{c}'{c}", f"1{c}'s", f"N'{c}e\u00e9")]
    rng = random.Random(5)
    some = "abSTrevmld'\u00e9\u0416\u00df\u01c5 \n.,;-_<|>\u2013\u20261234"
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 40))) for _ in range(6000)]
    texts += ["'s", "''s", "'S.", "('ll)", "'re", "s'", "'", "...", "<|endoftext|>", "a<|ENDOFTEXT|>b c", "(<|startoftext|>)", "x'", "'x"]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for t, got in zip(part, ids.of(part), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_a_full_word_table_gives_the_same_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    ids = packing.Ids(WORD_TOKENIZER)
    texts = [" ".join(f"word{(i * j) % 97}" for j in range(30)) for i in range(60)]
    for t in texts:
        assert np.frombuffer(next(ids.of([t])), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check(rows, texts, tokenizer, sequence):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == list(range(0, len(ids), sequence))
        for r in own:
            part = ids[r["start"] : r["start"] + sequence]
            assert r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= sequence
    return len(places)


def test_pack_awkward_rows(spark, tokenizer):
    docs = cases.documents(spark, [*cases.TEXTS, *ODD], clash=True)
    rows = packing.pack(docs, WORD_TOKENIZER, sequence=64, open_bins=4, task_pieces=500).collect()
    check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer, 64)


def test_pack_is_dense(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, WORD_TOKENIZER).collect()
    n = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, tokenizer, 2048)
    assert n <= 1.06 * -(-sum(r["length"] for r in rows) // 2048)


def test_repeated_rows_null_ids_and_empty(spark):
    docs = cases.documents(spark, ["a b", "a b", None], [1, 1, None])
    rows = packing.pack(docs, WORD_TOKENIZER).collect()
    assert sorted((r["doc_id"] is None, r["length"], r["offset"]) for r in rows)[0][0] is False
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack(cases.empty(spark), WORD_TOKENIZER).count() == 0


def test_bins_best_fit_and_bounded():
    bins = packing.Bins(10, 2)
    assert bins.place(7) == (0, 0)
    assert bins.place(6) == (1, 0)
    assert bins.place(3) == (0, 7)  # the tightest bin that holds it
    assert bins.place(8) == (2, 0)
    assert bins.place(7) == (3, 0)  # a third open bin: the fullest (2) closes
    assert bins.place(2) == (3, 7)
    assert bins.place(4) == (1, 6)
    assert bins.open_bins() == {3}
