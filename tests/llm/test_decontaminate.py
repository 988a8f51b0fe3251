import random

import pytest

from skein.llm import decontaminate as dec
from tests.llm import cases

FOLDER = "/root/testdata/sf0.001"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(9) for _ in range(rng.randrange(1, 80))]
        b = [rng.randrange(9) for _ in range(rng.randrange(90))]
        assert dec.lcs(dec.positions(a), len(a), b) == slow_lcs(a, b)


def words_of(text):
    return [w for w in ("".join(c for c in t.lower() if c.isalnum()) for t in (text or "").split()) if w]


def test_planted_leaks_are_found_and_clean_texts_left(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rng = random.Random(11)
    host = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    texts, want = [], {}
    for n, (item, text) in enumerate(items.items()):
        words = text.split()
        if n % 3 == 1:  # a paraphrase: words lost and put in
            words = [w for i, w in enumerate(words) if i % 6]
            words.insert(len(words) // 2, "indeed")
        if n % 3 == 2:
            words = [w.upper() for w in words]
        around = host[n % len(host)].split()
        at = rng.randrange(len(around) + 1)
        want[10_000 + n] = item
        texts.append(" ".join([*around[:at], *words, *around[at:]]))
    planted = cases.documents(spark, texts, list(want), clash=False)
    both = docs.select("doc_id", "text").unionByName(planted.select("doc_id", "text"))
    got = {(r["doc_id"], r["item_id"]) for r in dec.contaminated(both, bench).collect()}
    found = sum((d, i) in got for d, i in want.items())
    assert found >= 0.95 * len(want)
    # brute force over the given documents: an item with most of its words, in order, in a window
    for r in docs.collect():
        words = words_of(r["text"])
        for item, text in items.items():
            own = words_of(text)
            if " ".join(own) in " ".join(words):
                assert (r["doc_id"], item) in got
            if (r["doc_id"], item) in got:
                span = 2 * len(own) + 20
                best = max(slow_lcs(own, words[i : i + span]) for i in range(0, len(words), span // 2))
                assert best >= 0.4 * len(own)


def test_latent_candidates_reach_nearly_all_of_brute_force(spark):
    """Recall of the cosine search in the latent space against exact TF-IDF cosines."""
    import numpy as np

    words = dec.numbered(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    idf = dec.inverse_frequencies(words)
    items = dec.Items(rows, idf)
    terms = dec.latent_terms(words, idf, items, 100)
    near = hit = 0
    for r in words.collect():
        _, features, weights = dec.content_of(np.frombuffer(r["words"], np.uint32), idf)
        for start in dec.passages(len(features)) if len(features) else ():
            f, w = features[start : start + 2 * dec.HALF], weights[start : start + 2 * dec.HALF]
            norm = np.sqrt((w * w).sum())
            exact = (w @ items.vectors.T[f]) / norm
            latent = (w @ terms[f]) / norm
            near += (exact >= 0.35).sum()
            hit += ((exact >= 0.35) & (latent >= dec.COSINE)).sum()
    assert near > 20 and hit >= 0.9 * near


def test_awkward_rows(spark):
    bench = spark.createDataFrame(
        [(1, "same text here"), (2, None), (3, ""), (4, "a rare passage about xylophones and quasars. The answer is zebra.")], "item_id long, text string"
    )
    docs = cases.awkward(spark)
    hits = dec.contaminated(docs, bench).collect()
    assert {r["item_id"] for r in hits} <= {1, 4}
    assert {3, 4, 5, 12} <= {r["doc_id"] for r in hits if r["item_id"] == 1}
    left = dec.without_benchmark(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({(r["doc_id"]) for r in hits})
    assert dec.contaminated(cases.empty(spark), bench).count() == 0
    assert dec.contaminated(docs, bench.filter("item_id < 0")).count() == 0
    assert dec.without_benchmark(docs, bench.filter("item_id < 0")).count() == docs.count()


def test_answer_settles_a_middling_match():
    import numpy as np

    idf = np.ones(dec.FEATURES, dtype=np.float32)
    text = "one two three four five six seven eight nine ten. Eleven twelve."
    items = dec.Items([(7, text)], idf)
    m = dec.Matcher(idf, items, items.vectors.T)
    find = lambda text: m.find(dec.word_numbers(text))
    assert find("one two three four five eleven twelve")[0][3] is True
    assert not find("one two three four five six and no more")  # half of it, without the answer
    assert find("One two three four five six seven eight nine")
    assert not find("")


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 48, 49, 100])
def test_passages_cover_all_words(n):
    covered = set()
    for s in dec.passages(n):
        covered |= set(range(s, min(n, s + 2 * dec.HALF)))
    assert covered == set(range(n))


def matcher_for(texts, bench, spark):
    docs = cases.documents(spark, texts, clash=False)
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in dec.contaminated(docs, items).collect()}


def fillers(rng, n, vocabulary=4000, length=400):
    return [" ".join(f"f{int(vocabulary * rng.random() ** 3)}" for _ in range(length)) for _ in range(n)]


def paraphrase(rng, words):
    return [x for i, w in enumerate(words) if i % 7 for x in ([w, f"put{rng.randrange(9999)}"] if i % 4 == 0 else [w])]


def test_long_items_are_found_whole_and_paraphrased(spark):
    rng = random.Random(21)
    bench = [" ".join(f"q{rng.randrange(9000)}" for _ in range(n)) for n in (300, 2000)]
    texts, want = fillers(rng, 60), set()
    for item, text in enumerate(bench):
        for form in (text.split(), paraphrase(rng, text.split())):
            host = rng.choice(texts[:60]).split()
            want.add((len(texts), item))
            texts.append(" ".join([*host[:150], *form, *host[150:]]))
    assert matcher_for(texts, bench, spark) == want


def test_copies_do_not_hide_a_passage(spark):
    rng = random.Random(22)
    item = " ".join(f"q{i}" for i in range(40))
    texts = fillers(rng, 120)
    for i in range(0, 120, 3):  # a third of the rows hold it
        texts[i] += f" {item} end{i}"
    want = {(i, 0) for i in range(0, 120, 3)}
    for form in (paraphrase(rng, item.split()), [w if i != 20 else "other" for i, w in enumerate(item.split())], item.split()[:28]):
        want.add((len(texts), 0))
        texts.append(" ".join(["begin", *form, *fillers(rng, 1)[0].split()]))
    assert matcher_for(texts, [item], spark) == want


def test_long_texts_do_not_make_all_words_common(spark):
    rng = random.Random(23)
    texts = [" ".join(f"v{rng.randrange(60_000)}" for _ in range(9000)) for _ in range(24)]
    words = dec.numbered(cases.documents(spark, texts, clash=False))
    idf = dec.inverse_frequencies(words)
    numbers = dec.word_numbers(texts[0])
    assert (idf[numbers & (len(idf) - 1)] > 0).mean() > 0.5


def test_short_items_among_rarer_words(spark):
    rng = random.Random(24)
    bench = [" ".join(f"s{k}x{i}" for i in range(n)) for k, n in enumerate((4, 6, 8, 12))]
    texts = fillers(rng, 200)
    for i in range(0, 200, 8):  # their words are well known, one by one
        for text in bench:
            words = rng.sample(text.split(), 3)
            texts[i + rng.randrange(8)] += " " + " ".join(x for w in words for x in (*(f"f{rng.randrange(4000)}" for _ in range(40)), w))
    want = set()
    for item, text in enumerate(bench):
        junk = [f"junk{rng.randrange(10**9)}" for _ in range(80)]
        want.add((len(texts), item))
        texts.append(" ".join([*junk[:40], *text.split(), *junk[40:]]))
    assert want <= matcher_for(texts, bench, spark)


def test_sketch_covers_the_passages_of_every_document(spark):
    import numpy as np

    words = dec.numbered(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    idf = dec.inverse_frequencies(words)
    omega, got = dec.sketch(words, idf)
    want = np.zeros(got.shape)
    for r in words.collect():
        _, features, weights = dec.content_of(np.frombuffer(r["words"], np.uint32), idf)
        for start in dec.passages(len(features)) if len(features) else ():
            f, w = features[start : start + 2 * dec.HALF], weights[start : start + 2 * dec.HALF].astype(float)
            np.add.at(want, f, np.outer(w, w @ omega[f]) / (w @ w))
    assert np.abs(got - want).max() <= 1e-4 * np.abs(want).max()
    some = dec.sketch(words, idf, 20)[1]
    assert np.abs(some).sum() < 0.9 * np.abs(got).sum()


def test_words_are_numbered_alike_together_and_one_by_one():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(25)
    signs = "abzAZ09_-.,;!\u00e4\u0130\u03a3\u1e9e\u00a0\u2003\x1c\t\n   "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", " ", "x" * 500 + " y", "-- . _", "\u00e4" * 90, "a" * 48 + " " + "b" * 49, "q " * (dec.TOGETHER // 2)]
    column = pa.array(["left out", *texts])[1:]
    numbers, begins = dec.joined(dec.numbers_of(column))
    for k, text in enumerate(texts):
        assert np.array_equal(numbers[begins[k] : begins[k + 1]], dec.word_numbers(text or ""))
    assert dec.joined(dec.numbers_of(column[:0]))[1].tolist() == [0]


def test_a_text_keeps_its_items_among_others():
    """Texts searched together give what each gives alone with every item open to it."""
    import numpy as np

    rng = random.Random(26)
    idf = np.ones(dec.SLOTS, dtype=np.float32)
    bench = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (7, 20, 40, 90)]
    items = dec.Items(list(enumerate(bench)), idf)
    m = dec.Matcher(idf, items, items.vectors.T)
    texts = []
    for n in range(120):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(200))]
        if n % 2:
            own = rng.choice(bench).split()
            words += [w for w in own if rng.random() < rng.choice((0.35, 0.45, 0.7, 1))]
        texts.append(dec.word_numbers(" ".join(words)))
    begins = np.cumsum([0, *map(len, texts)])
    got = list(m.find_all(np.concatenate(texts), begins))
    want = [(n, hit) for n, words in enumerate(texts) for hit in m._find(words, np.ones(len(bench), dtype=bool))]
    assert got == want and len(want) > 30
