import hashlib
from collections import defaultdict

import pytest

from skein.llm import exact
from tests.llm import cases


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_groups_match_brute_force(spark, bits):
    docs = cases.awkward(spark)
    got = exact.exact_groups(docs, capacity=4, key_bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(docs.collect())
    for sha in {r["text_sha256"] for r in got}:
        assert [r["kept"] for r in got if r["text_sha256"] == sha].count(True) == 1
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_empty(spark):
    assert exact.exact_groups(cases.empty(spark)).count() == 0
    assert exact.drop_copies(cases.empty(spark)).count() == 0


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    docs = cases.awkward(spark)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in docs.collect()})
    assert {r["doc_id"] for r in left.collect() if r["text"] == "same text here"} == {12}


def test_directory_doubles_only_where_needed(spark):
    index = exact.Index(spark, "unused", 1)
    assert index.slots == [2, 3]
    index.split({2: 1})
    assert index.depth == 2 and index.slots == [4, 5, 3, 3]
    index.split({3: 1})  # room in the directory: no doubling
    assert index.depth == 2 and index.slots == [4, 5, 6, 7]
    index.split({5: 2})
    assert index.depth == 4 and index.slots == [4] * 4 + [20, 21, 22, 23] + [6] * 4 + [7] * 4


def links_of(df):
    return df.selectExpr("key", "sha", "n", "doc_id AS keep_id", "row AS keep_row")


def test_overfull_buckets_split_alone(spark, tmp_path):
    """A crowded key range splits on; buckets elsewhere are written once."""
    even = spark.range(400).selectExpr("xxhash64(id) AS key", "unhex(sha2(cast(id AS string), 256)) AS sha", "1L AS n", "id AS doc_id", "id AS row")
    crowded = spark.range(1000, 1600).selectExpr(
        "shiftright(xxhash64(id), 6) & 144115188075855871L AS key", "unhex(sha2(cast(id AS string), 256)) AS sha", "1L AS n", "id AS doc_id", "id AS row"
    )
    index = exact.Index(spark, str(tmp_path), 2)
    stored = index.fill(links_of(even.union(crowded)), 100, 12)
    assert index.passes > 1
    assert sorted(r["keep_id"] for r in stored.select("keep_id").collect()) == [*range(400), *range(1000, 1600)]
    spans = stored.selectExpr("bucket", "shiftrightunsigned(key, 1) AS k").groupBy("bucket").agg({"k": "min", "*": "count"}).collect()
    assert max(r["count(1)"] for r in spans) <= 100
    order = {b: n for n, b in enumerate(dict.fromkeys(index.slots))}  # buckets are ranges of keys
    lows = [r["min(k)"] for r in sorted(spans, key=lambda r: order[r["bucket"]])]
    assert lows == sorted(lows)
    second = {r["bucket"] for r in spark.read.parquet(f"{tmp_path}/buckets/pass=1").select("bucket").collect()}
    assert second and all(b.bit_length() > 3 for b in second)
    assert spark.read.parquet(f"{tmp_path}/directory").count() == len(index.slots) == 1 << index.depth


def test_a_bucket_of_one_key_stays_whole(spark, tmp_path):
    rows = spark.range(50).selectExpr("7L AS key", "unhex(sha2(cast(id AS string), 256)) AS sha", "1L AS n", "id AS doc_id", "id AS row")
    index = exact.Index(spark, str(tmp_path))
    assert index.fill(links_of(rows), 4, 8).count() == 50 and index.depth == 0


def test_owners_merge_without_another_shuffle(spark, tmp_path):
    rows = spark.range(50).selectExpr("id AS key", "unhex(sha2(cast(id AS string), 256)) AS sha", "1L AS n", "id AS doc_id", "id AS row")
    owned = exact.Index(spark, str(tmp_path), 2).owned(links_of(rows)).groupBy("bucket", "key", "sha").count()
    assert owned._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_text_that_fills_the_table(spark):
    docs = cases.documents(spark, ["hot text"] * 3000 + [f"own {n}" for n in range(300)], clash=False).repartition(7)
    got = exact.exact_groups(docs, capacity=20).collect()
    assert len(got) == 3300 and {r["group_size"] for r in got} == {1, 3000}
    assert {r["keep_id"] for r in got if r["group_size"] > 1} == {2999} and sum(r["kept"] for r in got) == 301
