import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from skein.llm import decontaminate, exact, langid
from skein.llm.plans import ORACLE, QUERIES
from skein.session import materialise
from tests.llm import cases
from tests.llm.test_nearcopies import brute

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = set(queries())
    assert {"pipeline", *QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(oracle_sql()) and "pipeline" not in oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    from compare import connect, difference

    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, materialise(stage(spark, kept, FOLDER), f"test-{name}")
        seen[name] = (before, kept)
        if name != "pack":
            assert kept.columns == columns
            assert kept.exceptAll(before).count() == 0
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["language"]
    assert ids(after) == {r["doc_id"] for r in langid.identify(before).collect() if r["lang_pred"] != "und" and r["score"] >= langid.LEAST}
    before, after = seen["exact_dedup"]
    texts = {}
    for r in before.collect():
        texts[r["text"]] = max(r["doc_id"], texts.get(r["text"], -1))
    assert ids(after) == set(texts.values()) == {r["doc_id"] for r in exact.exact_groups(before).collect() if r["kept"]}
    before, after = seen["near_dedup"]
    groups, _ = brute({r["doc_id"]: r["text"] for r in before.collect()})
    assert ids(after) == {i for i, first in groups.items() if i == first}
    before, after = seen["decontamination"]
    hits = decontaminate.contaminated(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert ids(after) == ids(before) - ids(hits) and ids(hits)
    assert ids(seen["pack"][1]) == ids(after)
    run = corpus_pipeline.run(spark, FOLDER)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert run.select(cols).exceptAll(seen["pack"][1].select(cols)).count() == 0


def test_awkward_tables(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = ["the cat sat on the mat and the dog ran home"] * 6
    docs = cases.documents(spark, [*cases.TEXTS, *prose, None], [*cases.IDS, *range(40, 46), None], ["en"] * (len(cases.TEXTS) + 7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 45 in {r["doc_id"] for r in rows} and not {0, 1, 2} & {r["doc_id"] for r in rows}
    docs.filter("doc_id < 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
