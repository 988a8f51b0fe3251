import pyarrow as pa

from skein.llm import decontaminate, langid, nearcopies
from skein.session import WRITING, gathered, materialise


def test_long_rows_reach_workers_a_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    before = {key: spark.conf.get(key, None) for key in WRITING}
    long = spark.range(0, 2000, numPartitions=1).selectExpr("repeat('x', 10000) AS text")
    got = materialise(long.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r["rows"] for r in got) == 2000 and max(r["bytes"] for r in got) < 3 << 20
    assert {key: spark.conf.get(key, None) for key in WRITING} == before


def test_gathered_results_read_long_rows_a_few_at_a_time(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    before = {key: spark.conf.get(key, None) for key in WRITING}
    long = spark.range(0, 2000, numPartitions=1).selectExpr("repeat('x', 10000) AS text")
    got = gathered(long.mapInArrow(sizes, "rows long, bytes long")).to_pylist()
    assert sum(r["rows"] for r in got) == 2000 and max(r["bytes"] for r in got) < 3 << 20
    assert {key: spark.conf.get(key, None) for key in WRITING} == before


def test_stages_of_the_pipeline_read_long_rows_a_few_at_a_time(spark, monkeypatch):
    """Before: one batch of 600 rows in the passes that count, sketch, sample and tell languages."""

    def guarded(module, name):
        cut = getattr(module, name)

        def run(batches, *args):
            def checked():
                for batch in batches:
                    assert isinstance(batches, list) or batch.nbytes < 3 << 20, batch.nbytes  # a list: what a task gives back
                    yield batch

            return cut(checked(), *args)

        monkeypatch.setattr(module, name, run)

    for module, name in ((decontaminate, "pieces"), (langid, "pieces"), (nearcopies, "lean")):
        guarded(module, name)
    # on plain rows, as stored ones come in the batches of their files
    docs = spark.range(0, 600, numPartitions=1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 1500), i -> concat('w', hash(id, i)))) AS text", "'en' AS lang")
    assert langid.known_language(docs).count() <= 600
    nearcopies.frequent_shingles(docs)
    words = decontaminate.numbered(docs.select("doc_id", "text"))
    idf = decontaminate.inverse_frequencies(words)
    assert decontaminate.sketch(words, idf)[1].any()
