"""Slugs against plain Python over every code point, and slugs cut before the whole text is looked at."""

import re

from pyspark.sql import functions as F

from skein.functions import text as X


def test_slugs_of_all_code_points(spark):
    texts = ["".join(map(chr, range(at, min(at + 4096, 0x110000)))) for at in range(0, 0x110000, 4096) if not 0xD000 <= at < 0xE000]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    got = rows.select("x", X.slug_dashes("x").alias("d"), X.slug_underscores("x").alias("u")).collect()
    for r in got:
        assert r["d"] == re.sub("[^a-zA-Z0-9-]", "-", r["x"]).lower()
        assert r["u"] == re.sub("[^a-zA-Z0-9_-]", "_", r["x"]).lower()


def test_runs_cut_early(spark):
    def slug(text, limit):
        return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", text.lower()))[:limit]

    texts = ["", "---", "a" * 9, "a" * 10, "a" * 11, "a" * 9 + "-" * 200, "-" + "a" * 9 + "!" * 100, "-" * 300 + "b c", "é" * 79 + "x y z" * 9, "a " * 80]
    texts += ["".join("ab- "[(i * k) % 4] for i in range(k)) for k in range(70, 100)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.slug_runs("x", 10).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in got] == [(t, slug(t, 10)) for t in texts]


def test_a_long_text_costs_its_head(spark):
    """The slug of limited length must not run the pattern over the whole text."""
    plan = spark.createDataFrame([("a",)], "x string").select(X.slug_runs(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(x#" in plan
