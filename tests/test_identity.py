from skein.operators import identity


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "session_id string")


def test_clashing_starts_get_longer_tags(spark):
    names = ["abcdefgh-1", "abcdefgh-2", "abcdefgh", "abcdefgi-1", "short", "zzzzzzzz-1", "abcdefgh-2", None, "ähnlich-länger-1", "ähnlich-länger-2"]
    got = {r["session_id"]: r["tag"] for r in identity.session_tags(ids(spark, *names)).collect()}
    assert got == {
        "abcdefgh-1": "abcdefgh-1", "abcdefgh-2": "abcdefgh-2", "abcdefgh": "abcdefgh", "abcdefgi-1": "abcdefgi", "short": "short",
        "zzzzzzzz-1": "zzzzzzzz", "ähnlich-länger-1": "ähnlich-länger-1", "ähnlich-länger-2": "ähnlich-länger-2",
    }


def test_tags_across_partitions_resolve_to_their_session(spark):
    names = [f"{n // 7:05d}-{n:04x}" for n in range(900)]
    tags = identity.session_tags(ids(spark, *names).repartition(5))
    found = identity.resolve(tags.select("tag", tags["session_id"].alias("of")), ids(spark, *names)).collect()
    assert len(found) == 900 and all(r["status"] == "unique" and r["of"] == r["session_id"] for r in found)
    shorter = identity.resolve(tags.selectExpr("left(tag, length(tag) - 1) AS tag").distinct(), ids(spark, *names)).collect()
    assert {r["status"] for r in shorter if len(r["tag"]) > 8} == {"ambiguous"}


def test_support_counts_sessions_not_tags(spark):
    sessions = ids(spark, "abcdefgh-1", "abcdefgh-2", "other-session")
    cited = [("p", "abcdefgh-1:3"), ("p", "abcdefgh-1:9"), ("p", "other-se:1"), ("p", "other-session:2"), ("q", "abcdefgh:1"), ("q", "nobody:1"), ("q", ":4")]
    got = identity.support(spark.createDataFrame(cited, "proposal_id string, citation string"), sessions).collect()
    assert sorted(map(tuple, got)) == [("p", 2, 0, 0), ("q", 0, 1, 1)]


def test_no_sessions_and_no_citations(spark):
    assert identity.session_tags(ids(spark)).collect() == []
    asked = spark.createDataFrame([("x",)], "tag string")
    assert [r["status"] for r in identity.resolve(asked, ids(spark)).collect()] == ["unknown"]
    assert identity.resolve(asked.limit(0), ids(spark, "x")).collect() == []
