"""Awkward rows that every operator must take."""

from pyspark.sql import types as T

CLASHING = ("key", "fp", "row", "sha", "n", "kept", "held_out", "score", "component", "node", "x", "tokens", "sequence_id", "_hash", "_other", "_text_sha256", "__text_sha256__", "_id")


def documents(spark, texts, ids=None, langs=None, clash=True):
    """A documents table with extra columns named like the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    extra = CLASHING if clash else ()
    schema = T.StructType([T.StructField(n, k) for n, k in fields] + [T.StructField(n, T.StringType()) for n in extra])
    rows = [(i, t, g, "s", None if t is None else len(t), *("?" for _ in extra)) for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, schema)


LONG = "word another thing " * 30_000

#: null, empty, blank, tied, repeated and very long texts
TEXTS = [None, "", "  \n\t ", "same text here", "same text here", "Same text here", LONG, LONG + "end", "ümläut ẞ 漢字 🙂 text", None, "12", "?!"]
IDS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def awkward(spark):
    """TEXTS, one row with a null id, and one row twice."""
    return documents(spark, [*TEXTS, "same text here", "no id", "twice twice", "twice twice"], [*IDS, 12, None, 20, 20])


def empty(spark):
    return documents(spark, ["x"]).filter("doc_id < 0")
