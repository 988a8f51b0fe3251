import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from skein.llm import merkle
from skein.llm.ranks import ranked
from tests.llm import cases


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def siblings(tree, place):
    out = []
    for level in tree[:-1]:
        run = level[place // 3 * 3 :][:3]
        out.append((place % 3, [x for i, x in enumerate(run) if i != place % 3]))
        place //= 3
    return out


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: x[:3])
        trees[name] = levels([x[2] for x in sources[name]])
    top = levels([trees[name][-1][0] for name in names])
    root, out = top[-1][0] if names else None, []
    for at, name in enumerate(names):
        for place, (_, _, digest, r) in enumerate(sources[name]):
            proof, now = siblings(trees[name], place) + siblings(top, at), digest
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                now = leaf(r, r["text"].replace("\n", ""))
            for i, others in proof:
                now = h(*others[:i], now, *others[i:])
            out.append((r["doc_id"], digest, trees[name][-1][0], root, h(*(x for _, o in proof for x in o)), now, now == root))
    return sorted(out, key=repr)


def test_manifest_of_awkward_rows(spark):
    docs = cases.awkward(spark)
    turned = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("é")).otherwise(F.lit("z"))
    docs = docs.withColumn("source", turned).withColumns({n: F.lit("?") for n in ("tree", "rank", "size", "leaf", "path", "page", "claimed")})
    rows = docs.collect()
    assert sorted(map(tuple, merkle.audited(docs).collect()), key=repr) == brute(rows)


def test_trees_of_every_height(spark):
    texts, sources = [], []
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 243, 700):
        texts += [f"line {i}\n of {n}" for i in range(n)]
        sources += [f"s{n}"] * n
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None, s, len(t)) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, merkle.audited(docs).collect()), key=repr)
    assert got == brute(docs.collect())
    assert {g[-1] for g in got} == {True, False}


def test_more_sources_than_a_page(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "'a\n' || id AS text", "'en' AS lang", "'s' || id % 100 AS source", "5L AS n_chars")
    assert sorted(map(tuple, merkle.audited(docs).collect()), key=repr) == brute(docs.collect())


def test_one_document_none_and_equal_rows(spark):
    one = cases.documents(spark, ["a\nb"], ids=[1])
    assert sorted(map(tuple, merkle.audited(one).collect()), key=repr) == brute(one.collect())
    assert merkle.audited(cases.empty(spark)).collect() == []
    equal = cases.documents(spark, ["same\ntext"] * 400, ids=[2] * 400)
    assert sorted(map(tuple, merkle.audited(equal).collect()), key=repr) == brute(equal.collect())


def test_proofs_of_some_leaves_fold_to_the_root(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'t' || id AS text", "'en' AS lang", "IF(id % 3 = 0, 'a', 'b') AS source", "5L AS n_chars")
    manifest = merkle.build(docs)
    some = manifest.leaves.filter("rank IN (0, 80, 81, 299)").select("tree", "rank")
    proofs = merkle.prove(manifest, some.union(some)).collect()
    assert len(proofs) == 8
    for p in proofs:
        path = [(s["place"], list(s["others"])) for s in p["path"]]
        assert merkle.folded(p["leaf"], path) == manifest.root
        assert merkle.folded(b"x" * 32, path) != manifest.root
    stored = {bytes(r["digest"]) for page in manifest.pages for r in page.selectExpr("explode(records) AS r").select("r.*").collect()}
    assert {bytes(r["digest"]) for r in manifest.subroots.collect()} <= stored


def test_ranks_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, NULL, 'k') AS key", "pmod(id * 7919, 5000) AS at")
    got = ranked(rows, ["key"], ["at"], "test-ranks").collect()
    for key in (None, "k"):
        mine = sorted((r["at"], r["rank"]) for r in got if r["key"] == key)
        assert [rank for _, rank in mine] == list(range(len(mine)))
        assert {r["size"] for r in got if r["key"] == key} == {len(mine)}
