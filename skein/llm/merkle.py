"""Merkle manifest of a dataset: a content-addressed DAG and descents through it.

Every row is a leaf. The leaves of a source, in order of doc_id, are hashed
three by three until one node is left, the source's subroot; the subroots, in
order of source, are hashed likewise to the root. The stored manifest maps each
node's digest to the digests of its children. Records are kept in pages: all
nodes of four levels under one digest lie in one row, found by that digest.

A proof starts at the root. The digits of a leaf's rank (base 3, highest first)
select the child at each node; the children not selected are collected as one
path segment a level. Requests below one page travel as one row until that page
is met, so the rows moved are a geometric series, whatever the number of
requests. Segments are reversed in the end, so that a proof reads from the leaf
to the root.

Defined cases: null and empty fields differ (`-` and `0:`); a null source is a
source of its own and the first one; a null doc_id comes first in its source;
rows of equal doc_id are ordered by their leaf digest, and equal rows are equal
leaves with proofs of their own; a lone leaf is its source's subroot and a lone
subroot the root; an empty table gives an empty result; columns other than the
hashed ones are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.ranks import ranked
from skein.session import materialise

#: children of a node
FAN = 3
#: levels of a page
LEVELS = 4
#: nodes below a page
SPAN = FAN**LEVELS

#: hashed columns, in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<place int, others array<binary>>>"
_ARROW_PATH = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))

#: digit and unselected children of each level
Path = list[tuple[int, list[bytes]]]


def digest(children: list[bytes]) -> bytes:
    """H of digests, taken as lower-case hex text."""
    return sha256(b"".join(c.hex().encode() for c in children)).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """H of fields: `-` for null, else byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass(frozen=True)
class Manifest:
    """A stored manifest.

    leaves: tree (source), rank, leaf and the columns carried along
    subroots: tree, digest, round (of its page), rank (among the sources)
    pages, forest: round -> top, levels, records (digest, children) of the sources' trees and the tree above them
    root: digest, None for an empty table
    """

    leaves: DataFrame
    subroots: DataFrame
    pages: list[DataFrame]
    forest: list[DataFrame]
    root: bytes | None


def _pages(nodes: DataFrame) -> DataFrame:
    """One row per page over nodes (tree, rank, digest, size): tree, rank, size of the next level, top, levels, records."""
    record = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))
    schema = pa.schema([
        ("tree", pa.string()), ("rank", pa.int64()), ("size", pa.int64()),
        ("top", pa.binary()), ("levels", pa.int32()), ("records", record),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                level = [n["digest"] for n in sorted(row["nodes"], key=lambda n: n["rank"])]
                only, levels, records = row["size"] <= SPAN, 0, {}
                while levels < LEVELS and not (only and len(level) == 1):
                    groups = [level[i : i + FAN] for i in range(0, len(level), FAN)]
                    level = [digest(g) for g in groups]
                    records |= dict(zip(level, groups, strict=True))
                    levels += 1
                out.append({
                    "tree": row["tree"], "rank": row["page"], "size": -(-row["size"] // SPAN), "top": level[0], "levels": levels,
                    "records": [{"digest": d, "children": c} for d, c in records.items()],
                })
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    page = F.floor(F.col("rank") / SPAN).cast("long")
    grouped = nodes.groupBy("tree", page.alias("page"), "size").agg(F.collect_list(F.struct("rank", "digest")).alias("nodes"))
    return grouped.mapInArrow(
        run, "tree string, rank long, size long, top binary, levels int, records array<struct<digest binary, children array<binary>>>"
    )


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored pages of every round and the top of every tree: tree, digest, round."""
    rounds, tops = [], None
    while True:
        pages = materialise(_pages(nodes), f"merkle-{name}-{len(rounds)}")
        done = pages.filter("size = 1").select("tree", F.col("top").alias("digest"), F.lit(len(rounds)).alias("round"))
        tops = done if tops is None else tops.unionByName(done)
        rounds.append(pages)
        nodes = pages.filter("size > 1").select("tree", "rank", F.col("top").alias("digest"), "size")
        if nodes.isEmpty():
            return rounds, tops


def _store(rounds: list[DataFrame]) -> list[DataFrame]:
    """The content-addressed view of pages: equal digests have equal records."""
    return [p.filter("levels > 0").select("top", "levels", "records").dropDuplicates(["top"]) for p in rounds]


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", key: str = "doc_id", **carried: Column) -> Manifest:
    """The manifest of `docs`; `carried` are further expressions kept beside the leaves."""
    rows = docs.select(
        F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        *[e.alias(n) for n, e in carried.items()],
    )
    leaves = ranked(rows, ["tree"], ["key", "leaf"], "merkle-leaves")
    rounds, tops = _climb(leaves.select("tree", "rank", F.col("leaf").alias("digest"), "size"), "pages")
    subroots = materialise(ranked(tops, [], ["tree"], "merkle-tops"), "merkle-subroots")
    above = subroots.select(F.lit(None).cast("string").alias("tree"), "rank", "digest", "size")
    forest, root = _climb(above, "forest")
    first = root.first()
    return Manifest(leaves.drop("size"), subroots.drop("size"), _store(rounds), _store(forest), first and bytes(first["digest"]))


def _descend(frontier: DataFrame, pages: DataFrame, wanted: DataFrame, schema: str, emit: Callable) -> DataFrame:
    """Follow requests through one page.

    frontier: tree, page, digest, path and top-level `subroot`; wanted: tree, page, requests (array of structs with `rank`).
    emit(row, found) makes the output columns from the found (request, digest, path below) of a row.
    """
    size = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("page") == F.col("_page"))
    met = frontier.join(wanted.select(F.col("tree").alias("_tree"), F.col("page").alias("_page"), "requests"), size).drop("_tree", "_page")
    met = met.join(pages, met["digest"] == pages["top"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                columns = None
                for row in batch.slice(start, 64).to_pylist():
                    records = {r["digest"]: r["children"] for r in row["records"] or ()}
                    found = []
                    for request in row["requests"]:
                        node, path, below = row["digest"], [], request["rank"] - row["page"] * SPAN
                        for level in reversed(range(row["levels"] or 0)):
                            children, place = records[node], below // FAN**level % FAN
                            path.append((place, [c for i, c in enumerate(children) if i != place]))
                            node = children[place]
                        found.append((request, node, path))
                    got = emit(row, found)
                    columns = got if columns is None else [a + b for a, b in zip(columns, got, strict=True)]
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, emit.types)], [n for n, _ in emit.types])

    return met.mapInArrow(run, schema)


def _typed(*types: tuple[str, pa.DataType]):
    def put(fn):
        fn.types = types
        return fn

    return put


def _path(row: dict) -> Path:
    return [(s["place"], s["others"]) for s in row["path"]]


@_typed(("tree", pa.string()), ("rank", pa.int64()), ("digest", pa.binary()), ("subroot", pa.binary()), ("path", _ARROW_PATH))
def _onward(row: dict, found: list) -> list[list]:
    """Rows of the next frontier."""
    above = _path(row)
    return [
        [row["tree"]] * len(found),
        [r["rank"] for r, _, _ in found],
        [d for _, d, _ in found],
        [row["subroot"]] * len(found),
        [[{"place": p, "others": o} for p, o in above + path] for _, _, path in found],
    ]


_ONWARD = f"tree string, rank long, digest binary, subroot binary, path {_PATH}"


def _wanted(ranks: DataFrame, round: int, *carried: str) -> DataFrame:
    """Requests by the page of `round` that holds them; above the leaves, one per node."""
    page = F.floor(F.col("rank") / SPAN ** (round + 1)).cast("long")
    if round:
        ranks = ranks.select("tree", F.floor(F.col("rank") / SPAN**round).cast("long").alias("rank")).distinct()
        page = F.floor(F.col("rank") / SPAN).cast("long")
    return ranks.groupBy("tree", page.alias("page")).agg(F.collect_list(F.struct("rank", *carried)).alias("requests"))


def _paged(frontier: DataFrame) -> DataFrame:
    return frontier.withColumnRenamed("rank", "page")


def descend(manifest: Manifest, requests: DataFrame, carried: list[str], schema: str, emit: Callable) -> DataFrame:
    """Answers to requests (tree, rank and the `carried` columns), each (tree, rank) at most once.

    `emit` gets the last page's row and the found (request, leaf digest, path below) and the row's `path` above.
    """
    spark = requests.sparkSession
    trees = manifest.subroots.join(requests.select(F.col("tree").alias("_tree")).distinct(), F.col("tree").eqNullSafe(F.col("_tree")), "left_semi")
    among = trees.select(F.lit(None).cast("string").alias("tree"), "rank")
    start = f"tree string, page long, digest binary, subroot binary, path {_PATH}"
    frontier = spark.createDataFrame([(None, 0, manifest.root, None, [])] if manifest.root else [], start)
    for n in reversed(range(len(manifest.forest))):
        frontier = _paged(_descend(frontier, manifest.forest[n], _wanted(among, n), _ONWARD, _onward))
    found = frontier.select(F.col("page").alias("_rank"), F.col("digest").alias("_digest"), "path")
    sources = manifest.subroots.join(found, F.col("rank") == F.col("_rank"))
    sources = materialise(
        sources.select("tree", F.lit(0).cast("long").alias("page"), F.col("_digest").alias("digest"), F.col("_digest").alias("subroot"), "path", "round"),
        "merkle-sources",
    )
    frontier = None
    for n in reversed(range(len(manifest.pages))):
        begun = sources.filter(F.col("round") == n).drop("round")
        frontier = begun if frontier is None else frontier.unionByName(begun)
        if n:
            frontier = materialise(_paged(_descend(frontier, manifest.pages[n], _wanted(requests, n), _ONWARD, _onward)), f"merkle-frontier-{n}")
    return _descend(frontier, manifest.pages[0], _wanted(requests, 0, *carried), schema, emit)


@_typed(("tree", pa.string()), ("rank", pa.int64()), ("leaf", pa.binary()), ("path", _ARROW_PATH))
def _proof(row: dict, found: list) -> list[list]:
    above = _path(row)
    return [
        [row["tree"]] * len(found),
        [r["rank"] for r, _, _ in found],
        [d for _, d, _ in found],
        [[{"place": p, "others": o} for p, o in reversed(above + path)] for _, _, path in found],
    ]


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """tree, rank, leaf and path (place and siblings, from the leaf's level to the root's) of requested (tree, rank)."""
    wanted = requests.select("tree", "rank").distinct()
    return descend(manifest, wanted, [], f"tree string, rank long, leaf binary, path {_PATH}", _proof)


def folded(leaf: bytes, path: Path) -> bytes:
    """Root that a leaf and its siblings give, leaf level first."""
    for place, others in path:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def audit(manifest: Manifest, claimed: str = "claimed") -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf.

    `claimed` is a carried digest of the leaves; where it is not null it is folded in place of the leaf.
    """
    root = manifest.root
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[manifest.leaves.schema["key"].dataType.simpleString()]

    @_typed(("key", kind), *[(n, pa.string()) for n in names], ("verified", pa.bool_()))
    def emit(row: dict, found: list) -> list[list]:
        above, out = _path(row), [[] for _ in range(7)]
        for request, leaf, below in found:
            path = [*reversed(above + below)]
            now = folded(request[claimed] or leaf, path)
            proof = digest([c for _, others in path for c in others])
            made = (request["key"], leaf.hex(), row["subroot"].hex(), root.hex(), proof.hex(), now.hex(), now == root)
            for column, value in zip(out, made, strict=True):
                column.append(value)
        return out

    key = manifest.leaves.schema["key"].dataType.simpleString()
    schema = f"key {key}, {', '.join(f'{n} string' for n in names)}, verified boolean"
    return descend(manifest, manifest.leaves, ["key", claimed], schema, emit)


def tampered(fields: tuple[str, ...] = FIELDS) -> Column:
    """Leaf digest of a row whose text lost its line feeds, where the crc32 of its doc_id is even; null elsewhere."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = [F.translate("text", "\n", "") if f == "text" else F.col(f) for f in fields]
    return F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf_digest(changed))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of `docs` and the check of every row of a partly tampered copy against it."""
    checked = audit(build(docs, claimed=tampered()))
    return checked.withColumnRenamed("key", "doc_id")
