"""Merkle manifest of a dataset: one binary hash tree per group over range-sorted rows, one tree over the groups, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, runs, shuffle_parts

DIGEST = 64  # hex digits


def node_hash(*children: bytes) -> bytes:
    """Lowercase hex SHA-256 of the children's hex digests, one after the other."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def record_digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of a record: each value is `-` if null, else its UTF-8 byte count, `:` and the value as text."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(leaves: int) -> int:
    """Levels above the leaves."""
    return max(leaves - 1, 0).bit_length()


def width(leaves: int, level: int) -> int:
    """Nodes of a tree at a level."""
    return (leaves + (1 << level) - 1) >> level


def build_up(nodes: list[bytes], first: int, leaves: int) -> list[tuple[int, list[bytes]]]:
    """All nodes that the leaves at first, first + 1, ... decide alone, level by level, each with the position of its first one.

    A parent needs both children, or its only one where the level ends.
    """
    out = [(first, nodes)]
    for level in range(height(leaves)):
        at, have = out[-1]
        end = at + len(have)
        a, b = (at + 1) // 2, (end + 1) // 2 if end == width(leaves, level) else end // 2
        if a >= b:
            break
        out.append((a, [node_hash(*have[2 * p - at : 2 * p - at + 2]) for p in range(a, b)]))
    return out


def ragged(levels: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """Level, position and hash of the nodes whose parents are not among `levels`: two a level at most, or the root."""
    for level, (at, have) in enumerate(levels):
        a, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        for i in range(len(have)) if not above else sorted({0, len(have) - 1}):
            if not a <= (at + i) // 2 < a + len(above):
                yield level, at + i, have[i]


def fold_proof(leaf: bytes, proof: bytes, place: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings lead to. place: position and number of leaves, for each tree on the way."""
    at = 0
    for pos, size in place:
        while size > 1:
            if pos ^ 1 < size:
                other, at = proof[at : at + DIGEST], at + DIGEST
                leaf = node_hash(other, leaf) if pos & 1 else node_hash(leaf, other)
            else:
                leaf = node_hash(leaf)
            pos, size = pos >> 1, (size + 1) >> 1
    return leaf


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range partition's number and the row's number inside it."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * size, pa.int32()), pa.array(range(n, n + size), pa.int64())], names=[*batch.schema.names, "part", "idx"])
        n += size


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds the complete aligned subtrees of each piece of a group; only ragged nodes leave the task."""
    for piece in runs(batches, ["part", "grp"]):
        head, nodes = piece.slice(0, 1).to_pylist()[0], [x.encode() for x in piece.column("digest")[1:].to_pylist()]
        found = list(ragged(build_up(nodes, head["a"], head["b"])))
        if found:
            level, pos, hashes = zip(*found, strict=True)
            same = lambda v, t: pa.array([v] * len(found), t)
            yield pa.RecordBatch.from_arrays(
                [same(head["part"], pa.int32()), same(head["c"], pa.int64()), same(head["b"], pa.int64()), pa.array(level, pa.int32()), pa.array(pos, pa.int64()), pa.array([h.decode() for h in hashes], pa.string())],
                names=["part", "tree", "leaves", "level", "pos", "digest"],
            )


def _joined(top: int):
    """Joins the nodes below one node of level `top` (or the root below it): that node, and each one's siblings on the way to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["tree", "above"]):
            rows = block.to_pylist()
            tree, leaves = rows[0]["tree"], rows[0]["leaves"]
            most, known = min(top, height(leaves)), {}
            for r in rows:
                known.setdefault(r["level"], {})[r["pos"]] = r["digest"].encode()
            for level in range(min(known), most):
                here, up = known.get(level, {}), known.setdefault(level + 1, {})
                for p in {p >> 1 for p in here}:
                    up[p] = node_hash(*[here[c] for c in (2 * p, 2 * p + 1) if c < width(leaves, level)])
            ((end, digest),) = known[most].items()
            out = {"tree": [tree], "leaves": [leaves], "level": [most], "pos": [end], "digest": [digest.decode()], "to_level": [None], "to_pos": [None], "path": [None], "root": [most == height(leaves)]}
            for r in rows:
                path = [known[k][(r["pos"] >> (k - r["level"])) ^ 1] for k in range(r["level"], most) if (r["pos"] >> (k - r["level"])) ^ 1 < width(leaves, k)]
                for name, v in zip(out, (tree, leaves, r["level"], r["pos"], None, most, end, b"".join(path).decode(), False), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_JOINED)

    return run


_JOINED = pa.schema([("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string()), ("to_level", pa.int32()), ("to_pos", pa.int64()), ("path", pa.string()), ("root", pa.bool_())])
_JOINED_SQL = "tree bigint, leaves bigint, level int, pos bigint, digest string, to_level int, to_pos bigint, path string, root boolean"


def finish(nodes: DataFrame, step: int = 10) -> tuple[DataFrame, DataFrame]:
    """Completes trees from nodes(tree, leaves, level, pos, digest) that cover all their leaves, each once.

    Gives roots(tree, root), and paths(tree, level, pos, path): the siblings of each given node up to its root. Each round
    shuffles nodes by the coordinate of the node `step` levels up that holds them, so a task's group has 2^step nodes at
    most, whatever the tree's size; there is a round for each `step` levels of the highest tree.
    """
    spark, parts = nodes.sparkSession, shuffle_parts(nodes.sparkSession)
    most = nodes.agg(F.max("leaves")).first()[0] or 0
    names = ["tree", "leaves", "level", "pos", "digest"]
    given, carried, hops = nodes.select(*names), None, []
    roots = given.filter("leaves = 1").select("tree", F.col("digest").alias("root"))
    rest = given.filter("leaves > 1")
    for top in range(step, height(most) + step, step):
        enter = rest.filter((F.col("level") < top) & (F.col("level") >= top - step))
        enter = enter if carried is None else enter.unionByName(carried)
        enter = enter.withColumn("above", F.expr(f"shiftright(pos, {top} - level)"))
        out = materialize(enter.repartition(parts, "tree", "above").sortWithinPartitions("tree", "above").mapInArrow(_joined(top), _JOINED_SQL))
        roots = roots.unionByName(out.filter("root").select("tree", F.col("digest").alias("root")))
        carried = out.filter("digest IS NOT NULL AND NOT root").select(*names)
        hops.append(out.filter("digest IS NULL").select("tree", "level", "pos", "to_level", "to_pos", "path"))
    paths = spark.createDataFrame([], "tree bigint, level int, pos bigint, path string")
    for hop in hops[::-1]:
        above = paths.select("tree", F.col("level").alias("to_level"), F.col("pos").alias("to_pos"), F.col("path").alias("rest"))
        longer = hop.join(above, ["tree", "to_level", "to_pos"], "left").select("tree", "level", "pos", F.concat("path", F.coalesce("rest", F.lit(""))).alias("path"))
        paths = paths.unionByName(longer)
    return roots, paths


@dataclass
class Manifest:
    """root: one row with the digest of the whole dataset, none for an empty one. groups: __group, __number, __leaves and __subroot.

    proofs: for each input row __id, __leaf, __claim, __pos and __leaves in its group, __number of its group and __groups,
    __subroot, __root and __proof: its siblings' digests (64 hex digits each) from the leaf via the subroot to the root.
    """

    root: DataFrame
    groups: DataFrame
    proofs: DataFrame


def manifest(docs: DataFrame, fields: tuple[str, ...], group_col: str, id_col: str, claim: Column | None = None, rows_per_part: int = 100_000) -> Manifest:
    """Merkle trees over all rows of docs: a leaf is record_digest of `fields`, claim the digest of a record as somebody presents it (None: as it is).

    Leaves of a group ascend by id, null first; rows of equal id by leaf, so repeated rows are leaves of their own and
    interchangeable. Two nodes in a row have one parent, a last single one too. Groups ascend by their text's UTF-8 bytes,
    null first, and their subroots are the leaves of the tree that gives the root. Null fields, empty and very long texts
    are hashed as record_digest says. An empty table has no rows, groups or root. No column but those named is read.

    Rows are read once and sorted by range; what follows works on digests. A range partition has about rows_per_part rows
    and may hold a part of a group or many groups; counts by partition and group give the place of each piece in its tree.
    A task builds what its pieces decide alone; the ragged nodes (two a level and piece) are joined by coordinate in
    finish(), and their paths go back to the partitions, which rebuild their nodes for the proofs. Nothing is sent to the
    driver but a count and the largest group's size; each step is a table in the shared folder.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    leaves = docs.select(
        F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), record_digest([F.col(f"`{c}`") for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if claim is None else claim).alias("claim"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = materialize(leaves)
    order = [F.col(c).asc_nulls_first() for c in ("grp", "id", "digest", "tie")]
    parts = max(shuffle_parts(spark), -(-leaves.count() // rows_per_part))
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = materialize(ranged.mapInArrow(_numbered, f"grp string, id {id_type}, digest string, claim string, tie bigint, part int, idx bigint"))

    pieces = rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    groups = pieces.groupBy("grp").agg(F.min("part").alias("begins"), F.sum("n").alias("leaves"))
    groups = groups.withColumn("in_part", F.row_number().over(Window.partitionBy("begins").orderBy(F.col("grp").asc_nulls_first())))
    begun = groups.groupBy("begins").agg(F.count(F.lit(1)).alias("k"))
    begun = begun.select(F.col("begins").alias("begins2"), (F.sum("k").over(Window.orderBy("begins")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("groups"))  # a row for each range partition
    groups = materialize(groups.join(begun, F.col("begins") == F.col("begins2")).select(F.col("grp").alias("g"), "leaves", (F.col("before") + F.col("in_part") - 1).alias("tree"), "groups"))
    placed = pieces.withColumn("first", F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n"))  # a row for each range partition that the group reaches into
    placed = materialize(placed.join(groups, F.col("grp").eqNullSafe(F.col("g"))).select("part", "grp", "first", "leaves", "tree", "groups"))

    none = lambda t: F.lit(None).cast(t)
    head = placed.select("part", "grp", F.lit(0).alias("kind"), F.col("first").alias("a"), F.col("leaves").alias("b"), F.col("tree").alias("c"), none("string").alias("digest"))
    body = rows.select("part", "grp", F.lit(2).alias("kind"), F.col("idx").alias("a"), none("bigint").alias("b"), none("bigint").alias("c"), "digest")
    by_part = lambda df: df.repartition(parts, "part").sortWithinPartitions("part", "grp", "kind", "a")
    edges = materialize(by_part(head.unionByName(body)).mapInArrow(_boundaries, "part int, tree bigint, leaves bigint, level int, pos bigint, digest string"))

    done = F.col("leaves") <= F.expr("shiftleft(1L, level)")  # a root that one piece decided
    upper, paths = finish(edges.filter(~done).drop("part"))
    subroots = materialize(edges.filter(done).select("tree", F.col("digest").alias("root")).unionByName(upper))
    tops = groups.select("tree", "groups").distinct().join(subroots, "tree")
    root, ways = finish(tops.select(F.lit(-1).cast("long").alias("tree"), F.col("groups").alias("leaves"), F.lit(0).alias("level"), F.col("tree").alias("pos"), F.col("root").alias("digest")))
    root = root.select(F.col("tree").alias("top"), F.col("root").alias("all"))
    known = groups.join(subroots, "tree").join(ways.select(F.col("pos").alias("tree"), F.col("path").alias("way")), "tree", "left")
    known = materialize(known.withColumn("top", F.lit(-1).cast("long")).join(F.broadcast(root), "top"))  # the root is one row

    up = edges.filter(~done).join(paths, ["tree", "level", "pos"]).join(placed.select("part", "grp", "tree"), ["part", "tree"])
    up = up.select("part", "grp", F.lit(1).alias("kind"), F.col("level").cast("long").alias("a"), F.col("pos").alias("b"), none("bigint").alias("c"), none("bigint").alias("d"), F.col("path").alias("digest"), none("string").alias("claim"), none("string").alias("way"), none(id_type).alias("id"))
    info = placed.join(known.select("tree", "root", "way", "all"), "tree")
    info = info.select("part", "grp", F.lit(0).alias("kind"), F.col("first").alias("a"), F.col("leaves").alias("b"), F.col("tree").alias("c"), F.col("groups").alias("d"), F.col("root").alias("digest"), F.col("all").alias("claim"), F.coalesce("way", F.lit("")).alias("way"), none(id_type).alias("id"))
    each = rows.select("part", "grp", F.lit(2).alias("kind"), F.col("idx").alias("a"), none("bigint").alias("b"), none("bigint").alias("c"), none("bigint").alias("d"), "digest", "claim", none("string").alias("way"), "id")
    schema = f"__id {id_type}, __leaf string, __claim string, __pos bigint, __leaves bigint, __number bigint, __groups bigint, __subroot string, __root string, __proof string"
    proofs = by_part(info.unionByName(up).unionByName(each)).mapInArrow(_proofs, schema)
    return Manifest(root.select(F.col("all").alias("__root")), known.select(F.col("g").alias("__group"), F.col("tree").alias("__number"), F.col("leaves").alias("__leaves"), F.col("root").alias("__subroot")), proofs)


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its siblings: those of the rebuilt subtree, the ragged node's path, the way from the subroot to the root."""
    for piece in runs(batches, ["part", "grp"]):
        kinds = piece.column("kind").to_pylist()
        start = kinds.index(2)
        head, *above = piece.slice(0, start).to_pylist()
        body = piece.slice(start)
        first, leaves = head["a"], head["b"]
        levels = build_up([x.encode() for x in body.column("digest").to_pylist()], first, leaves)
        paths = {(r["a"], r["b"]): r["digest"] for r in above}
        way, tails = head["way"], {}
        for at in range(0, body.num_rows, 2000):
            some = body.slice(at, 2000)
            proofs = []
            for pos in range(first + at, first + at + some.num_rows):
                siblings, p = [], pos
                for level, (begin, have) in enumerate(levels):
                    above_here = level + 1 < len(levels) and 0 <= (p >> 1) - levels[level + 1][0] < len(levels[level + 1][1])
                    if not above_here:
                        key = (level, p)
                        if key not in tails:
                            tails[key] = (paths.get(key, "") + way).encode()
                        siblings.append(tails[key])
                        break
                    if p ^ 1 < width(leaves, level):
                        siblings.append(have[(p ^ 1) - begin])
                    p >>= 1
                proofs.append(b"".join(siblings).decode())
            n = some.num_rows
            same = lambda v, t, n=n: pa.array([v] * n, t)
            ids, digests, claims = (some.column(c).combine_chunks() for c in ("id", "digest", "claim"))
            yield pa.RecordBatch.from_arrays(
                [ids, digests, claims, pa.array(range(first + at, first + at + n), pa.int64()), same(leaves, pa.int64()), same(head["c"], pa.int64()), same(head["d"], pa.int64()), same(head["digest"], pa.string()), same(head["claim"], pa.string()), pa.array(proofs, pa.string())],
                names=["__id", "__leaf", "__claim", "__pos", "__leaves", "__number", "__groups", "__subroot", "__root", "__proof"],
            )


def folded(proofs: DataFrame) -> DataFrame:
    """proofs of a manifest with __folded, the root that the presented leaf (__claim, else __leaf) and the siblings lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, claim, proof, *place = (batch.column(c).to_pylist() for c in ("__leaf", "__claim", "__proof", "__pos", "__leaves", "__number", "__groups"))
            out = [fold_proof((c or x).encode(), p.encode(), [(a, b), (g, k)]).decode() for x, c, p, a, b, g, k in zip(leaf, claim, proof, *place, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "__folded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return proofs.mapInArrow(run, f"{schema}, __folded string")
