"""Merkle manifest of a dataset: digests of all rows, a tree of them per source, and proofs that a row belongs to it.

A leaf is the SHA-256 of a row's columns; every ARITY consecutive nodes of a level become one of the next, until one is left;
the roots of all sources, in order, are the leaves of one more tree. The node store is Parquet, partitioned by level.
Leaves are range-partitioned by (source, id) and sorted, which makes runs of leaves in order; a leaf's place in its source follows
from the rows of the partitions before. A record of the store is a run of up to RUN = ARITY ** STRIDE neighbours of one level, named by tree and
number, so a run and the levels above it up to its top have the same coordinate. Each level is made by reading the one below run by run; only the
tops of runs, one row in RUN, move to make the runs of the next stride. A proof is read the other way: runs of a
level are merged with the levels above them by coordinate (sort-merge joins, one record a run) and with the proof of their top. Texts never move: leaf digests are
made where the rows are read. No task holds more than one run, whatever the size of a source.

Defined results: null columns count as such (they differ from empty ones); rows without an id come first in their source and are never tampered with by the query;
rows of one id are ordered by their leaf, so equal rows are neighbours and order in the table doesn't matter; null is a
source of its own, before all others; a source of one row has its leaf as its root, and a single source's root is the root of all;
an empty table has no nodes and gives an empty result; columns beyond those named are not covered and not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_groups, materialize

ARITY, STRIDE = 3, 6
RUN = ARITY**STRIDE
#: The tree over the roots of the sources; those of the sources are named n (null) or v and the source.
TOP = ""
#: Rows about the places of partitions (a tree's name and three numbers) up to which they are broadcast.
MOST_BROADCAST = 10_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value as part of a leaf's input: its bytes in UTF-8, counted, or - for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def levels_of(nodes: list[str], single: bool) -> list[list[str]]:
    """A run and the levels above it: up to the one node left of a tree of a single run, else STRIDE levels."""
    out = [nodes]
    while len(out[-1]) > 1 if single else len(out) <= STRIDE:
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def placed(leaves: DataFrame, order: list[str], label: str) -> DataFrame:
    """leaves (tree and others) with the place of each in its tree by order, and the tree's size; runs of neighbours stay in one partition and no tree is counted in one task."""
    rows = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_seq", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.shiftright("_seq", 33)), label)
    parts = rows.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    whole = Window.partitionBy("tree")  # a row for each partition that holds some of the tree
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.select("tree", "_part", "_n", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size")), label)
    if parts.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(parts), ["tree", "_part"])
    else:
        rows = join_groups(rows, parts, ["tree", "_part"], "_n", rows.count())
    return rows.withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_part", "_shift", "_n")


def runs_of(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (tree, pos, digest, size and others) as runs: tree, run, single (the tree's only one) and nodes, sorted structs of digest and the others."""
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / RUN).alias("run"), (F.col("size") <= RUN).alias("single"))
    return grouped.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("nodes"))  # RUN at most


_LEVELS = pa.schema([("tree", pa.string()), ("run", pa.int64()), ("single", pa.bool_()), ("height", pa.int32()), ("top", pa.bool_()), ("digests", pa.list_(pa.string()))])


def _raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels above each run; the last of them is its top."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            out = []
            for tree, run, single, digests in zip(*(part.column(n).to_pylist() for n in ("tree", "run", "single", "digests")), strict=True):
                made = levels_of(digests, single)
                out += [(tree, run, single, h, h == len(made) - 1, level) for h, level in enumerate(made) if h or len(made) == 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LEVELS, strict=True)], schema=_LEVELS)


@dataclass
class Forest:
    """The node store of some trees: per stride of STRIDE levels its runs and the levels above them; and the root of each tree (tree, digest)."""

    runs: list[DataFrame]
    above: list[DataFrame]
    roots: DataFrame


def raised(leaves: DataFrame, carried: list[str], label: str) -> Forest:
    """The node store over leaves (from placed); carried: columns that stay with a leaf."""
    store_runs, store_above, roots, nodes = [], [], [], leaves
    while True:
        runs = materialize(runs_of(nodes, carried), f"{label}-runs")
        plain = runs.select("tree", "run", "single", F.transform("nodes", lambda n: n["digest"]).alias("digests"))
        above = materialize(plain.mapInArrow(_raised, "tree string, run long, single boolean, height int, top boolean, digests array<string>"), f"{label}-levels", by="height")
        store_runs.append(runs)
        store_above.append(above)
        tops = above.filter("top").select("tree", "run", "single", F.col("digests")[0].alias("digest"))
        roots.append(tops.filter("single").select("tree", "digest"))
        tops = tops.filter("NOT single").select("tree", F.col("run").alias("pos"), "digest")
        if tops.isEmpty():
            return Forest(store_runs, store_above, materialize(reduce(DataFrame.unionByName, roots), f"{label}-roots"))
        carried, nodes = [], tops.join(tops.groupBy("tree").agg(F.count("*").alias("size")), "tree")


PROOF = "array<struct<left string, right string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def siblings(levels: list[list[str]], i: int) -> list[dict[str, str]]:
    """What stands left and right of the path from node i of the first level to the top, level by level."""
    out = []
    for level in levels[:-1]:
        first = i // ARITY * ARITY
        out.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1 : first + ARITY])})
        i //= ARITY
    return out


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proof of each node of each run."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            levels = [row["digests"], *[row[f"above{h}"] for h in range(1, STRIDE + 1) if row[f"above{h}"] is not None]]
            n = len(levels[0])
            arrays = [pa.array([row["tree"]] * n, pa.string()), pa.array([row["run"] * RUN + i for i in range(n)], pa.int64()), pa.array([row["subroot"]] * n, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([siblings(levels, i) + row["upper"] for i in range(n)], _PROOF), batch.column("carried").slice(k, 1).flatten()], ["tree", "pos", "subroot", "proof", "carried"])


def proofs(forest: Forest, roots: DataFrame) -> DataFrame:
    """tree, pos, subroot, proof and carried (a struct with digest) of every leaf.

    roots: tree, subroot and upper, the proof that follows behind the root of the tree. Runs are merged by coordinate with the levels above them and with the proof of their top.
    """
    upper = None
    for k in range(len(forest.runs) - 1, -1, -1):
        runs = forest.runs[k]
        ends = runs.filter("single").select("tree", "run").join(roots, "tree")
        if upper is not None:
            ends = ends.unionByName(upper.select("tree", F.col("pos").alias("run"), "subroot", F.col("proof").alias("upper")))
        rows = runs.select("tree", "run", F.transform("nodes", lambda n: n["digest"]).alias("digests"), F.col("nodes").alias("carried")).join(ends, ["tree", "run"])
        for h in range(1, STRIDE + 1):
            rows = rows.join(forest.above[k].filter(F.col("height") == h).select("tree", "run", F.col("digests").alias(f"above{h}")), ["tree", "run"], "left")
        kind = runs.schema["nodes"].dataType.elementType.simpleString()
        upper = rows.mapInArrow(_proofs, f"tree string, pos long, subroot string, proof {PROOF}, carried {kind}")
        if k:
            upper = materialize(upper.drop("carried"), "proofs")
    return upper


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def merkle_proofs(docs: DataFrame, columns: list[str], source_col: str = "source", id_col: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, the carried values, leaf, subroot (of its source), root (of all) and proof, an array of what stands left and right of its path in each level.

    columns: what a leaf covers, in order. carried: further values of a row, small ones, by name.
    """
    carried = carried or {}
    tree = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(source_col).cast("string")))
    made = {"tree": tree, "id": F.col(id_col), "digest": leaf(*[F.col(c) for c in columns]), "row": F.monotonically_increasing_id()} | {f"c_{k}": v for k, v in carried.items()}
    leaves = materialize(docs.select(*[v.alias(k) for k, v in made.items()]), "leaves")
    extra = ["id", *(f"c_{k}" for k in carried)]
    forest = raised(placed(leaves, ["id", "digest", "row"], "leaves-in-order").drop("row"), extra, "manifest")
    subroots = forest.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    tops = raised(placed(subroots, ["name"], "subroots-in-order"), ["name"], "manifest-top")
    above = proofs(tops, tops.roots.select("tree", F.col("digest").alias("subroot"), F.array().cast(PROOF).alias("upper")))
    roots = materialize(above.select(F.col("carried.name").alias("tree"), F.col("carried.digest").alias("subroot"), F.col("proof").alias("upper"), F.col("subroot").alias("root")), "manifest-roots")
    root = tops.roots.select("digest").first()  # one row, or none of an empty table
    found = proofs(forest, roots.drop("root"))
    return found.select(
        F.col("carried.id").alias("id"),
        *[F.col(f"carried.c_{k}").alias(k) for k in carried],
        F.col("carried.digest").alias("leaf"),
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        "proof",
    )


def tampered(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without line ends where 2 divides the crc32 of the decimal id, else as it is."""
    hit = F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 2 == 0
    return F.when(hit, F.translate(F.col(text_col), "\n", "")).otherwise(F.col(text_col))
