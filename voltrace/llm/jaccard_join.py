"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

Each text becomes a sorted set of hashed shingles. Equal sets are one class, and only
one set per class goes on. Sets are dealt into tiles by size band and by segment keys
(see shingles.segment_keys): linked sets always share a tile, whatever they have in
common with the rest. Inside a tile, pairs are first bounded by the bit counts of
their bitmaps; only pairs that can still reach the threshold are intersected
exactly as sorted arrays.

What is wanted are classes, so a tile never emits all its pairs. First all sets of a
tile are compared with its first set, then, where it still spans several components, with its
last; what is left is compared in blocks, and only sets of different components are paired, in the first of the tiles that they share.
Every link is thus found or implied by others. Hot tiles are split by skew-aware joins and by blocks.

Defined results: ids are whole numbers, other kinds are refused; a null or empty text has an empty set and links with nothing; equal texts
are one class; rows without an id take the component of their text, or null if there is
none; an id on several texts stands for all of them, so their classes are one (not so in one_of_each_class, which goes by rows); an empty table gives an
empty result; other columns are not carried (join the classes by id), but one_of_each_class keeps whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, release_scratch, scratch_mark, small_batches, whole_ids
from .components import connected_components
from .shingles import WordHashes, bitmap, enough, fold, intersection, overlap_bound, segment_keys, shingle_set

#: Words kept in a worker's table of hashes before it starts anew.
CACHE_WORDS = 300_000
BLOCK = 256
#: Keys of a set by which its open tiles are told apart.
FIRST_KEYS = 64
#: Rows (24 bytes each) up to which a table is broadcast.
MOST_BROADCAST = 100_000


def _features(n: int, percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for frame in frames:
            for part in (frame.iloc[i : i + 1000] for i in range(0, len(frame), 1000)):
                sets = [shingle_set(t, n, cache) for t in part["_text"]]
                yield pd.DataFrame({
                    "_id": part["_id"],
                    "n_shingles": [len(s) for s in sets],
                    "_digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "_bits": [bitmap(s) for s in sets],
                    "_keys": [segment_keys(s, percent).view(np.int64) for s in sets],
                })
                if len(cache) > CACHE_WORDS:
                    cache = WordHashes()

    return run


def _sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for frame in frames:
            for part in (frame.iloc[i : i + 1000] for i in range(0, len(frame), 1000)):
                yield pd.DataFrame({"_id": part["_id"], "_set": [shingle_set(t, n, cache).tobytes() for t in part["_text"]]})
                if len(cache) > CACHE_WORDS:
                    cache = WordHashes()

    return run


def _bounded(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [
                enough(overlap_bound(sa, np.frombuffer(ba, np.uint64), sb, np.frombuffer(bb, np.uint64)), sa, sb, percent)
                for sa, ba, sb, bb in zip(f["size_a"], f["bits_a"], f["size_b"], f["bits_b"], strict=True)
            ]
            yield f.loc[np.asarray(keep, bool), ["a", "b"]]

    return run


def _linked(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for x, y in zip(f["set_a"], f["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(enough(intersection(x, y), len(x), len(y), percent))
            yield f.loc[np.asarray(keep, bool), ["a", "b"]]

    return run


def _tile_pairs(percent: int):
    """Pairs inside one block of a tile, between sets of different components, that their bitmaps don't rule out.

    A pair comes out of the tile with the smallest key that both sets name (FIRST_KEYS of each are looked at, so one
    that shares no key among them may come out again, and none is left out), and there of one block.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bits = [np.frombuffer(b, np.uint64) for b in frame["bits"]]
        n = min(map(len, bits))
        bits = np.stack([fold(b, n) for b in bits])
        ids, comps, sizes = (frame[c].to_numpy(np.int64) for c in ("id", "comp", "size"))
        other, outer = (frame[c].to_numpy(bool) for c in ("other", "outer"))
        key, keys, earlier = frame["key"].iat[0], frame["keys"].tolist(), {}

        def before(i: int) -> frozenset:
            if i not in earlier:
                earlier[i] = frozenset(k for k in keys[i].tolist() if k < key)
            return earlier[i]

        out = []
        for i in np.flatnonzero(other).tolist():
            both = sizes + sizes[i]
            able = ~other & (comps != comps[i]) & ~(outer & (ids < ids[i])) & ((100 + percent) * np.minimum(sizes, sizes[i]) >= percent * both)
            at = np.flatnonzero(able)
            if not len(at):
                continue
            x = bits[i][None, :]
            lone = np.bitwise_count(x & ~bits[at]).sum(axis=1, dtype=np.int64)
            rest = np.bitwise_count(bits[at] & ~x).sum(axis=1, dtype=np.int64)
            most = np.minimum(sizes[i] - lone, sizes[at] - rest)
            at = at[(100 + percent) * most >= percent * both[at]]
            at = at[[before(i).isdisjoint(before(j)) for j in at.tolist()]] if len(at) else at
            out.append(np.stack([np.minimum(ids[i], ids[at]), np.maximum(ids[i], ids[at])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, n_shingles and component_id, the smallest id that links reach (itself included).

    Two texts link when 100 * shared shingles >= percent * all shingles of both; percent above 67.
    """
    small_batches(docs.sparkSession)
    whole_ids(docs, id_col)
    begin = scratch_mark()
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    features = materialize(src.mapInPandas(_features(n, percent), "_id long, n_shingles long, _digest binary, _bits binary, _keys array<long>"), "shingle-features")
    classes = materialize(features.filter("n_shingles > 0").groupBy("_digest").agg(F.min("_id").alias("rep"), F.count("*").alias("_n")), "shingle-classes")
    n_rows = features.count()
    copies = join_groups(features.filter("n_shingles > 0").select("_digest", "_id"), classes.filter("_n > 1"), ["_digest"], "_n", n_rows).filter("_id <> rep").select("_digest", "_id")
    copies = materialize(copies, "copies")
    small = copies.count() <= MOST_BROADCAST  # else joined by a shuffle

    def reps(of: DataFrame) -> DataFrame:
        return of.filter("n_shingles > 0 AND _id IS NOT NULL").join(F.broadcast(copies) if small else copies, ["_digest", "_id"], "left_anti")

    keys = reps(features).select(F.explode("_keys").alias("key"), F.col("_id").alias("id"))
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    tiles = materialize(keys.join(shared, "key"), "tiles")
    slim = materialize(features.drop("_keys"), "shingle-features")
    release_scratch(begin, keep=(classes, copies, tiles, slim))
    features = slim
    meta = reps(features).select(F.col("_id").alias("id"), F.col("n_shingles").alias("size"), F.col("_bits").alias("bits"))

    def verify(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that link; the sets that this needs are deleted again."""
        begin = scratch_mark()
        side = lambda x: meta.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
        pairs = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_bounded(percent), "a long, b long"), "bounded-pairs")
        wanted = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
        sets = materialize(src.join(wanted, "_id", "left_semi").mapInPandas(_sets(n), "_id long, _set binary"), "sets")
        one = lambda x: sets.select(F.col("_id").alias(x), F.col("_set").alias(f"set_{x}"))
        found = materialize(pairs.join(one("a"), "a").join(one("b"), "b").mapInPandas(_linked(percent), "a long, b long").distinct(), "links")
        release_scratch(begin, keep=(found,))
        return found

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = materialize(tiles.filter("id <> first").select(*pair("id", "first")).distinct(), "pairs")
    links = verify(tested)
    labels = connected_components(links)
    for kind in ("last", "blocks"):
        named = tiles.join(labels, "id", "left").withColumn("comp", F.coalesce("label", "id"))
        open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo < hi and members > 2")
        if kind == "last":
            ends = tiles.filter("id = last").select("key", "last").join(labels.withColumnRenamed("id", "last"), "last", "left").select("key", F.coalesce("label", "last").alias("last_comp")).distinct()
            open_rows = named.join(open_keys.select("key"), "key", "left_semi").join(ends, "key").filter("comp <> last_comp")
            pairs = open_rows.select(*pair("id", "last")).distinct()
        else:
            pairs = _blocks(named.join(open_keys.select("key", "members"), "key"), meta, percent)
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        found = verify(pairs)
        tested = materialize(tested.union(pairs), "pairs-tested")
        if not found.isEmpty():
            links = materialize(links.union(found), "links")
            labels = connected_components(links)

    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("_digest", "_n", F.coalesce("label", "rep").alias("component_id"))
    rows = features.select("_id", "n_shingles", "_digest")
    full = join_groups(rows.filter("n_shingles > 0"), named, ["_digest"], "_n", n_rows)
    empty = rows.filter("n_shingles = 0").withColumn("component_id", F.col("_id"))
    return full.select("_id", "n_shingles", "component_id").unionByName(empty.select("_id", "n_shingles", "component_id")).withColumnRenamed("_id", id_col)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a lasting number for each row: of its file and its place in it, so that no texts are written. Rows that are not read from files are written once."""
    place = ["_made_file", "_made_place"]
    try:
        rows = docs.select("*", *[F.col(c).alias(k) for k, c in zip(place, ("_metadata.file_path", "_metadata.row_index"), strict=True)])
    except AnalysisException:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-rows")
    files = sorted(r[0] for r in rows.select("_made_file").distinct().collect())  # as many as the driver has listed for the scan
    table = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"_made_file string, {name} long")
    return rows.join(F.broadcast(table), "_made_file").withColumn(name, F.col(name) + F.col("_made_place")).select(*docs.columns, name)


def one_of_each_class(docs: DataFrame, n: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of docs of each class: that of the smallest id, then the first. Rows are told apart whatever their ids: rows that share an id are classed by their own texts, and rows without an id take part."""
    begin = scratch_mark()
    rows = numbered(docs, "_made_row")
    classes = materialize(jaccard_components(rows, n, percent, text_col, "_made_row"), "row-classes")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_made_row").alias("row"))).alias("first")
    stays = classes.join(rows.select("_made_row", F.col(id_col)), "_made_row").groupBy("component_id").agg(first).select(F.col("first.row").alias("_made_row"))
    gone = materialize(classes.select("_made_row").join(stays, "_made_row", "left_anti"), "near-duplicates")
    release_scratch(begin, keep=(gone, rows) if hasattr(rows, "scratch_table") else (gone,))
    return rows.join(gone, "_made_row", "left_anti").select(*docs.columns)


def _blocks(rows: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of tiles that still span several components: sets outside a tile's largest component against all its sets, in blocks."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all")).select("key", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.n")).alias("n_other"))
    first_keys = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS).alias("keys"))
    rows = rows.join(largest, "key").join(meta.join(first_keys, "id"), "id")
    rows = rows.withColumn("outer", F.col("comp") != F.col("main"))
    n_all, n_lone = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil(F.col("n_other") / BLOCK).cast("int")
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    cols = ["key", "id", "comp", "size", "bits", "keys", "outer"]
    as_all = rows.select(*cols, F.lit(False).alias("other"), F.pmod(h, n_all).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), n_lone - 1)).alias("i"))
    as_lone = rows.filter("outer").select(*cols, F.lit(True).alias("other"), F.pmod(h, n_lone).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"))
    return as_all.unionByName(as_lone).groupBy("key", "i", "j").applyInPandas(_tile_pairs(percent), "a long, b long").distinct()
