"""SimHash near-duplicates: fingerprints of word shingles, linked at few differing bits, found by Golay-coded segment keys.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes of the text's shingles, repeats included. It is cut
into three segments of 22, 21 and 21 bits. Two fingerprints that differ in up to MOST_BITS = 4 bits have errors (e1, e2, e3) that add up to 4 at most, so

- one segment has none, and of the others one has 2 at most: a key of a segment as it is and a Golay index of another one; or
- all have one or two: a key of three Golay indices.

A segment is decoded to the codewords of the Golay code near it (golay.near), one or six; segments that differ in two
bits at most share one of them. So linked fingerprints share a key, and keys have 33 to 36 bits that decide, which keeps those few that others share by chance.

Only distinct fingerprints are dealt by key, not documents. The members of a key come sorted to a task that streams over them, CHUNK at a time,
and compares each chunk with numpy, all pairs of bit counts; what it returns are not pairs but, for each member, the smallest fingerprint
that links reach in the chunk. Keys with more members than that are split: after a round of components, members outside their largest component are compared with
all others of the key, in blocks, wherever components still differ. Every pair that shares a key is thus compared, or connected already.

Defined results: a null or blank text has fingerprint zero, which links like any other; with fewer words than a shingle has, all of them are one shingle; rows
without an id take the component of their fingerprint, or null if it has no id; repeated rows stay rows; a component is the smallest id that links reach;
an empty table gives an empty result; ids are whole numbers, other kinds are refused; other columns are not carried (join by id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, whole_ids
from .components import connected_components
from .golay import near

SEED, SHINGLE, MOST_BITS = 42, 4, 4
#: Segments: shift and bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a key compared with each other at once.
CHUNK = 512
_AT_ONCE = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -n] + 1])
    total, count = len(words) - n + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, total, _AT_ONCE):  # a long text's hashes are never all held
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + _AT_ONCE].tolist(), ends[k + n - 1 : k + n - 1 + _AT_ONCE].tolist(), strict=False)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of bytes
            count += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * count > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), n) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], ["id", "fp"])

    return run


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which fingerprint each belongs to) of some fingerprints (unsigned)."""
    parts = [(fps >> np.uint64(s)) & np.uint64((1 << b) - 1) for s, b in SEGMENTS]
    index, valid = zip(*(near(p) for p in parts), strict=True)
    index = [i.astype(np.uint64) for i in index]
    n, keys, at = len(fps), [], []
    row = np.arange(n)

    def add(key: np.ndarray, ok: np.ndarray) -> None:
        keys.append(key[ok])
        at.append(np.broadcast_to(row.reshape(-1, *[1] * (key.ndim - 1)), key.shape)[ok])

    for kind, (i, j) in enumerate(permutations(range(3), 2)):  # segment i as it is, segment j decoded
        add((np.uint64(kind) << np.uint64(40)) | (parts[i][:, None] << np.uint64(12)) | index[j], valid[j])
    three = (index[0][:, :, None, None] << np.uint64(24)) | (index[1][:, None, :, None] << np.uint64(12)) | index[2][:, None, None, :]
    add((np.uint64(6) << np.uint64(40)) | three, valid[0][:, :, None, None] & valid[1][:, None, :, None] & valid[2][:, None, None, :])
    return np.concatenate(keys).view(np.int64), np.concatenate(at)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            fps = batch.column("fp").slice(k, 1000).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, at = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at])], ["key", "fp"])


def linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which of a (rows) and b (columns), unsigned, differ in `most` bits at most."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= most


def smallest(close: np.ndarray) -> np.ndarray:
    """The first index that links reach from each, from a symmetric matrix of links."""
    label = np.arange(len(close))
    while True:
        low = np.where(close, label[None, :], len(close)).min(axis=1)  # each is close to itself
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _joined(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): members that links of these fingerprints lead to a smaller one, and the smallest of those."""
    root = fps[smallest(linked(fps, fps, most))]
    moved = root != fps
    return fps[moved], root[moved]


class _Members:
    """Members of keys, compared chunk by chunk as they come, sorted by key and fingerprint."""

    def __init__(self, most: int):
        self.most, self.key, self.rest, self.split = most, None, np.zeros(0, np.uint64), None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.large: list[tuple[int, np.ndarray]] = []

    def take(self, key: int, fps: np.ndarray, all_of_it: bool) -> np.ndarray:
        """Compare whole chunks, and what is left over as well if the key ends here; returns what is left over."""
        while len(fps) > CHUNK or (all_of_it and len(fps)):
            part, fps = fps[:CHUNK], fps[CHUNK:]
            if len(fps) or self.split == key:
                self.split = key
                self.large.append((key, part))
            if len(part) > 1:
                self.pairs.append(_joined(part, self.most))
        return fps

    def close(self) -> None:
        if self.key is not None:
            self.take(self.key, self.rest, True)

    def read(self, keys: np.ndarray, fps: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        if self.key == keys[0]:
            self.rest = np.concatenate([self.rest, fps[: ends[0]]])
        else:
            self.close()
            self.key, self.rest = int(keys[0]), fps[: ends[0]]
        if len(starts) > 1:
            self.close()
            sizes = ends - starts
            inner = np.flatnonzero(sizes[1:-1] == 2) + 1
            x, y = fps[starts[inner]], fps[starts[inner] + 1]
            close = np.bitwise_count(x ^ y) <= self.most
            self.pairs.append((y[close], x[close]))
            for k in (np.flatnonzero(sizes[1:-1] > 2) + 1).tolist():
                self.take(int(keys[starts[k]]), fps[starts[k] : ends[k]], True)
            self.key, self.rest = int(keys[-1]), fps[starts[-1] :]
        self.rest = self.take(self.key, self.rest, False)

    def batch(self) -> pa.RecordBatch:
        """(no key, a, b) for each pair, and (key, a, a) for each member of a key of more than a chunk."""
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (zip(*self.pairs, strict=True) if self.pairs else ((), ())))
        members = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in self.large)])
        key = [None] * len(a) + [k for k, x in self.large for _ in range(len(x))]
        self.pairs, self.large = [], []
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(np.concatenate([x, members]).view(np.int64)) for x in (a, b))], ["key", "a", "b"])


def _compared(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = _Members(most)
        for batch in batches:
            if batch.num_rows:
                members.read(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(t) for c, t in (("key", np.int64), ("fp", np.uint64))))
                yield members.batch()
        members.close()
        yield members.batch()

    return run


def _block_pairs(most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(frame["fp"].to_numpy(np.int64)).view(np.uint64)
        a, b = _joined(fps, most)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def _between_components(large: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Links of split keys that still hold several components: what is outside a key's largest one against all its members, in blocks."""
    rows = large.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("comp"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("members"), F.count("*").alias("comps")).filter("comps > 1")
    rows = rows.join(sizes.select("key", "members", F.col("m.comp").alias("main"), (F.col("members") - F.col("m.n")).alias("lone")), "key")
    n_all, n_lone = (F.ceil(F.col(c) * 2 / CHUNK).cast("int") for c in ("members", "lone"))
    h = F.pmod(F.xxhash64("fp"), F.lit(1 << 30))
    as_all = rows.select("key", "fp", F.pmod(h, n_all).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), n_lone - 1)).alias("i"))
    as_lone = rows.filter("comp <> main").select("key", "fp", F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), F.pmod(h, n_lone).cast("int").alias("i"))
    return as_all.unionByName(as_lone).groupBy("key", "i", "j").applyInPandas(_block_pairs(most), "a long, b long").distinct()


def linked_fingerprints(classes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """classes (distinct fp, the smallest id rep of its rows, their number n) with component_id, the smallest id that links of at most `most` (4 or fewer) differing bits reach."""
    many = classes.count()
    spread = classes.select("fp").repartition(max(classes.sparkSession.sparkContext.defaultParallelism, many // 20_000))  # each becomes up to 252 rows
    keyed = spread.mapInArrow(_keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(keyed.mapInArrow(_compared(most), "key long, a long, b long"), "key-links")
    links = materialize(found.filter("key IS NULL").select("a", "b").distinct(), "links")
    labels = connected_components(links)
    more = materialize(_between_components(found.filter("key IS NOT NULL").select("key", F.col("a").alias("fp")), labels, most), "block-links")
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    named = materialize(classes.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "fingerprint-labels")
    reps = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    return join_groups(named, reps, ["label"], "members", many).select("fp", "n", "component_id")


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = SHINGLE) -> DataFrame:
    """Per row: id_col, fingerprint (16 hex digits) and component_id, the smallest id that links of MOST_BITS differing bits at most reach (itself included)."""
    whole_ids(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprints(n), "id long, fp long"), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "fingerprint-classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_groups(rows, linked_fingerprints(classes), ["fp"], "n", rows.count()).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
