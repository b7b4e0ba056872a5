"""Sharding by sampled splitters.

The key is a hash of the text, so equal texts are neighbours in key order. A
size-weighted sample of keys gives the quantile boundaries of many fine ranges, exact
weights of all fine ranges are counted, and shards are runs of fine ranges whose
weights add up to the same number of bytes. A range that is overfull, by bytes or by rows (one key, that
is copies of one text, fills it), is subdivided: such heavy keys are placed first, whole while
they fit the shard with most room, else cut by document id over several shards.

To the driver come the sample (sample_keys expected), one row per fine range, and the heavy
keys; the latter hold 1/heavy_share of all bytes or the rows of a range each, so there are fewer than heavy_share and ranges together.
Slots are counted inside fine ranges and offset by the ranges before, so no task holds a shard.

Defined results: a null text weighs 1 byte and has the checksum of the empty text; an empty table gives an empty
result; repeated rows get slots of their own; rows of one range are in the order of text hash, id and place in the table; ids may be of any type; extra columns named in payload pass untouched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty


def shard_by_splitters(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    shards: int = 8,
    ranges_per_shard: int = 128,
    rows_per_range: int = 100_000,
    sample_keys: int = 50_000,
    heavy_share: int = 1024,
    payload: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Return id_col, the payload columns, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) and range, the number of the fine range.

    prefix: put before the names of these columns, where payload has columns of the same names.
    """
    spark = docs.sparkSession
    payload = [c for c in payload or [] if c != id_col]
    carried = {f"_p{k}": F.col(c) for k, c in enumerate(payload)}
    text = text_or_empty(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.monotonically_increasing_id().alias("_row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
            *[c.alias(k) for k, c in carried.items()],
        ),
        "shard-keys",
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    n_bytes, n_rows = int(total["bytes"]), int(total["rows"])

    # copies of one text that weigh as much as a good part of a shard, or are more rows than a range should have
    keys = rows.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter("n > 1")
    heavy = keys.filter((F.col("bytes") * heavy_share >= n_bytes) | (F.col("n") > rows_per_range)).collect()
    heavy_keys = {r["_key"]: (int(r["bytes"]), int(r["n"])) for r in heavy}

    # size-weighted sample: a row is drawn by its share of all bytes, and for half of the sample by its share of all rows, so that
    # a range is overfull neither by bytes nor by many short texts; a hash of its id decides
    draw = F.pmod(F.xxhash64(F.lit("sample"), "_id", "_row", "_key"), F.lit(1 << 40)) / float(1 << 40)
    chance = (F.col("size") / float(max(1, n_bytes)) + F.lit(1.0 / max(1, n_rows))) * (sample_keys / 2.0)
    sample = sorted(r["_key"] for r in rows.filter(draw < chance).select("_key").collect())
    n_ranges = max(shards * ranges_per_shard, -(-n_rows // rows_per_range))
    cuts = sorted({sample[i * len(sample) // n_ranges] for i in range(1, n_ranges)}) if sample else []

    # a heavy key is a range of its own, cut by id into pieces of about one fine range
    fine_bytes = max(1, n_bytes // n_ranges)
    heavy_list = sorted(heavy_keys)
    pieces = [max(1, -(-heavy_keys[k][0] // fine_bytes), -(-heavy_keys[k][1] // rows_per_range)) for k in heavy_list]
    first_piece = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)[:-1] if heavy_list else np.zeros(0, np.int64)
    n_light = len(cuts) + 1
    cut_arr, heavy_arr, piece_arr = np.asarray(cuts, np.int64), np.asarray(heavy_list, np.int64), np.asarray(pieces, np.int64)

    @F.pandas_udf("long")
    def fine_range(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, part in batches:
            key, part = key.to_numpy(np.int64), part.to_numpy(np.int64)
            out = np.searchsorted(cut_arr, key, side="right").astype(np.int64)
            if len(heavy_arr):
                at = np.minimum(np.searchsorted(heavy_arr, key), len(heavy_arr) - 1)
                hit = heavy_arr[at] == key
                out[hit] = n_light + first_piece[at[hit]] + part[hit] % piece_arr[at[hit]]
            yield pd.Series(out)

    rows = materialize(rows.withColumn("_range", fine_range("_key", F.pmod(F.xxhash64("_id", "_row"), F.lit(1 << 40)))), "shard-ranges")
    weight = {r["_range"]: (int(r["b"]), int(r["n"])) for r in rows.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    shard_of = plan_shards(weight, n_light, first_piece.tolist(), pieces, shards)
    offset, filled = {}, [0] * shards
    for r in sorted(weight):
        offset[r] = filled[shard_of[r]]
        filled[shard_of[r]] += weight[r][1]
    table = F.broadcast(spark.createDataFrame([(r, shard_of[r], offset[r]) for r in sorted(weight)], "_range long, shard int, _offset long"))
    slot = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "_id", "_row"))
    made = {
        "size": F.col("size"),
        "text_crc32": F.col("text_crc32"),
        "law": F.lit("bytes"),
        "shard": F.col("shard"),
        "slot": F.col("_offset") + F.col("_nth") - 1,
        "grown_shard": F.lit(None).cast("int"),
        "range": F.col("_range"),
    }
    placed = rows.withColumn("_nth", slot).join(table, "_range")
    return placed.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(carried, payload, strict=True)], *[c.alias(prefix + k) for k, c in made.items()])


def plan_shards(weight: dict[int, tuple[int, int]], n_light: int, first_piece: list[int], pieces: list[int], shards: int) -> dict[int, int]:
    """The shard of every fine range: heavy keys first, whole if a shard has room (give or take a hundredth of a shard); then runs of light ranges fill what is left."""
    total = sum(b for b, _ in weight.values())
    quota = total / shards
    room = [quota] * shards
    out: dict[int, int] = {}
    keys = sorted(((sum(weight.get(n_light + f + j, (0, 0))[0] for j in range(p)), f, p) for f, p in zip(first_piece, pieces, strict=True)), reverse=True)
    for size, first, n in keys:
        best = max(range(shards), key=lambda s: (room[s], -s))
        whole = size <= room[best] + quota / 100
        for j in range(n):
            r = n_light + first + j
            if r in weight:
                s = best if whole else max(range(shards), key=lambda s: (room[s], -s))
                out[r] = s
                room[s] -= weight[r][0]
    room = [max(0.0, x) for x in room]
    light = [(r, weight[r][0]) for r in sorted(weight) if r < n_light]
    have, want = sum(b for _, b in light), sum(room) or 1.0
    ends = np.cumsum([x * have / want for x in room]).tolist()
    at = 0
    for r, b in light:  # a range goes where its middle lies
        out[r] = min(bisect_right(ends, at + b / 2), shards - 1)
        at += b
    return out
