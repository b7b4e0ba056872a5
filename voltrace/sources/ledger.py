"""Which days of the ledger may hold some packets: Bloom filters per bucket and day.

The ledger of packet ids has no time limit, but a batch need not read all of it. Beside it there are filters, about BITS bits a packet,
each for the ids that one publish has added to one bucket and day (several if they are many). A batch asks the filters of its buckets first, and opens the days
that they name; whether a packet is there is decided by the ledger's rows. A filter never denies an id that it has been given, so the answer is exact.
Retention forgets the filters of forgotten days and makes one filter of many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, bucket_of

BITS, HASHES, MOST_IDS = 12, 6, 100_000
#: Filters of one bucket and day beyond which retention makes new ones of them.
MANY = 64
SCHEMA = "bucket int, day date, part int, parts int, bits binary"


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """HASHES bits for each 64-bit hash, shape (n, HASHES); size: bits of the filter."""
    h = hashes.astype(np.int64).view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def made_of(hashes: np.ndarray) -> bytes:
    size = max(64, len(hashes) * BITS + 7 & ~7)
    bits = np.zeros(size, np.uint8)
    bits[positions(hashes, size).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether the filter may have been given it."""
    words = np.frombuffer(bits, np.uint8)
    at = positions(hashes, len(words) * 8)
    return ((words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.drop(columns="hs").assign(bits=pd.Series([made_of(np.asarray(hs, np.int64)) for hs in f["hs"]], f.index, dtype=object))


def _hashed(buckets: int, ids: DataFrame, *more) -> DataFrame:
    return ids.select(bucket_of(F.col("packet_id"), buckets).alias("bucket"), F.xxhash64("packet_id", F.lit(1)).alias("h"), *more)


def filters(entries: DataFrame, buckets: int) -> DataFrame:
    """Filters of some ledger rows, of MOST_IDS ids each on average."""
    rows = _hashed(buckets, entries, F.to_date("event_time").alias("day"))
    sizes = rows.groupBy("bucket", "day").agg(F.ceil(F.count("*") / MOST_IDS).cast("int").alias("parts"))  # a row per bucket and day
    rows = rows.join(sizes, ["bucket", "day"]).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    return rows.groupBy("bucket", "day", "part", "parts").agg(F.collect_list("h").alias("hs")).mapInPandas(_made, SCHEMA)


def _asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yes = [may_hold(bits, np.asarray(hs, np.int64)).any() for bits, hs in zip(f["bits"], f["hs"], strict=True)]
        yield f.loc[yes, ["bucket", "day"]]


def days_of(store: Store, ids: DataFrame) -> dict[int, set[date]]:
    """Per bucket, the days of the ledger that may hold some of the ids (a batch of bounded size): as many as there are buckets and days at most."""
    wanted = _hashed(store.buckets, ids).groupBy("bucket").agg(F.collect_list("h").alias("hs"))
    rows = store.read("ledger_filters").join(F.broadcast(wanted), "bucket")
    out: dict[int, set[date]] = {}
    for r in rows.mapInPandas(_asked, "bucket int, day date").distinct().collect():
        out.setdefault(r["bucket"], set()).add(r["day"])
    return out


def known(store: Store, ids: DataFrame) -> DataFrame:
    """Those of the ids (packet_id; a batch of bounded size) that the ledger holds."""
    days = days_of(store, ids)
    every = sorted(set().union(*days.values()))
    rows = store.read("packets", buckets=days, days=every).select("packet_id")
    return rows.join(F.broadcast(ids.select("packet_id")), "packet_id", "left_semi").distinct()


def tidied(store: Store, held: DataFrame, first: date) -> DataFrame:
    """Filters without those of days before the first that is left, and with one for many of the same bucket and day."""
    held = held.filter(F.col("day") >= F.lit(first))
    many = held.groupBy("bucket", "day").agg(F.count("*").alias("n")).filter(F.col("n") > MANY)
    found = many.collect()  # buckets and days
    if not found:
        return held
    rows = store.read("packets", buckets={r["bucket"] for r in found}, days=sorted({r["day"] for r in found}))
    again = filters(rows, store.buckets).join(F.broadcast(many.select("bucket", "day")), ["bucket", "day"], "left_semi")
    return held.join(F.broadcast(many.select("bucket", "day")), ["bucket", "day"], "left_anti").unionByName(again)
