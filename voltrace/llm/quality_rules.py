"""Quality rules: gradient-boosted trees over document statistics.

The base rule (too few words, too many repeated ones) is exact. On top of it stands a
boosted model of the labels' `quality`, trained on at most max_labels labelled rows
(first in the order of hashes of doc_id and text, so reruns agree) and flattened into node arrays that
score a batch of documents at a time. Scores never rise with the share of symbols,
repeated lines, repeated words, exclamation marks, bars or the most frequent word.
The threshold keeps at least keep_good of the good rows of the sample.

Defined results: a null or empty text has no words and fails the base rule; without at
least min_labels rows of both classes there is no model and the base rule decides alone; labels without an
id or a value are ignored; an empty table gives an empty result; other columns pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .doc_stats import COUNTS, FEATURES, MONOTONE, fails_base, statistics
from .gbdt import Forest, train

MAX_LABELS = 10_000
MIN_LABELS = 20
KEEP_GOOD = 0.998


def _sample_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        stats = [statistics(t) for t in f["_text"]]
        yield pd.DataFrame({"turn": f["_turn"], "place": f["_place"], "good": f["_good"], "failed": [fails_base(c[0], c[4]) for c, _ in stats], "x": [v for _, v in stats]})


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_labels: int = MAX_LABELS, min_labels: int = MIN_LABELS, keep_good: float = KEEP_GOOD) -> tuple[Forest, float] | None:
    """The model and its threshold, from at most max_labels rows; None if there are too few labels."""
    good = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_good")).dropna()
    good = good.groupBy("_id").agg(F.min("_good").alias("_good")).orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(good), "_id")
    rows = rows.select(F.xxhash64("_id").alias("_turn"), F.xxhash64("_text").alias("_place"), "_good", "_text")
    seen = rows.mapInPandas(_sample_features, "turn long, place long, good int, failed boolean, x array<double>")
    got = seen.orderBy("turn", "place", "good", "x").limit(max_labels).toArrow().to_pandas()  # rows with one id may be many
    got = got[~got["failed"].astype(bool)] if len(got) else got
    if not len(got):
        return None
    x, y = np.array(got["x"].tolist(), np.float64), (got["good"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((y, *x.T))  # rows arrive in any order
    x, y = x[order], y[order]
    if min(y.sum(), len(y) - y.sum()) < min_labels:
        return None
    forest = train(x, y, MONOTONE)
    scores = forest.score(x[y > 0])
    return forest, float(min(0.0, np.quantile(scores, 1 - keep_good, method="lower")))


def quality_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", payload: list[str] | None = None, prefix: str = "", **fit) -> DataFrame:
    """id_col, the payload columns, the base counts, base_failed, score (log-odds, null without a model) and kept.

    prefix: put before the names of these columns, where payload has columns of the same names.
    """
    small_batches(docs.sparkSession)
    model = fit_quality(docs, labels, text_col, id_col, **fit)
    payload = [c for c in payload or [] if c != id_col]
    names = [f"_p{k}" for k in range(len(payload))]
    text = names[payload.index(text_col)] if text_col in payload else "_text"  # the text travels once
    src = docs.select(F.col(id_col).alias("_id"), *([] if text_col in payload else [F.col(text_col).alias("_text")]), *[F.col(c).alias(k) for k, c in zip(names, payload, strict=True)])
    schema = T.StructType([f for f in src.schema.fields if f.name != "_text"])
    for c in COUNTS:
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_failed", T.BooleanType()).add("score", T.DoubleType()).add("kept", T.BooleanType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            stats = [statistics(t) for t in f[text]]
            out = f.drop(columns="_text", errors="ignore")
            counts = np.array([c for c, _ in stats], np.int64).reshape(-1, len(COUNTS))
            for k, c in enumerate(COUNTS):
                out[c] = counts[:, k]
            failed = np.array([fails_base(c[0], c[4]) for c, _ in stats], bool)
            out["base_failed"] = failed
            if model:
                score = model[0].score(np.array([v for _, v in stats], np.float64).reshape(-1, len(FEATURES)))
                out["score"], out["kept"] = score, ~failed & (score >= model[1])
            else:
                out["score"], out["kept"] = np.nan, ~failed
            yield out

    result = src.mapInPandas(run, schema)
    return result.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(names, payload, strict=True)], *[F.col(c).alias(prefix + c) for c in (*COUNTS, "base_failed")], F.nanvl("score", F.lit(None)).alias(f"{prefix}score"), F.col("kept").alias(f"{prefix}kept"))
