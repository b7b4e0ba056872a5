"""Personal data in whole texts: exact patterns, and a skip-chain field that adds to them.

The field is trained on every text, whose words are labelled by the patterns and a rule for secrets;
see skip_chain. Each task learns online from its texts, one batch after the other, and each weight is
averaged over all tasks by how often they have seen it. The model has a fixed size.

Defined results: a null or empty text has no spans; an empty table gives an empty
result, and without training words only the patterns count; repeated rows are rows of their own; spans are in the order of
start, kind and end; ids may be of any type; other columns pass untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .pii_rules import base_spans, digest, joined
from .skip_chain import Graph, Learner, Weights, added_spans, graph, infer, weak_labels

COUNTED = ("email", "ip", "card", "phone")
#: Weights are added up as whole numbers of this fraction, so that their sum does not depend on the order.
FINE = 1 << 16


def _arrays(graphs: list[Graph]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    features, edges, starts, at = [], [], [], 0
    for g in graphs:
        starts.append(at)
        features += g.features
        edges += [(a + at, b + at, k) for a, b, k in g.edges]
        at += len(g.spans)
    return np.array(features, np.int64), np.array(edges, np.int64).reshape(-1, 3), [*starts, at]


def _learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    learner = Learner()
    for f in frames:
        graphs, labels = [], []
        for text in f["_text"]:
            g = graph(text, hidden=zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % 2 == 0)
            if g.spans:
                graphs.append(g)
                labels += weak_labels(g, base_spans(text))
        if graphs:
            features, edges, _ = _arrays(graphs)
            learner.learn(features, np.array(labels, np.int64), edges)
    yield pd.DataFrame({"total": [np.rint(learner.sums() * FINE).astype(np.int64).tobytes()]})


def _add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(Weights.SIZE, np.int64)
    for f in frames:
        for data in f["total"]:
            total = total + np.frombuffer(data, np.int64)
    yield pd.DataFrame({"total": [total.tobytes()]})


def fit_pii(docs: DataFrame, text_col: str = "text") -> Weights | None:
    """The field's weights, learned from all texts; None without a suspicious word."""
    rows = docs.select(F.col(text_col).cast("string").alias("_text")).filter(F.col("_text").rlike("[0-9@]"))
    parts = rows.mapInPandas(_learn, "total binary").repartition(4).mapInPandas(_add, "total binary").collect()  # four rows
    total = sum(np.frombuffer(r["total"], np.int64) for r in parts)
    return Weights.of(total / FINE) if total.any() else None


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", payload: list[str] | None = None, prefix: str = "") -> DataFrame:
    """id_col, payload columns, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns, all spans with those that the field adds, n_added, n_spans and private (any span).

    prefix: put before the names of these columns, where payload has columns of the same names.
    """
    small_batches(docs.sparkSession)
    model = fit_pii(docs, text_col)
    payload = [c for c in payload or [] if c != id_col]
    names = [f"_p{k}" for k in range(len(payload))]
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(k) for k, c in zip(names, payload, strict=True)])
    schema = T.StructType([f for f in src.schema.fields if f.name != "_text"])
    for k in COUNTED:
        schema = schema.add(f"n_{k}", T.LongType())
    schema = schema.add("base_sha256", T.StringType()).add("spans", T.StringType()).add("n_added", T.LongType()).add("n_spans", T.LongType()).add("private", T.BooleanType())
    made = schema.names[len(src.columns) - 1 :]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            base = [base_spans(t) for t in f["_text"]]
            everything = list(base)
            if model:
                graphs = [graph(t) for t in f["_text"]]
                features, edges, starts = _arrays(graphs)
                if len(features):
                    labels = infer(model, features, edges)
                    for i, g in enumerate(graphs):
                        if g.spans:
                            everything[i] = base[i] + added_spans(g, labels[starts[i] : starts[i + 1]], base[i])
            out = f.drop(columns="_text")
            for k in COUNTED:
                out[f"n_{k}"] = [sum(s[0] == k for s in spans) for spans in base]
            out["base_sha256"] = [digest(s) for s in base]
            out["spans"] = [joined(s) for s in everything]
            out["n_added"] = [len(s) - len(b) for s, b in zip(everything, base, strict=True)]
            out["n_spans"] = [len(s) for s in everything]
            out["private"] = [bool(s) for s in everything]
            yield out

    found = src.mapInPandas(run, schema)
    return found.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(names, payload, strict=True)], *[F.col(c).alias(prefix + c) for c in made])
