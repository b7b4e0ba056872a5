"""Verdicts, thresholds and cuts against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from voltrace.llm.doc_stats import MONOTONE, fails_base, statistics
from voltrace.llm.gbdt import train
from voltrace.llm.kneser_ney import fit, kn_quality, learning_share
from voltrace.llm.quality_rules import fit_quality, quality_rules
from voltrace.llm.sharding import shard_by_splitters


def walk(forest, row):
    """The score of one row, node by node."""
    total = forest.base
    for root in forest.roots:
        node = int(root)
        while forest.left[node] != node:
            node = int(forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node])
        total += float(forest.value[node])
    return total


def test_forest_by_hand():
    rng = np.random.default_rng(4)
    x = rng.random((400, 5)).round(2)  # with ties
    forest = train(x, (x[:, 0] + x[:, 2] * x[:, 3] > 0.8).astype(float), (1, 0, 0, -1, 0), trees=15)
    assert np.allclose(forest.score(x), [walk(forest, r) for r in x])
    assert len(forest.score(x[:0])) == 0


def texts(rng, n):
    out = []
    for k in range(n):
        bad = k % 3 == 0
        words = [rng.choice(["###", "buy", "!!!", "|"]) if bad and rng.random() < 0.5 else f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 120))]
        out.append((k, " ".join(words), int(not bad)))
    return out


def test_quality_verdicts(spark):
    rows = texts(random.Random(1), 400)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(7, "a second text of this id " * 9), (None, "no id " * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, good, 0) for i, _, good in rows if i % 2], "doc_id long, quality int, toxic int")
    forest, threshold = fit_quality(docs, labels)
    again = fit_quality(docs.repartition(7), labels.repartition(3))
    assert again[1] == threshold and np.array_equal(again[0].value, forest.value)
    got = quality_rules(docs, labels).collect()
    by_text = {(i, t): r for r in got for i, t in [(r["doc_id"], None)]}
    assert len(got) == 402 and by_text
    features = {}
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        counts, x = statistics(t)
        features.setdefault((i, counts[0], counts[1]), []).append((fails_base(counts[0], counts[4]), walk(forest, x)))
    for r in got:
        (failed, score), *_ = features[r["doc_id"], r["n_words"], r["word_chars"]]
        assert r["base_failed"] == failed and math.isclose(r["score"], score, abs_tol=1e-9) and r["kept"] == (not failed and score >= threshold)
    assert 100 < sum(r["kept"] for r in got) < 350
    assert len(MONOTONE) == len(statistics("x")[1])
    few = fit_quality(docs, labels, max_labels=60)
    assert few is None or few[0].depth == forest.depth


def test_perplexity_bounds(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        lang = ("en", "fr", None, "rare")[min(k % 5, 3) if k % 50 == 3 else k % 3]
        rows.append((k, " ".join(rng.choices([f"{lang}{j}" for j in range(60 if lang != "fr" else 300)], k=rng.randint(3, 50))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(360)] + [(k, 0, 0) for k in range(360, 380)] + [(5, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    good = {k for k in range(360)} - {5, 6}
    ids = spark.createDataFrame([(k,) for k in sorted(good)], "id long")
    learned = set(fit(docs, learning_share(ids), "text", "doc_id")[1])
    got = {r["doc_id"]: r for r in kn_quality(docs, labels, quantile=0.9, min_calibration=20).collect()}
    fold = defaultdict(list)
    for i in good - learned:
        for name in (rows[i][2], "all"):
            fold[name].append(got[i]["perplexity"])
    bound = {name: sorted(v)[math.ceil(0.9 * len(v)) - 1] for name, v in fold.items()}
    assert len(fold["rare"]) < 20 < len(fold["all"]) < len(good)
    for i, _, lang in rows:
        own = bound[lang] if len(fold[lang]) >= 20 else bound["all"]
        assert math.isclose(got[i]["limit"], own, rel_tol=1e-9) and got[i]["kept"] == (got[i]["perplexity"] <= own)


def test_shards_are_runs_of_keys(spark):
    """With every key in the sample, cuts are exact quantiles, and shards are runs of keys of nearly the same size."""
    rng = random.Random(6)
    rows = [(k, f"text {k} " * rng.randint(1, 40)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("text")).collect()}
    placed = shard_by_splitters(docs, sample_keys=10**9, ranges_per_shard=64).collect()
    load, low, high = defaultdict(int), {}, {}
    for r in placed:
        k = key[r["doc_id"]]
        load[r["shard"]] += r["size"]
        low[r["shard"]], high[r["shard"]] = min(low.get(r["shard"], k), k), max(high.get(r["shard"], k), k)
    assert all(high[s] < low[s + 1] for s in range(7))
    mean = sum(load.values()) / 8
    assert all(abs(n - mean) < mean / 32 for n in load.values())  # two fine ranges at most
    for s in range(8):
        mine = sorted((r["slot"], key[r["doc_id"]]) for r in placed if r["shard"] == s)
        assert [n for n, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)
