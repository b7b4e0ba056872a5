"""What the shards draw, against plain loops over shards, visits and rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.llm.mixing import _hypergeometric, mix, mix_plan, permutation, splitting_tree, word_targets

WEIGHTS = (3.0, 1.0, 2.0)


def brute(rows, shards, block_rows, seed):
    """Shard by shard and visit by visit; rows: (number, mark, order, source, size). Words drawn by row, and by shard."""
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    by = {s: [r for r in rows if r[3] == s] for s in names}
    sizes = [sum(r[4] for r in by[s]) for s in names]
    rng, deals = np.random.default_rng(seed), []
    for s, size, t in zip(names, sizes, word_targets(sizes, [WEIGHTS[i % 3] for i in range(len(names))]), strict=True):
        n = max(1, math.ceil(len(by[s]) / block_rows))
        a, c = permutation(n, rng)
        blocks = defaultdict(list)
        for r in by[s]:
            blocks[(a * (r[1] % n) + c) % n].append(r)
        goal, deal = round(t), []
        while goal > 0:  # visit after visit until the target is reached
            one = []
            block = defaultdict(list)
            for r in sorted(blocks[len(deal) % n], key=lambda r: (r[2], r[1], r[4])):
                block[r[2], r[1], r[4]].append(r[0])
            for (_, _, size_of), copies in block.items():
                if goal <= 0:
                    break
                words = size_of if goal >= size_of * len(copies) else math.floor(goal / len(copies) + 0.5)
                one += [(k, words) for k in copies]
                goal -= size_of * len(copies)
            deal.append(one)
        deals.append(deal)
    tree = splitting_tree([len(d) for d in deals], shards, seed)
    taken, load, at = Counter(), defaultdict(Counter), [0] * len(names)
    for s in range(shards):
        for i, quota in enumerate(tree[s]):
            for visit in deals[i][at[i] : at[i] + quota]:
                for k, words in visit:
                    taken[k] += words
                    load[k][s] += words
            at[i] += quota
    assert at == [len(d) for d in deals]
    return taken, load


@pytest.mark.parametrize(("n", "block_rows"), [(700, 16), (300, 4), (40, 512)])
def test_every_document_against_loops(spark, n, block_rows):
    texts = [" ".join(["w"] * (7 * k % 60)) + f" d{k}" for k in range(n)]
    rows = [(k % (n - 5), t, ("a", "b", None, "c", "a", "a", "a")[k % 7]) for k, t in enumerate(texts)] + [(3, texts[3], "a")] * 40 + [(None, None, "b"), (None, "x y", "b")]
    docs = spark.createDataFrame([(i, t, s, k) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, nth long")
    mark = F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text"))
    seen = docs.select("nth", mark, F.xxhash64(F.lit("order"), mark), "source", F.size(F.split(F.coalesce("text", F.lit("")), " "))).collect()
    size = {k: len((t or "").split()) for k, (_, t, _) in enumerate(rows)}
    taken, load = brute([(k, m, o, s, size[k]) for k, m, o, s, _ in seen], 8, block_rows, 7)
    got = mix_plan(docs, payload=["nth"], block_rows=block_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        shards = Counter()
        for v in r["visits"]:
            shards[v["shard"]] += v["words"]
        assert r["taken"] == taken[r["nth"]] == sum(v["words"] for v in r["visits"]) and +shards == +load[r["nth"]]
    assert len({v["shard"] for r in got for v in r["visits"]}) > (4 if n > 100 else 0)
    again = mix_plan(docs.repartition(7), payload=["nth"], block_rows=block_rows).collect()
    assert {r["nth"]: r["visits"] for r in got} == {r["nth"]: r["visits"] for r in again}
    mixed = Counter(r["nth"] for r in mix(docs, block_rows=block_rows).collect())
    assert mixed == Counter({r["nth"]: len(r["visits"]) for r in got if r["visits"]})


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(5)
    good, bad, take = 3 * 10**9, 10**9, 10**6
    x = [_hypergeometric(rng, good, bad, take) for _ in range(400)]
    sd = math.sqrt(take * 0.75 * 0.25 * (good + bad - take) / (good + bad - 1))
    assert abs(np.mean(x) - take * 0.75) < 4 * sd / 20 and 0.85 < np.std(x) / sd < 1.15
    assert _hypergeometric(rng, 2 * 10**9, 5, 2 * 10**9 + 5) == 2 * 10**9 and _hypergeometric(rng, 10**12, 3, 0) == 0
    assert all(0 <= _hypergeometric(rng, 2 * 10**9, 2 * 10**9, 3) <= 3 for _ in range(50))
    quotas = [4 * 10**9, 10**9, 7]
    tree = splitting_tree(quotas, 4, 1)
    assert [sum(c) for c in zip(*tree, strict=True)] == quotas and max(map(sum, tree)) - min(map(sum, tree)) <= 1


def test_ranks_are_a_permutation():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 512, 997):
        a, c = permutation(n, rng)
        assert sorted((a * b + c) % n for b in range(n)) == list(range(n))
