"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame functions only).

1. Sizes per source give word targets: shares by weight, stopped at a multiple of the
   source's size, the excess shared again by weight until no source is above its stop.
2. Each source is dealt into blocks by a hash, and its blocks are permuted. A target is a quota of
   visits to blocks: whole epochs over all blocks, then the first blocks of the permutation up to the one
   in which the target is reached (found by sums over runs of blocks, then over the blocks of
   one run, then over the rows of one block, so no source is ever summed up in one task).
3. A binary tree over the output shards splits the quota vector exactly: at every node the left
   half's share is drawn from the multivariate hypergeometric distribution. Each shard then
   draws its quota of permuted blocks, disjoint from those of all others, and shuffles their documents by a
   hash. What is taken of a document is the sum over the shards' draws.

Only one row per source (and source x shard) reaches the driver: mixing weights are
stated per source, so sources are few; above max_sources it raises an error rather than going on.
All draws come from hashes of id and text and from a seeded generator, so reruns agree however rows are partitioned.

Defined results: null text has size 0; null sources are a source of their own, last in order; an
empty table gives an empty result; repeated rows are rows of their own, and where a target ends
among rows that are equal in id and text, each of them counts with the same part of its words; a source without
words is not drawn from; ids may be of any type; other columns pass untouched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_ROWS = 512
#: Blocks that are summed up together before one of them is looked into.
RUN_BLOCKS = 4096
#: Rows up to which the ends of all sources are broadcast.
MOST_BROADCAST = 100_000


def word_targets(sizes: list[int], weights: list[float], share: float = 1.5, stop: float = 2.0) -> list[float]:
    """Targets by weight that sum to share * sum(sizes), none above stop times its size."""
    total = share * sum(sizes)
    caps = [stop * s for s in sizes]
    open_, target, left = list(range(len(sizes))), [0.0] * len(sizes), total
    while open_ and left > 0:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= caps[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in full:
            target[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Quotas of every shard: rows by shard, columns by source; columns add up to quotas, row sums differ by one at most."""
    rng = np.random.default_rng(seed)
    out: list[list[int]] = [[] for _ in range(shards)]

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = [int(c) for c in counts]
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        base, more = divmod(total, hi - lo)
        take = base * (mid - lo) + min(more, mid - lo)
        left, rest = np.zeros_like(counts), total
        for i, c in enumerate(counts):  # the multivariate draw, one source after the other
            rest -= int(c)
            left[i] = _hypergeometric(rng, int(c), rest, take)
            take -= int(left[i])
        split(left, lo, mid)
        split(counts - left, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """One exact draw. Beyond what numpy takes, by inversion: the law's ratios are multiplied up around its mode, as far as double precision reaches."""
    lo, hi = max(0, take - bad), min(good, take)
    if lo == hi:
        return lo
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    n = good + bad
    mode = min(hi, max(lo, (good + 1) * (take + 1) // (n + 2)))
    sd = math.sqrt(take * (good / n) * (bad / n) * ((n - take) / (n - 1)))
    k = np.arange(max(lo, mode - int(12 * sd) - 60), min(hi, mode + int(12 * sd) + 60) + 1)
    x = k[:-1].astype(np.float64)
    steps = np.log(good - x) + np.log(take - x) - np.log(x + 1) - np.log(bad - take + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    law = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(int(np.searchsorted(law, rng.random() * law[-1])), len(k) - 1)])


def permutation(blocks: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, c) such that block b has rank (a * b + c) mod blocks, a bijection. The blocks are random sets already."""
    while True:
        a = int(rng.integers(1, max(2, min(blocks, 1 << 31))))
        if math.gcd(a, blocks) == 1:
            return a, int(rng.integers(0, blocks))


def mix_plan(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    stop: float = 2.0,
    shards: int = 8,
    block_rows: int = BLOCK_ROWS,
    seed: int = 7,
    payload: list[str] | None = None,
    max_sources: int = 100_000,
    prefix: str = "",
) -> DataFrame:
    """Per row: id_col, payload, size, source_size, target, taken and visits, an array of (epoch, shard, place, words).

    prefix: put before the names of these columns, where payload has columns of the same names.
    """
    spark = docs.sparkSession
    payload = [c for c in payload or [] if c != id_col]
    carried = {f"_p{k}": F.col(c) for k, c in enumerate(payload)}
    facts = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).isNull().alias("_no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        word_count(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))).alias("_mark"),
        *[c.alias(k) for k, c in carried.items()],
    )
    facts = materialize(facts, "mix-sizes", "zstd")
    stats = facts.groupBy("_no_source", "_source").agg(F.count("*").alias("rows"), F.sum("size").alias("words")).limit(max_sources + 1).collect()
    if len(stats) > max_sources:
        raise ValueError(f"more than {max_sources} sources; mixing weights are stated per source")
    stats.sort(key=lambda r: (r["_no_source"], r["_source"]))  # by code point, null last
    target = word_targets([r["words"] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], share, stop)
    rng = np.random.default_rng(seed)
    plan = []  # no source, source, its number, words, target, whole epochs, words of the last one, blocks, permutation
    for i, (r, t) in enumerate(zip(stats, target, strict=True)):
        blocks = max(1, -(-r["rows"] // block_rows))
        plan.append((r["_no_source"], r["_source"], i, r["words"], float(t), *(divmod(round(t), r["words"]) if r["words"] else (0, 0)), blocks, *permutation(blocks, rng)))
    sources = F.broadcast(spark.createDataFrame(plan, T._parse_datatype_string("_no_source boolean, _source string, _sid int, source_size long, target double, _full long, _rest long, _blocks long, _a long, _c long")))  # one row per source, checked above
    rows = facts.join(sources, ["_no_source", "_source"])
    rows = rows.withColumn("_rank", F.pmod(F.pmod("_mark", "_blocks") * F.col("_a") + F.col("_c"), "_blocks"))

    cuts, parts = _ends(rows)
    quotas = [p[5] * p[7] + (cuts[p[2]][0] + 1 if p[2] in cuts else 0) for p in plan]
    tree = splitting_tree(quotas, shards, seed)
    ends = [(i, np.cumsum([tree[s][i] for s in range(shards)]).tolist(), cuts[i][0] if i in cuts else -1) for i in range(len(plan))]
    runs = F.broadcast(spark.createDataFrame(ends, T._parse_datatype_string("_sid int, _ends array<long>, _cut long")))
    drawn = rows.join(runs, "_sid").join(parts, ["_sid", "_mark", "size"], "left")

    def visit(e: int) -> Column:
        """The draw of the row's block in epoch e, by the shard in whose run its number lies."""
        number = F.lit(e) * F.col("_blocks") + F.col("_rank")
        shard = F.size(F.filter("_ends", lambda x: x <= number)).cast("int")
        last = F.when(F.col("_rank") < F.col("_cut"), F.col("size")).when(F.col("_rank") == F.col("_cut"), F.col("_part"))
        words = F.when(F.col("_full") > e, F.col("size")).when(F.col("_full") == e, last)
        return F.struct(F.lit(e).alias("epoch"), shard.alias("shard"), F.xxhash64(F.lit("place"), F.lit(seed), F.lit(e), F.col("_mark")).alias("place"), words.cast("long").alias("words"))

    drawn = drawn.withColumn("visits", F.filter(F.array(*[visit(e) for e in range(math.ceil(stop))]), lambda v: v["words"].isNotNull() & (v["shard"] < shards)))
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda a, v: a + v["words"])
    return drawn.select(
        F.col("_id").alias(id_col),
        *[F.col(k).alias(c) for k, c in zip(carried, payload, strict=True)],
        *[F.col(c).alias(prefix + c) for c in ("size", "source_size", "target")],
        taken.alias(f"{prefix}taken"),
        F.col("visits").alias(f"{prefix}visits"),
    )


def _ends(rows: DataFrame) -> tuple[dict[int, tuple[int, int]], DataFrame]:
    """Where the last epoch of each source ends: {source: (rank of its last block, words before it)}, and that block's rows with the words that count."""
    blocks = rows.filter("_rest > 0").groupBy("_sid", "_rank", "_rest").agg(F.sum("size").alias("_words"))
    blocks = materialize(blocks.withColumn("_run", F.floor(F.col("_rank") / RUN_BLOCKS).cast("long")), "mix-blocks")

    def reached(sums: DataFrame, by: str, already: Column) -> DataFrame:
        order = Window.partitionBy("_sid").orderBy(by)
        upto = sums.withColumn("_before", already + F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_words"))
        return upto.filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest"))).select("_sid", by, "_before")

    run = reached(blocks.groupBy("_sid", "_run", "_rest").agg(F.sum("_words").alias("_words")), "_run", F.lit(0))
    inside = blocks.join(F.broadcast(run.withColumnRenamed("_before", "_already")), ["_sid", "_run"])  # a row per source
    cuts = {r["_sid"]: (r["_rank"], r["_before"]) for r in reached(inside, "_rank", F.col("_already")).collect()}
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, *c) for i, c in cuts.items()], "_sid int, _rank long, _before long"))
    last = rows.join(table, ["_sid", "_rank"]).groupBy("_sid", "_mark", "size", "_rest", "_before").agg(F.count("*").alias("_copies"))
    order = Window.partitionBy("_sid").orderBy(F.xxhash64(F.lit("order"), "_mark"), "_mark", "size")
    whole = F.col("size") * F.col("_copies")
    left = F.col("_rest") - F.col("_before") - F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + whole
    part = F.when(left >= whole, F.col("size")).otherwise(F.round(left / F.col("_copies")).cast("long"))
    parts = materialize(last.withColumn("_left", left).filter("_left > 0").select("_sid", "_mark", "size", part.alias("_part")), "mix-ends")
    return cuts, F.broadcast(parts) if parts.count() <= MOST_BROADCAST else parts


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: all columns of docs once per visit, with mix_shard, mix_place and mix_words, to be sorted by place inside each shard.

    Rows are whole documents; of the last one or few of a source only mix_words count towards its target.
    """
    cols = docs.columns
    plan = mix_plan(docs, payload=cols, prefix="_made_", **options)
    rows = plan.select(*cols, F.explode("_made_visits").alias("_v"))
    return rows.select(*cols, F.col("_v.shard").alias("mix_shard"), F.col("_v.place").alias("mix_place"), F.col("_v.words").alias("mix_words"))
