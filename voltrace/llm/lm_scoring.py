"""Scores of whole texts under an online context-mixing model and an add-one unigram base.

Learning texts are those whose crc32(id as text) mod 7 is not 2. Their tokens (lower-cased
words and one end per text) are counted exactly, in full: the base needs the count of every word. The most
frequent words (a fixed number) travel to all tasks, counts of all others, which grow with the corpus,
are joined by shuffles; none of these can be hot, as each is rarer than all that travel (or than min_head).

The model (see context_mixing) counts every decision of every learning text, whatever its words, in hashed
tables: each task adds up tables of its own, which are cut into blocks and summed block by block. Frequent words have a
code of their own, all others are spelled; this decides how a word is written and not whether it counts.
Every text is scored with weights of its own that go on learning while it is read. What they start from is
learned in the same way on every learning text (with share, on one in so many, chosen by a hash).

A learning text is scored as if it had not been learned: each decision is taken off the counts that it meets. So
a text is only cheap if other texts, or other places of itself, are like it. The score does not depend on other texts of
a batch, so reruns agree.

Defined results: a null or empty text is its end token alone; without learning texts the base
scores 0 per token and the model's tables are empty; an empty table gives an empty result; rows
without an id learn as if the id were ''; repeated rows are texts of their own (each meets the others' counts); ids may be of any
type; other columns pass untouched.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches
from .context_mixing import BITS, END, GATES, PREDICTORS, Vocabulary, count, empty_tables, first_weights, score, states, stream

HEAD, MIN_HEAD = 1 << 18, 4
#: One learning text in so many teaches the weights that texts start from.
SHARE = 1
LONGEST = 31
#: Words that a worker counts before it passes them on, and tokens that are worked on at once.
COUNTED, CHUNK = 600_000, 40_000
BLOCK = 1 << 17
#: Weights are added up as whole numbers of this fraction, so that their sum does not depend on the order.
FINE = 1 << 20


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def key(word: bytes) -> bytes:
    """The word, or a digest (marked by bytes that UTF-8 never has) of a long one."""
    return word if len(word) <= LONGEST else b"\xff\xff" + xxhash.xxh3_128_digest(word)


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def rows() -> pd.DataFrame:
        out: Counter = Counter()
        for w, n in seen.items():
            out[key(w)] += n
        return pd.DataFrame({"word": list(out), "n": list(out.values())})

    for f in frames:
        for text in f["_text"]:
            seen.update(tokens(text))
            if len(seen) > COUNTED:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def _chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Texts in runs of about `size` tokens: (first, behind the last, tokens)."""
    first, some, held = 0, [], 0
    for i, text in enumerate(texts):
        some.append(tokens(text))
        held += len(some[-1])
        if held >= size:
            yield first, i + 1, some
            first, some, held = i + 1, [], 0
    if some:
        yield first, len(texts), some


def _packed(part: np.ndarray) -> bytes:
    """Counts by bytes: all lowest ones first, so that the many zeros lie together."""
    narrow = part.astype("<u2") if not len(part) or part.max() < 1 << 16 else part.astype("<u4")
    return np.ascontiguousarray(narrow.view(np.uint8).reshape(-1, narrow.itemsize).T).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    size = len(data) // n
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel()


def _count_decisions(vocabulary, bits: tuple[int, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()
        tables, since = empty_tables(bits), 0

        def blocks() -> Iterator[pd.DataFrame]:
            for i, table in enumerate(tables):
                for b in range(0, len(table), BLOCK):
                    part = table[b : b + BLOCK]
                    if part.any():
                        yield pd.DataFrame({"predictor": [i], "block": [b // BLOCK], "counts": [_packed(part)]})

        for f in frames:
            for _, _, texts in _chunks(f["_text"].tolist(), CHUNK // 8):
                s = stream(texts, vocabulary.value)
                count(s, tables, bits)
                since += len(s.symbol)
                if since > 1 << 31:  # before a count can overflow
                    yield from blocks()
                    tables, since = empty_tables(bits), 0
        gc.enable()
        if since:
            yield from blocks()

    return run


def _sum_blocks(bits: tuple[int, ...]):
    """Sums of blocks as they come, as states; memory is bounded by the blocks of a partition, however many tasks have sent some."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for i, b, data in zip(f["predictor"], f["block"], f["counts"], strict=True):
                n = min(BLOCK, 2 << bits[i])
                if (i, b) not in sums:
                    sums[i, b] = np.zeros(n, np.uint64)
                sums[i, b] += _unpacked(data, n)
        for (i, b), total in sums.items():
            yield pd.DataFrame({"predictor": [i], "block": [b], "states": [states(total).tobytes()]})

    return run


def _learn_weights(vocabulary, tables, bits: tuple[int, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, total, n = first_weights(), np.zeros((PREDICTORS + 1) * GATES, np.int64), 0
        for f in frames:
            for _, _, texts in _chunks(f["_text"].tolist()):
                s = stream(texts, vocabulary.value)
                last = score(s, tables.value, np.ones(len(texts), bool), start, bits)[1]
                size = np.diff(s.begin)
                total += np.rint((last.astype(np.float64) * size[:, None, None]).sum(axis=0).ravel() * FINE).astype(np.int64)
                n += int(size.sum())
        yield pd.DataFrame({"total": [total.tobytes()], "n": [n]})

    return run


def _add_weights(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros((PREDICTORS + 1) * GATES, np.int64), 0
    for f in frames:
        for data, more in zip(f["total"], f["n"], strict=True):
            total, n = total + np.frombuffer(data, np.int64), n + more
    yield pd.DataFrame({"total": [total.tobytes()], "n": [n]})


def score_texts(texts: list[list[bytes]], vocabulary: Vocabulary, tables: list[np.ndarray], own: np.ndarray, start: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """log10 probability of each text."""
    return score(stream(texts, vocabulary), tables, own, start, bits)[0]


def lm_scores(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    payload: list[str] | None = None,
    head: int = HEAD,
    min_head: int = MIN_HEAD,
    bits: tuple[int, ...] = BITS,
    share: int = SHARE,
    prefix: str = "",
) -> DataFrame:
    """id_col, payload, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    prefix: put before the names of these columns, where payload has columns of the same names.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark, 2000)
    payload = [c for c in payload or [] if c != id_col]
    names = [f"_p{k}" for k in range(len(payload))]
    held = F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")), F.lit(7)) == 2
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), held.alias("held_out"), *[F.col(c).alias(k) for k, c in zip(names, payload, strict=True)])
    learn = src.filter(~F.col("held_out"))

    counts = learn.select("_text").mapInPandas(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col("n"))), F.lit(0)).alias("texts")).first()
    n_train, n_types, n_texts = int(total["n"]), int(total["v"]), int(total["texts"])
    top = counts.filter(F.col("n") >= min_head).orderBy(F.desc("n"), "word").limit(head).toArrow().to_pandas()  # head rows at most
    frequent = {bytes(w): int(n) for w, n in zip(top["word"], top["n"], strict=True)}
    coded = {w: n for w, n in frequent.items() if w != END and not w.startswith(b"\xff\xff")}
    vocabulary = Vocabulary.of(list(coded), list(coded.values()), n_texts, n_train - n_texts - sum(coded.values()))
    frequent.setdefault(END, n_texts)
    logs_of = {w: math.log10(n + 1) for w, n in frequent.items()}
    sent_words, sent_logs = sc.broadcast(vocabulary), sc.broadcast(logs_of)

    blocks = learn.select("_text").mapInPandas(_count_decisions(sent_words, bits), "predictor int, block int, counts binary")
    blocks = blocks.repartition("predictor", "block").mapInPandas(_sum_blocks(bits), "predictor int, block int, states binary").toArrow()  # tables of a fixed size
    tables = [np.zeros(1 << b, np.uint16) for b in bits]
    for i, b, data in zip(*(blocks[c].to_pylist() for c in ("predictor", "block", "states")), strict=True):
        part = np.frombuffer(data, np.uint16)
        tables[i][b * (BLOCK // 2) : b * (BLOCK // 2) + len(part)] = part
    sent_tables = sc.broadcast(tables)
    del blocks, tables, top

    chosen = learn.filter(F.pmod(F.xxhash64(F.lit("weights"), "_id", "_text"), F.lit(share)) == 0)
    moved = chosen.select("_text").mapInPandas(_learn_weights(sent_words, sent_tables, bits), "total binary, n long")
    moved = moved.repartition(16).mapInPandas(_add_weights, "total binary, n long").collect()  # 16 rows
    n_moved = sum(r["n"] for r in moved)
    start = (sum(np.frombuffer(r["total"], np.int64) for r in moved).reshape(PREDICTORS + 1, GATES) / (FINE * n_moved)) if n_moved else first_weights()

    schema = T.StructType([f for f in src.schema.fields if f.name != "_text"])
    for c, kind in (("n_tokens", T.LongType()), ("_head", T.LongType()), ("_head_log", T.DoubleType()), ("score", T.DoubleType()), ("_bytes", T.LongType()), ("_rare", T.ArrayType(T.BinaryType())), ("_times", T.ArrayType(T.IntegerType()))):
        schema = schema.add(c, kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # the token lists hold no cycles
        known = sent_logs.value
        for f in frames:
            f = f.iloc[np.argsort(f["_text"].str.len().fillna(0).to_numpy(), kind="stable")]  # texts of one length take the same turns
            for a, b, texts in _chunks(f["_text"].tolist()):
                out = f.iloc[a:b].drop(columns="_text")
                out["n_tokens"] = [len(ts) for ts in texts]
                rare, logs = [], []
                for ts in texts:
                    rest: dict[bytes, int] = {}
                    log = [known.get(w) for w in ts]
                    if None in log:
                        for w in [w for w, x in zip(ts, log, strict=True) if x is None]:
                            k = key(w)
                            if k in known:
                                log.append(known[k])
                            else:
                                rest[k] = rest.get(k, 0) + 1
                        log = [x for x in log if x is not None]
                    rare.append(rest)
                    logs.append((len(log), sum(log)))
                out["_head"], out["_head_log"] = [n for n, _ in logs], [x for _, x in logs]
                out["score"] = score_texts(texts, sent_words.value, sent_tables.value, ~f["held_out"].iloc[a:b].to_numpy(bool), start, bits)
                out["_bytes"] = [len((t or "").encode("utf-8", "surrogatepass")) for t in f["_text"].iloc[a:b]]
                out["_rare"], out["_times"] = [list(r) for r in rare], [list(r.values()) for r in rare]
                yield out
        gc.enable()

    scored = src.mapInPandas(run, schema).withColumn("_row", F.monotonically_increasing_id())
    scored = materialize(scored, "scored")
    rare = scored.select("_row", F.explode(F.arrays_zip(F.col("_rare").alias("word"), F.col("_times").alias("times"))).alias("x")).select("_row", "x.word", "x.times")
    known = rare.join(counts, "word").groupBy("_row").agg(F.sum("times").alias("_tail"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_tail_log"))
    result = scored.drop("_rare", "_times").join(known, "_row", "left")
    per_token = float(np.log10(n_train + n_types + 1.0))
    made = {
        "held_out": F.col("held_out"),
        "n_tokens": F.col("n_tokens"),
        "n_known": F.col("_head") + F.coalesce("_tail", F.lit(0)),
        "train_tokens": F.lit(n_train).cast("long"),
        "base_score": F.col("_head_log") + F.coalesce("_tail_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token),
        "score": F.col("score"),
        "bits_per_byte": -F.col("score") / F.lit(float(np.log10(2.0))) / F.greatest("_bytes", F.lit(1)),
    }
    return result.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for k, c in zip(names, payload, strict=True)], *[c.alias(prefix + k) for k, c in made.items()])
