"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from voltrace.llm.merkle import RUN, folded, leaf, merkle_proofs, proof_digest, tampered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, tree string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        a = i - i % 3
        out.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([d for _, d, _ in sorted(((-1 if r[0] is None else r[0]), h("".join(map(field, r[:5]))), 0) for r in by[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        made = sorted(((-1 if r[0] is None else r[0]), h("".join(map(field, r[:5]))), *r[:5]) for r in by[s]) if None not in [x for r in by[s] for x in r[1:5]] else sorted((((-1 if r[0] is None else r[0]), h("".join(map(field, r[:5]))), *r[:5]) for r in by[s]), key=lambda x: x[:2])
        for i, (_, d, *r) in enumerate(made):
            way = path(trees[s], i) + path(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            x = h("".join(map(field, [*r[:4], text])))
            for left, right in way:
                x = h("".join(left) + x + "".join(right))
            out.append((r[0], d, trees[s][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in way)), x, x == top[-1][0]))
    return sorted(map(repr, out))


def query(df):
    changed = leaf(*[tampered() if c == "text" else F.col(c) for c in COLUMNS])
    found = merkle_proofs(df, COLUMNS, carried={"changed": changed})
    found = found.select("id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p"), folded(F.col("changed"), F.col("proof")).alias("f"))
    return sorted(repr(tuple(r)) for r in found.withColumn("v", F.col("f") == F.col("root")).collect())


@pytest.mark.parametrize("kind", ["small", "one", "deep", "wide"])
def test_equals_a_plain_tree(spark, kind):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "a\nb", "é\n", "w " * rng.randint(0, 40)])
    rows = {
        "small": [(rng.choice([None, *range(40)]), rng.choice([None, "a", "b", "é", "", "n"]), rng.choice([None, "en"]), rng.choice([None, 5]), text(), "r", "t") for _ in range(90)],
        "one": [(5, "only", None, 1, "x\ny", "r", "t")],
        "deep": [(i, "hot" if i % 5 else "b", "en", i, text(), "r", "t") for i in range(4 * RUN)],
        "wide": [(i, f"s{i}", "en", i, text(), "r", "t") for i in range(RUN + 40)],
    }[kind]
    rows += rows[:3]
    assert query(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)


def test_empty_and_order(spark):
    assert query(spark.createDataFrame([], SCHEMA)) == []
    rows = [(i % 7, "a", "en", i, "t", "r", "t") for i in range(30)]
    assert query(spark.createDataFrame(rows, SCHEMA)) == query(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)) == plain(rows)
