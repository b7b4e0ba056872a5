"""The corpus operators on small tables with odd rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrace.llm import simple8b
from voltrace.llm.exact_dedup import exact_dedup, one_of_each
from voltrace.llm.jaccard_join import jaccard_components, one_of_each_class
from voltrace.llm.kneser_ney import kn_quality
from voltrace.llm.mixing import mix, mix_plan, splitting_tree, word_targets
from voltrace.llm.packing import LENGTHS, pack
from voltrace.llm.pii import find_pii
from voltrace.llm.pii_rules import base_spans, digits_of, luhn
from voltrace.llm.quality_rules import quality_rules
from voltrace.llm.sharding import shard_by_splitters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, _id string"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.9)) % vocabulary}x" for _ in range(n)]


def corpus():
    """Random texts with copies, near copies, shared passages, nulls, blanks, a very long text and repeated rows."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 60))
    texts = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(60)]
    for t in texts[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "  " + texts[1].replace(" ", "\n\t "), texts[1] + " "]
    texts += [passage + " " + " ".join(words(rng, 40)) for _ in range(8)]
    base = words(rng, 300)
    for _ in range(40):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(w))
    texts += [None, None, "", " \n", "one", "one", "two words", "two words", " ".join(words(rng, 20_000)), "x" * 50_000]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "c")[i % 4] if i % 3 else "a", i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id " * 30, "en", "a", 0)]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, True, "clash") for r in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], int(len((r[1] or "").split()) > 25), 0) for r in ROWS if r[0] is not None and r[0] % 2 == 0] + [(None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")


def test_sharding(docs, empty, spark):
    got = shard_by_splitters(docs, ranges_per_shard=16).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = {r[0]: len((r[1] or "").encode()) + 1 for r in ROWS}
    assert all(r["size"] == sizes[r["doc_id"]] for r in got)
    text = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    even = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(4000)] + [(5000 + i, "copy " * 40) for i in range(3000)], "doc_id long, text string")
    rows = shard_by_splitters(even).collect()
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.02 * sum(load.values()) / 8 and set(load) == set(range(8))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, shard_by_splitters(even).collect()))
    groups = spark.createDataFrame([(i, f"text {i % 900}") for i in range(4000)], "doc_id long, text string")
    where = defaultdict(set)
    for r in shard_by_splitters(groups).collect():
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert shard_by_splitters(empty).count() == 0


def test_no_range_is_overfull_by_rows(spark):
    """Many empty texts, and many different short ones, beside a few that hold nearly all bytes."""
    rows = [(i, "") for i in range(10_000)] + [(20_000 + i, f"t{i}") for i in range(10_000)] + [(50_000 + i, f"long {i} " * 5000) for i in range(200)]
    got = shard_by_splitters(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows_per_range=100).collect()
    assert max(Counter(r["range"] for r in got).values()) <= 300
    load, where = Counter(), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    assert max(load.values()) < 1.05 * sum(load.values()) / 8
    assert len(where[0]) == 1  # equal texts that fit a shard stay together
    clash = spark.createDataFrame([(1, "a", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, size long, shard string")
    assert sorted((r["doc_id"], r["size"], r["shard"], r["m_size"]) for r in shard_by_splitters(clash, payload=["size", "shard"], prefix="m_").collect()) == [(1, 7, "x", 2), (2, 8, "y", 1)]


def brute_classes(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, empty, n, percent):
    expected = brute_classes(ROWS, n, percent)
    got = jaccard_components(docs, n, percent).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == expected
    kept = one_of_each_class(docs, n, percent)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i, (_, c) in expected.items() if c == i}
    assert jaccard_components(empty, n, percent).count() == 0


def test_one_row_of_each_class_whatever_the_ids(spark, tmp_path):
    """Rows that share an id but not a text are judged by their texts; rows without an id are duplicates too."""
    rng = random.Random(4)
    a, b, c = (" ".join(words(rng, 80, 5000)) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, c + " x"), (None, None), (4, ""), (5, "two words"), (None, "two words"), (0, b + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, [(1, a), (3, c), (None, None), (4, ""), (5, "two words"), (0, b + " y")]))
    assert sorted(str(tuple(r)) for r in one_of_each_class(docs).collect()) == want
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    assert sorted(str(tuple(r)) for r in one_of_each_class(spark.read.parquet(str(tmp_path / "d"))).collect()) == want


def test_jaccard_random_sets_lose_no_link(spark):
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"g{g}w{k}" for k in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"r{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, len(w) // 20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((1, 90), (2, 80), (3, 70)):
        expected = {i: c for i, (_, c) in brute_classes(rows, n, percent).items()}
        assert {r["doc_id"]: r["component_id"] for r in jaccard_components(df, n, percent).collect()} == expected


def test_a_pair_comes_out_of_one_tile(spark):
    """Sets that share several tiles are paired in one of them, whatever block and side they are dealt to."""
    import pandas as pd

    from voltrace.llm import jaccard_join
    from voltrace.llm.shingles import bitmap

    made, run = [], jaccard_join._tile_pairs(80)
    sets = {i: np.arange(i, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(4)}
    for key in (-7, 3, 11):
        keys = np.array([-7, 3, 11])
        rows = [{"key": key, "id": i, "comp": i, "size": len(s), "bits": bitmap(s), "keys": keys, "outer": i > 0, "other": other} for i, s in sets.items() for other in (False, True) if i or not other]
        made += list(map(tuple, run(pd.DataFrame(rows)).to_numpy().tolist()))
    assert sorted(made) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_pack_by_rule():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 8192)]) for _ in range(rng.randint(0, 200))]
        bins, offsets, sizes = pack(lengths)
        held = defaultdict(list)
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            held[b].append((o, n))
        for b, parts in held.items():
            parts.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
            used = sum(n for _, n in parts)
            assert sizes[b] == min(c for c in LENGTHS if c >= used)
        assert len(held) == len(sizes)
    assert pack([512, 512]) == ([0, 1], [0, 0], [512, 512]) or sum(pack([512, 512])[2]) == 1024


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 40_000):
        for top in (1, 2, 60, 5000, 49408, 1 << 33, 1 << 59):
            x = rng.integers(0, top, n).astype(np.uint64)
            x[rng.random(n) < 0.3] = 0
            w, o = simple8b.encode(x)
            assert (simple8b.decode(w, o, n) == x).all()
            docs, lengths, ids = simple8b.read_image(simple8b.write_image(np.arange(3), np.array([n, 0, 0]), x))
            assert (ids == x).all() and lengths.tolist() == [n, 0, 0] and docs.tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        simple8b.encode(np.array([1 << 60], np.uint64))
    with pytest.raises(ValueError):
        simple8b.read_image(simple8b.write_image(np.arange(1), np.array([1]), np.array([5]))[:-1])


def test_token_files(docs, empty, spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from voltrace.llm.token_output import read_token_files, write_token_files

    odd = [(900, "A<|endoftext|>B. <|ENDOFTEXT|>", "", "", 0), (901, "Σίσυφος ΣΑΣ é éx don't. 12,3! İ ﬁ \x1f x\x1fy", "", "", 0)]
    df = docs.unionByName(spark.createDataFrame([(*r, 7, True, "clash") for r in odd], SCHEMA))
    path = public.path("word_bpe_49k.json")
    write_token_files(df, str(tmp_path / "f"), path, segment_ids=5000)
    got = sorted(map(tuple, read_token_files(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    tok, at, expected = tokenizers.Tokenizer.from_file(path), 0, []
    for i, t, *_ in sorted(ROWS + odd, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    write_token_files(empty, str(tmp_path / "e"), path)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, empty, labels):
    got = {r["doc_id"]: r for r in quality_rules(docs, labels).collect()}
    for i, t, *_ in ROWS:
        s = brute_stats(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == s
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert quality_rules(docs, labels.limit(0)).filter("kept = base_failed").count() == 0
    assert quality_rules(empty, labels).count() == 0


def test_repeated_passages():
    from voltrace.llm.doc_stats import statistics

    rng = random.Random(2)
    for _ in range(60):
        part = words(rng, rng.randint(1, 30), 9)
        text = "\n".join(" ".join(part[: rng.randint(1, len(part))]) for _ in range(rng.randint(1, 6)))
        assert tuple(statistics(text)[0]) == brute_stats(text)


def test_trees_are_monotone_and_flat():
    from voltrace.llm.gbdt import train

    rng = np.random.default_rng(0)
    x = rng.random((1500, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=1500)) < 0.6).astype(float)
    forest = train(x, y, (-1, 0, 0), trees=30)
    assert ((forest.score(x) > 0) == (y > 0.5)).mean() > 0.9
    grid = np.repeat(rng.random((40, 3)), 25, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 25), 40)
    s = forest.score(grid).reshape(40, 25)
    assert (np.diff(s, axis=1) <= 1e-9).all()
    node = int(forest.roots[0])  # one row by hand
    while forest.left[node] != node:
        node = int(forest.left[node] if x[0, forest.feature[node]] <= forest.threshold[node] else forest.right[node])
    assert abs(forest.value[node]) <= 1


def test_exact_dedup(docs, empty):
    for options in ({}, {"min_chunk": 8, "max_chunk": 32}, {"min_chunk": 8, "max_chunk": 32, "digest_bytes": 1}):
        got = exact_dedup(docs, payload=["source"], **options).collect()
        groups = defaultdict(list)
        for i, t, *_ in ROWS:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
        text = {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in ROWS}
        assert len(got) == len(ROWS)
        for r in got:
            n = text[r["doc_id"]]
            assert r["text_sha256"] == hashlib.sha256(n.encode()).hexdigest()
            assert r["group_size"] == len(groups[n]) and r["keep_id"] == sorted(groups[n], key=lambda x: (x[0], x[1], x[2] or 0))[0][2]
        assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup(empty).count() == 0


def test_one_of_each(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    stored = docs.sparkSession.read.parquet(str(tmp_path / "docs"))
    for frame in (docs, stored):
        kept = one_of_each(frame)
        assert kept.columns == docs.columns
        assert Counter(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()) == Counter({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in ROWS})
    assert "_made_place" in one_of_each(stored)._jdf.queryExecution().toString()


def test_kneser_ney(docs, empty, labels):
    rows = kn_quality(docs, labels, min_calibration=5).collect()
    assert len(rows) == len(ROWS) and all(r["perplexity"] > 0 and r["n_tokens"] >= 1 for r in rows)
    assert sum(r["kept"] for r in rows) > 0.8 * len(ROWS)
    assert all(r["kept"] and r["perplexity"] is None for r in kn_quality(docs, labels.limit(0)).collect())
    assert kn_quality(empty, labels).count() == 0


def test_kneser_ney_by_hand(spark):
    """Against a plain interpolated modified Kneser-Ney model."""
    from voltrace.llm.kneser_ney import discounts, fit, word_ids
    from voltrace.llm.shingles import WordHashes

    rng = random.Random(9)
    texts = [" ".join(words(rng, 40, 30)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, ids = fit(df, df.selectExpr("doc_id AS id"), "text", "doc_id")
    assert sorted(ids) == list(range(30))
    three = Counter()
    for t in texts:
        w = ["<", "<", *t.split(), ">"]
        three.update(zip(w, w[1:], w[2:], strict=False))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def tables(counts, k):
        d = discounts([sum(n == j for n in counts.values()) for j in (1, 2, 3, 4)])
        total, back = Counter(), Counter()
        for g, n in counts.items():
            ctx = g[:k]
            total[ctx] += n
            back[ctx] += d[min(n, 3) - 1]
        return lambda g: (max(counts[g] - d[min(max(counts[g], 1), 3) - 1], 0) / total[g[:k]] if total[g[:k]] else 0), lambda c: back[c] / total[c] if total[c] else 1.0

    t1, t2, t3 = tables({(c,): n for c, n in one.items()} and Counter({(c,): n for c, n in one.items()}), 0), tables(two, 1), tables(three, 2)
    text = texts[3] + " unknown w1x w2x"
    w, total = ["<", "<", *text.split(), ">"], 0.0
    for a, b, c in zip(w, w[1:], w[2:], strict=False):
        p1 = t1[0]((c,)) + t1[1](()) / (len(one) + 1)
        p2 = t2[0]((b, c)) + t2[1]((b,)) * p1
        total += math.log10(t3[0]((a, b, c)) + t3[1]((a, b)) * p2)
    assert math.isclose(model.log10(word_ids(text, WordHashes())).sum(), total, rel_tol=1e-4)


def brute_spans(t):
    out = []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, t):
            d = digits_of(m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_pii_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("1234567890123456789..@@+- ()ab%\n") for _ in range(rng.randint(0, 60)))
        assert base_spans(t) == brute_spans(t)
    assert base_spans("a" * 100_000 + "1" * 100_000) == []


def test_pii(docs, empty, spark):
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f'word token = "{secret[:39]}{i % 10}" more x{i}@mail.example.com and {i} things', "en", "a", 0, 7, True, "c") for i in range(1000, 1080)]
    rows.append((2000, f'token = "{secret}" then far away {secret} again, card 4111 1111 1111 1111', "en", "a", 0, 7, True, "c"))
    df = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: r for r in find_pii(df, payload=["lang"]).collect()}
    for i, t, *_ in rows + ROWS:
        base = brute_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(","))
    assert got[2000]["spans"].count("secret:") == 2  # the one without a cue is carried by the repeat
    assert find_pii(empty).count() == 0


def test_targets_and_tree():
    t = word_targets([100, 1000, 10], [3, 1, 2])
    assert math.isclose(sum(t), 1.5 * 1110) and t[0] == 200 and t[2] == 20
    assert word_targets([0, 0], [3, 1]) == [0, 0] and word_targets([], []) == []
    quotas = [17, 0, 5, 300]
    tree = splitting_tree(quotas, 8, 3)
    assert [sum(c) for c in zip(*tree, strict=True)] == quotas and tree == splitting_tree(quotas, 8, 3)
    assert max(map(sum, tree)) - min(map(sum, tree)) <= 1
    mean = np.mean([splitting_tree(quotas, 2, s)[0][0] for s in range(300)])
    assert abs(mean - 8.5) < 0.5


def test_mixing(docs, empty):
    rows = mix_plan(docs, payload=["source"], block_rows=16).collect()
    size = Counter()
    for i, t, lang, source, _ in ROWS:
        size[source] += len((t or "").encode().split())
    order = sorted((s for s in size if s is not None)) + [None]
    target = dict(zip(order, word_targets([size[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))]), strict=True))
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]])
    assert len(rows) == len(ROWS) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mix_plan(docs, payload=["source"], block_rows=16).collect()))
    mixed = mix(docs, block_rows=16)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_place", "mix_words"]
    shards = Counter(r["mix_shard"] for r in mixed.collect())
    assert set(shards) <= set(range(8))
    assert mix(empty).count() == 0 and mix_plan(empty).count() == 0


def test_clashing_columns_pass_through_the_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.filter(F.col("_id") != "clash").count() == 0 and out.count() > 0
