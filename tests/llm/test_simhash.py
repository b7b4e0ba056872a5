"""Fingerprints and their components against plain counting and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from voltrace.llm import golay
from voltrace.llm.simhash import CHUNK, MOST_BITS, fingerprint, keys_of, linked_fingerprints, simhash_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids):
    """Smallest id by component, by comparing all pairs."""
    a = np.array(fps, np.uint64)
    label = list(range(len(a)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= MOST_BITS).tolist():
            label[find(i + 1 + j)] = find(i)
    out = {}
    for i, x in enumerate(ids):
        r = find(i)
        out[r] = min((y for y in (out.get(r), x) if y is not None), default=None)
    return [out[find(i)] for i in range(len(a))]


def test_words_two_bits_apart_share_a_codeword():
    rng = random.Random(1)
    x = [rng.getrandbits(23) for _ in range(4000)]
    y = [v ^ sum(1 << b for b in rng.sample(range(23), rng.randint(0, 2))) for v in x]
    (a, va), (b, vb) = (golay.near(np.array(v, np.uint64)) for v in (x, y))
    assert all(set(p[u].tolist()) & set(q[w].tolist()) for p, u, q, w in zip(a, va, b, vb, strict=True))
    assert set(va.sum(axis=1).tolist()) == {1, 6}
    words = [(int(i) << golay.CHECK) for i in a[:, 0]]
    assert all(bin(v ^ w ^ golay.remainder(w)).count("1") <= golay.REACH for v, w in zip(x, words, strict=True))


def test_linked_fingerprints_share_a_key():
    rng = random.Random(2)
    x = [rng.getrandbits(64) for _ in range(1500)]
    y = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, MOST_BITS))) for v in x]
    both = []
    for v in (x, y):
        keys, at = keys_of(np.array(v, np.uint64))
        both.append([set(k.tolist()) for k in np.split(keys[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at, minlength=len(v)))[:-1])])
    assert all(p & q for p, q in zip(*both, strict=True))


def test_fingerprints():
    rng = random.Random(3)
    for n in [0, 1, 3, 4, 5, 900] + [rng.randint(0, 60) for _ in range(60)]:
        text = "".join(rng.choice(["aB", " ", "\t", "éÉ", "\n", "İ", " ", ".", "W"]) for _ in range(n))
        assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


SCHEMA = "doc_id long, text string, fp long, component_id string, n long"


def test_components(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "One", "one two three", "x" * 50_000, " ".join(rng.choices(words, k=30_000))]
    for _ in range(30):
        base = rng.choices(words, k=rng.randint(5, 250))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            w = list(base)
            w[rng.randrange(len(w))] = "changed"
            texts.append(rng.choice([" ", "\n "]).join(w))
    rows = [(i * 3 + 1, t, 0, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, texts[9], 0, "", 1), (None, "alone and without an id " * 3, 0, "", 1)]
    got = simhash_components(spark.createDataFrame(rows, SCHEMA).repartition(4))
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components(fps, [r[0] for r in rows]), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})
    assert simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(TypeError):
        simhash_components(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_keys_of_many_members(spark):
    """Families that share one key and fill several chunks: some hang together, some are apart, some by a chain alone."""
    rng = random.Random(6)
    fps = {0}
    for centre in (0, (1 << 50) | 0x3FF0_0000_0000 << 2):  # both share their low segments
        family = [centre]
        for _ in range(CHUNK * 2):
            family.append(rng.choice(family[-40:]) ^ sum(1 << b for b in rng.sample(range(43, 64), rng.randint(1, 3))))
        fps |= set(family)
    fps |= {rng.getrandbits(64) for _ in range(200)} | {(x << 43) | 5 for x in range(0, 1 << 21, 4097)}
    fps = sorted(fps)
    ids = [rng.randrange(10**6) for _ in fps]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f, i, 1) for f, i in zip(signed, ids, strict=True)], "fp long, rep long, n long")
    got = {r["fp"]: r["component_id"] for r in linked_fingerprints(classes).collect()}
    assert got == dict(zip(signed, plain_components(fps, ids), strict=True))
