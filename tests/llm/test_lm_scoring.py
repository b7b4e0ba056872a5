"""The context mixer against a slow version that goes bit by bit, and the base against plain counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from voltrace.llm import context_mixing as C
from voltrace.llm.lm_scoring import lm_scores, score_texts, tokens

MASK = (1 << 64) - 1
BITS = (11, 12, 12, 12)
SMALL = {"bits": BITS, "min_head": 3, "share": 2}


def words(rng, n, vocabulary=300):
    return [f"w{int(rng.paretovariate(0.9)) % vocabulary}x" for _ in range(n)]


def mixed(h):
    h = ((h ^ (h >> 31)) * int(C._ODD[3])) & MASK
    return h ^ (h >> 29)


class Slow:
    """One decision after the other, in Python numbers. code: symbol to its bits as a string."""

    def __init__(self, vocabulary):
        self.number = vocabulary.number
        ends = np.append(vocabulary.start, len(vocabulary.bits))
        self.code = ["".join("1" if b else "0" for b in vocabulary.bits[a:z]) for a, z in zip(ends, ends[1:], strict=False)]
        self.counts = [defaultdict(lambda: [0, 0]) for _ in BITS]

    def decisions(self, text):
        """(spelled, bit, slots) of every decision."""
        odd = [int(x) for x in C._ODD]
        escape = len(self.number)
        names, frequent = [], []
        for t, word in enumerate(text):
            i = self.number.get(word, escape)
            one, two = (names[-1] if t else 0), (names[-2] if t > 1 else 0)
            tongue = frequent[-1] + 1 if frequent else 0
            lang = mixed((tongue * odd[1] + 1) & MASK)
            contexts = [0, lang, mixed((one * odd[2] + 2) & MASK), mixed((mixed((one * odd[3] + 3) & MASK) + two * odd[0]) & MASK)]
            yield from self.symbol(i, contexts, False)
            if i == escape:
                prefix = 0
                for at, b in enumerate(word + b" "):
                    upto = lambda k, at=at, word=word: sum(word[at - j] << (8 * (j - 1)) for j in range(1, k + 1) if at >= j)
                    contexts = [
                        mixed((upto(2) * odd[1] + 5) & MASK), mixed((upto(3) * odd[2] + lang) & MASK), mixed((upto(5) * odd[3] + 6) & MASK),
                        mixed((prefix * odd[5] + lang + 7) & MASK),
                    ]
                    yield from self.symbol(escape + 1 + b, contexts, True)
                    prefix = (prefix + (b + 1) * int(C._PLACES[at % len(C._PLACES)])) & MASK
            names.append(mixed(((i + 1) * odd[0]) & MASK) if i < escape else xxhash.xxh64_intdigest(word))
            if i < C.TELLING:
                frequent.append(i)

    def symbol(self, s, contexts, spelled):
        for k, b in enumerate(self.code[s]):
            node = mixed((int("1" + self.code[s][:k], 2) * int(C._ODD[0])) & MASK) >> 32
            slots = [((((mixed(c) >> 32) + node) * int(C._ODD32)) & 0xFFFFFFFF) >> (32 - n) for c, n in zip(contexts, BITS, strict=True)]
            yield spelled, int(b), slots

    def learn(self, text):
        for _, b, slots in self.decisions(text):
            for table, s in zip(self.counts, slots, strict=True):
                table[s][b] += 1

    def log10(self, text, own, start):
        weights, total = start.T.copy(), 0.0
        ones = [[C.PRIOR / (1 + math.exp(-(j - C.LEVELS // 2) * C.WIDTH)) for j in range(C.LEVELS)] for _ in range(2)]
        seen = [[C.PRIOR] * C.LEVELS for _ in range(2)]
        held, turns, step = [], dict(C.turns(10**6)), C.STEP
        for n, (spelled, b, slots) in enumerate([*self.decisions(text), (None, 0, [])]):
            if n in turns or spelled is None:
                for g, err, x in held:
                    if abs(err) > C.HEED:
                        weights[g] += C.RATE * C.STEP / step * err * x
                for _, kind, level, y in [h for h in held_levels] if n else []:
                    ones[kind][level] += y
                    seen[kind][level] += 1
                held, held_levels, step = [], [], turns.get(n)
            if spelled is None:
                return total
            gate, x = int(spelled), []
            for i, (table, s) in enumerate(zip(self.counts, slots, strict=True)):
                c = list(table[s])
                if own and c[b] < 64:
                    c[b] -= 1
                v = [float(C._LEAST[C._LEAST <= k][-1]) for k in c]
                x.append(math.log((v[1] + C.BIAS) / (v[0] + C.BIAS)))
                sure = 1 if min(c) > 0 else 0 if sum(c) == 0 else 2 if sum(c) <= 2 else 3
                gate = gate * 4 + sure if i >= 2 else gate
            x = np.array([*x, C.BIAS_INPUT])
            dot = min(12.0, max(-12.0, float(weights[gate] @ x)))
            p = 1 / (1 + math.exp(-dot))
            level = int(dot / C.WIDTH + C.LEVELS // 2 + 0.5)
            q = min(1 - 1e-6, max(1e-6, 0.5 * (p + ones[int(spelled)][level] / seen[int(spelled)][level])))
            total += math.log10(q if b else 1 - q)
            held.append((gate, b - p, x))
            held_levels.append((n, int(spelled), level, b))


def test_against_bit_by_bit():
    rng = random.Random(4)
    texts = [tokens(" ".join(words(rng, rng.randint(0, 160)))) for _ in range(60)]
    texts += [tokens(" ".join(words(rng, 900)))]  # of longer turns
    texts += [tokens("ünï " * 20 + "z" * 70 + " (a b)"), tokens(None), tokens("")]
    counts = Counter(w for t in texts[:40] for w in t)
    head = {w: n for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= 3 and w != C.END}
    vocabulary = C.Vocabulary.of(list(head), list(head.values()), 40, sum(counts.values()) - 40 - sum(head.values()))
    tables, slow = C.empty_tables(BITS), Slow(vocabulary)
    C.count(C.stream(texts[:40], vocabulary), tables, BITS)
    for t in texts[:40]:
        slow.learn(t)
    for i, table in enumerate(tables):
        assert {s: tuple(table.reshape(-1, 2)[s]) for s in np.flatnonzero(table.reshape(-1, 2).any(axis=1)).tolist()} == {s: tuple(c) for s, c in slow.counts[i].items()}
    own = np.arange(len(texts)) < 40
    start = C.first_weights() + np.linspace(-0.1, 0.1, C.GATES)
    got = score_texts(texts, vocabulary, [C.states(t) for t in tables], own, start, BITS)
    for t, o, value in zip(texts, own, got, strict=True):
        assert math.isclose(slow.log10(t, bool(o), start), value, rel_tol=1e-5), t
    alone = [score_texts([t], vocabulary, [C.states(x) for x in tables], np.array([o]), start, BITS)[0] for t, o in zip(texts, own, strict=True)]
    assert np.allclose(alone, got, rtol=1e-6)  # a text's score does not depend on others


def test_texts_add_up_to_one():
    """All texts of one token: codes are complete, so their probabilities add up to one at most."""
    rng = random.Random(2)
    texts = [tokens(" ".join(rng.choices(["a", "b", "c", "dd"], k=5))) for _ in range(30)]
    vocabulary = C.Vocabulary.of([b"a", b"b", b"c"], [40, 40, 30], 30, 40)
    tables = C.empty_tables(BITS)
    C.count(C.stream(texts, vocabulary), tables, BITS)
    assert math.isclose(sum(0.5 ** vocabulary.length[:5]), 1) and math.isclose(sum(0.5 ** vocabulary.length[5:]), 1)
    every = [[w] for w in (b"a", b"b", b"c", C.END)] + [[bytes([x])] for x in range(256) if x not in b" abc\n"]
    logs = score_texts(every, vocabulary, [C.states(t) for t in tables], np.zeros(len(every), bool), C.first_weights(), BITS)
    assert 0.5 < (10**logs).sum() <= 1 + 1e-4


def test_counts_keep_their_ratio():
    n = np.array([0, 0, 5, 64, 65, 10**6, 10**9, 10**10, 2**40, 3], np.uint64)
    pairs = C._LEAST[np.stack(np.divmod(C.states(n), 256), axis=1)]
    for got, want in zip(pairs, n.reshape(-1, 2).tolist(), strict=True):
        if min(want):
            assert abs(math.log(max(got) / max(min(got), 1)) - math.log(max(want) / min(want))) < 0.2 or max(want) > 10**11


def rows(rng):
    texts = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(80)] + [None, "", " \n", "x" * 5000, "rule-" * 30 + " word"] + ["rule-" * 30 + " again"] * 9
    out = [(i, t, "keep") for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id at all", "keep")]


def test_scores_and_base(spark):
    made = rows(random.Random(3))
    docs = spark.createDataFrame(made, "doc_id long, text string, score string").repartition(3)
    got = lm_scores(docs, payload=["score"], prefix="made_", **SMALL).collect()
    assert len(got) == len(made) and all(r["score"] == "keep" for r in got)
    counts, texts = Counter(), {}
    for i, t, _ in made:
        texts[i] = tokens(t)
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            counts.update(texts[i])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        ts = texts[r["doc_id"]]
        assert r["made_held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2)
        assert (r["made_n_tokens"], r["made_n_known"], r["made_train_tokens"]) == (len(ts), sum(counts[w] > 0 for w in ts), n)
        assert math.isclose(r["made_base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts), rel_tol=1e-9)
        assert r["made_score"] < 0 and r["made_bits_per_byte"] > 0
    again = lm_scores(docs.repartition(5), payload=["score"], prefix="made_", **SMALL).collect()
    assert sorted((str(r["doc_id"]), round(r["made_score"], 3)) for r in got) == sorted((str(r["doc_id"]), round(r["made_score"], 3)) for r in again)
    assert lm_scores(docs.limit(0), **SMALL).count() == 0
    none = lm_scores(docs.filter("doc_id = 4"), **SMALL).first()
    assert zlib.crc32(b"4") % 7 != 2 or none["train_tokens"] == 0


def test_a_copy_is_cheap_and_one_of_a_kind_is_not(spark):
    rng = random.Random(8)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2]
    alone = {i: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**6)}" for _ in range(60)) for i in ids[:40]}
    twice = {i: alone[j] for i, j in zip(ids[40:60], ids[:20], strict=True)}
    docs = spark.createDataFrame([*alone.items(), *twice.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in lm_scores(docs, bits=(16, 18, 18, 18), min_head=3, share=2).collect()}
    assert max(got[i] for i in [*ids[:20], *ids[40:60]]) < 0.7 * min(got[i] for i in ids[20:40])


def test_weights_are_learned_from_every_learning_text(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 60))) for i in range(40)], "doc_id long, text string")
    bounds = {k: v for k, v in SMALL.items() if k != "share"}
    every, given = ({r["doc_id"]: r["score"] for r in lm_scores(docs, **bounds, **more).collect()} for more in ({"share": 1}, {}))
    assert given == every
