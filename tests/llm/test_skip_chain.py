"""Edges of the skip-chain field."""

import numpy as np

from voltrace.llm.skip_chain import ALIKE, BUCKETS, CHAIN, LABELS, N_LABELS, SAME, Weights, _bucket, graph, infer

SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_repeats_with_plain_words_between_are_joined():
    assert graph(f'token = "{SECRET}" then far away {SECRET} again').edges == [(0, 1, SAME)]
    assert graph(f"{SECRET[:-1]}3 then far away {SECRET} again").edges == [(0, 1, ALIKE)]
    assert graph(f"{SECRET} {SECRET} again").edges == [(0, 1, CHAIN)]
    assert graph(f"{SECRET} and 7 or {SECRET}").edges == [(0, 2, SAME)]


def test_one_cue_decides_all_repeats():
    unary, pair = np.zeros((BUCKETS, N_LABELS)), np.zeros((3, N_LABELS, N_LABELS))
    unary[_bucket("two", "token", False), LABELS.index("secret")] = 10
    pair[SAME] = 3 * np.eye(N_LABELS)
    g = graph(f'token = "{SECRET}" then' + f" far away {SECRET}" * 40)
    labels = infer(Weights(unary, pair), np.array(g.features), np.array(g.edges))
    assert labels.tolist() == [LABELS.index("secret")] * 41


def test_messages_against_all_labellings():
    """On trees the marginals are exact; with a loop the best labels are those of the exact marginals when they are clear."""
    import itertools

    rng = np.random.default_rng(3)
    for trial in range(25):
        n = 4
        unary, pair = np.zeros((BUCKETS, N_LABELS)), rng.normal(size=(3, N_LABELS, N_LABELS))
        features = np.arange(n)[:, None]
        unary[:n] = rng.normal(size=(n, N_LABELS)) * 2
        edges = [(0, 1, CHAIN), (1, 2, SAME), (1, 3, ALIKE)] + ([(2, 3, CHAIN)] if trial % 2 else [])
        weight = np.zeros((n, N_LABELS))
        for labels in itertools.product(range(N_LABELS), repeat=n):
            p = np.exp(sum(unary[i, labels[i]] for i in range(n)) + sum(pair[k, labels[a], labels[b]] for a, b, k in edges))
            for i in range(n):
                weight[i, labels[i]] += p
        weight /= weight.sum(axis=1, keepdims=True)
        got = infer(Weights(unary, pair), features, np.array(edges), rounds=40)
        for i in range(n):
            first, second = np.sort(weight[i])[::-1][:2]
            if not trial % 2 or first > 2 * second:
                assert got[i] == weight[i].argmax()


def test_weights_are_learned_together():
    """Learners of parts of the data agree with what is plain in all of it, also for the edges."""
    from voltrace.llm.pii import _arrays
    from voltrace.llm.pii_rules import base_spans
    from voltrace.llm.skip_chain import Learner, weak_labels

    total = 0
    for part in range(5):
        graphs, labels = [], []
        for k in range(20):
            text = f'token = "{SECRET[:36]}{part:02d}{k:02d}" then far away {SECRET[:36]}{part:02d}{k:02d} and {k} more of 20{k:02d}'
            graphs.append(graph(text))
            labels += weak_labels(graphs[-1], base_spans(text))
        learner = Learner()
        learner.learn(*(lambda f, e, _: (f, np.array(labels), e))(*_arrays(graphs)))
        total = total + learner.sums()
    weights = Weights.of(total)
    secret = LABELS.index("secret")
    assert weights.pair[SAME][secret, secret] > weights.pair[SAME][secret, 0]
    g = graph(f'token = "{SECRET}" then far away {SECRET} and 7 more of 2011')
    assert infer(weights, np.array(g.features), np.array(g.edges)).tolist() == [secret, secret, 0, 0]


def _corpus(rng, cues, n):
    """Texts with secrets behind a cue, and numbers, versions and long plain words that are none; with the true secrets."""
    texts, true = [], []
    for k in range(n):
        words = [rng.choice(["the", "of", "run", "build42", "v2.10", "2024-05-01", "x86", "covid19", f"{rng.randrange(10**6)}", "internationalisation2"]) for _ in range(30)]
        secrets = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(rng.randint(0, 2))]
        for s in secrets:
            words.insert(rng.randrange(len(words)), f'{rng.choice(cues)} = "{s}"')
        texts.append(" ".join(words))
        true.append(set(secrets))
    return texts, true


def test_held_out_cues(spark):
    """Learned behind the rule's words, asked where another word, or none, stands before a secret; what the rule itself would say is counted too."""
    import random

    from voltrace.llm.pii import find_pii, fit_pii
    from voltrace.llm.pii_rules import base_spans
    from voltrace.llm.skip_chain import added_spans, weak_labels

    rng = random.Random(5)
    texts, _ = _corpus(rng, ["token", "key", "password"], 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = fit_pii(docs)
    asked, true = _corpus(rng, ["credential", "nonce", "digest"], 200)
    found = right = rule = 0
    for text, secrets in zip(asked, true, strict=True):
        g, base = graph(text), base_spans(text)
        spans = added_spans(g, infer(model, np.array(g.features), np.array(g.edges).reshape(-1, 3)), base) if g.spans else []
        said = {text[a:b] for kind, a, b in spans if kind == "secret"}
        found, right = found + len(said), right + len(said & secrets)
        rule += sum(x == LABELS.index("secret") for x in weak_labels(g, base))
    every = sum(map(len, true))
    assert rule == 0 and right >= 0.9 * every and right >= 0.95 * found
    bare = "run 40 of " + SECRET + " and build42"
    more = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, bare])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_added"] for r in find_pii(more).collect()}[len(texts)] == 1


def test_added_spans_by_brute_force():
    """What is added are labelled words that can be of their kind and touch no base span; neighbouring words of a number are one."""
    import random
    import re

    from voltrace.llm.pii_rules import base_spans
    from voltrace.llm.skip_chain import added_spans

    rng = random.Random(8)
    words = ["a@b.co", "10.0.0.1", "10.0.0.1.2", "+49", "30", "1234567", "4111", "1111111", SECRET, "secret9", "x", "a@b", "300.1.1.1", "12345678901"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        g, base = graph(text), base_spans(text)
        labels = np.array([rng.randrange(N_LABELS) for _ in g.spans], np.int64)
        runs = []
        for i, label in enumerate(labels.tolist()):
            kind = LABELS[label]
            if label and runs and runs[-1][0] == kind in ("phone", "card") and runs[-1][1][-1] == i - 1 and text[g.spans[i - 1][1] : g.spans[i][0]].strip("+ ") == "":
                runs[-1][1].append(i)
            elif label:
                runs.append((kind, [i]))
        want = []
        for kind, at in runs:
            a, b = g.spans[at[0]][0], g.spans[at[-1]][1]
            word, digits = g.cores[at[0]], sum(c.isdigit() for j in at for c in g.cores[j])
            able = {"email": re.fullmatch(r"[^@]+@[^@.]+(\.[^@.]+)+", word), "ip": re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", word), "card": 12 <= digits <= 19, "phone": 9 <= digits <= 15, "secret": re.fullmatch(r"(?=.*\d)(?=.*[A-Za-z])[\w/+-]{16,}", word)}[kind]
            if able and not any(x < b and a < y for _, x, y in base):
                want.append((kind, a, b))
        assert added_spans(g, labels, base) == want
