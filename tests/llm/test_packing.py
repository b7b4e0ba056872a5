"""Packing of token ids against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from voltrace.llm.packing import LENGTHS, OVERHEAD, best_fit_packing, pack, sequences

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def brute(lengths, capacities, overhead):
    """Bin and offset by piece, and bin lengths, by looking at every bin and every piece to come."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rooms, used, touched, place = [], [], [], {}
    for step, i in enumerate(order):
        n = lengths[i]
        able = [b for b in range(len(rooms)) if rooms[b] >= n]
        if able:
            least = min(rooms[b] for b in able)
            b = max((b for b in able if rooms[b] == least), key=lambda b: touched[b])
        else:
            best = None
            for c in sorted(capacities):
                if c >= n:
                    room = c - n
                    for j in order[step + 1 :]:
                        if lengths[j] <= room:
                            room -= lengths[j]
                    cost = (c + overhead) / (c - room)
                    if best is None or cost < best[0]:
                        best = (cost, c)
            b = len(rooms)
            rooms.append(best[1])
            used.append(0)
            touched.append(0)
        place[i] = (b, used[b])
        rooms[b] -= n
        used[b] += n
        touched[b] = step
    return [place[i][0] for i in range(len(lengths))], [place[i][1] for i in range(len(lengths))], [min(c for c in capacities if c >= u) for u in used]


def test_best_fit_and_cheapest_bin_by_loops():
    rng = random.Random(7)
    for k in range(120):
        capacities = rng.choice([LENGTHS, (10, 16, 40), (7,), (64, 100, 128)])
        top = max(capacities)
        lengths = [rng.choice([rng.randint(1, min(30, top)), rng.randint(1, top)]) for _ in range(rng.randint(0, 90))]
        overhead = rng.choice([0, 3, OVERHEAD])
        assert pack(lengths, capacities, overhead) == brute(lengths, capacities, overhead), k


def test_sequences_hold_every_token(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma,", "delta42", "é"], k=rng.randint(0, 300))) for _ in range(120)] + [None, "", "word " * 9000, "same text", "same text"]
    rows = [(f"id{k}", t, "x") for k, t in enumerate(texts)] + [(None, "no id " * k, "y") for k in range(40)] + [("id3", texts[3], "z")]
    docs = spark.createDataFrame(rows, "name string, text string, ids string").repartition(4)
    pieces = best_fit_packing(docs, PATH, id_col="name", group_rows=50)
    plain = lambda r: r.asDict() | {"ids": np.frombuffer(bytes(r["ids"]), "<u2").tolist()}
    got = [plain(r) for r in pieces.collect()]
    assert len({r["bin_group"] for r in got}) > 2  # rows without an id are in several groups, too
    assert len({r["bin_group"] for r in got if r["name"] is None}) > 2
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    whole = {(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, _ in rows}
    found = Counter()
    by_doc = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["n_tokens"] and r["start"] == r["piece"] * max(LENGTHS)
        found[r["name"]] += r["n_tokens"]
        if r["name"] is not None and r["name"] != "id3":
            by_doc[r["name"]] = by_doc.get(r["name"], ()) + tuple(r["ids"])
    assert all((i, ids) in whole for i, ids in by_doc.items())
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert found == want
    lines = [plain(r) for r in sequences(pieces, "name", pad_id=65535).collect()]
    assert sum(r["n_tokens"] for r in lines) == sum(want.values())
    at = {(r["bin_group"], r["bin"]): r for r in lines}
    for r in got:
        line = at[r["bin_group"], r["bin"]]
        assert line["ids"][r["bin_offset"] : r["bin_offset"] + r["n_tokens"]] == r["ids"]
        assert len(line["ids"]) == r["bin_length"] == min(c for c in LENGTHS if c >= line["n_tokens"])
        assert line["ids"][line["n_tokens"] :] == [65535] * (r["bin_length"] - line["n_tokens"])
    assert best_fit_packing(docs.limit(0), PATH, id_col="name").count() == 0
    assert np.array_equal(sorted(map(str, got)), sorted(str(plain(r)) for r in pieces.collect()))
