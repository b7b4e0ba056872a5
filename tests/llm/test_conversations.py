"""Repair of conversations against a plain search over all edits, and against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from voltrace.llm.conversations import damaged, repair_conversations, step

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
TEXTS = ["Fine.", "And then", "why?", "", " \t", "no\n", "ja!  ", None, "x" * 400 + ".", "é…", " ", "ok."]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([k, k, k, k - 1, k + 2, None]), rng.choice(ROLES), rng.choice(TEXTS), "clash"))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 0, "user", "Whose?", "clash"), (None, 1, "assistant", "No one's.", "clash"), (7, None, None, None, None), (10**17 + 1, 5, "user", "Hi.", "")]
    return rows


def plain_damage(rows):
    out, convs = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(out[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c in convs}


def plain_repair(rows):
    """Least (cost, audit, turns) over all edits, by trying every one of them."""
    faults, seen = [], set()
    for _, role, text in rows:
        word = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, said, inserts):
        options = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            return (0, "", ())
        if i < len(rows):
            role, text, extra = rows[i][1], rows[i][2], 5 * (faults[i] == "truncated")
            options.append(("D", 2, None, said))
            if faults[i] in ("", "truncated"):
                options += [("K", extra, f"{role}:{text}", said + (role[:1] or "-"))] + [("R", 1 + extra, f"{r}:{text}", said + r[0]) for r in ("user", "assistant")]
        if inserts < 3:
            options += [("I", 5, f"{r}:", said + r[0]) for r in ("user", "assistant")]
        found = []
        for letter, cost, turn, after in options:
            after = after[-3:] if len(after) <= 3 or after[0] != "s" else after
            if re.fullmatch("s?(ua)*u?", after):  # the start of something legal
                rest = best(i + (letter != "I"), after[:1] + after[3:] if after[:3] == "sua" else after if len(after) < 3 or after[0] == "s" else after[2:], inserts + 1 if letter == "I" else 0)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], ((turn,) if turn is not None else ()) + rest[2]))
        return min(found) if found else None

    cost, audit, turns = best(0, "", 0) if rows else (0, "", ())
    turns_seen = sorted({r[0] for r in rows if r[0] is not None})
    initials = [r[1][:1] for r in rows]
    return (
        turns_seen[-1] - turns_seen[0] + 1 - len(turns_seen) if turns_seen else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest(),
    )


def plain_search(rows):
    """The same by a table over places and states, for conversations too long to try everything."""
    faults, seen = [], set()
    for _, role, text in rows:
        word = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(2 if not word or (role, text) in seen else 1 if word[-1] not in ".!?" else 0)
        seen.add((role, text))
    due = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    last = {"": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        own = {}
        for q in last:
            options = [(2 + last[q][0], "D" + last[q][1])]
            if fault < 2:
                extra, to = 5 * fault, due[q][0]
                options.append((1 + extra + last[to][0], "R" + last[to][1]))
                if role[:1] == to or (q == "" and role[:1] == "s"):
                    options.append((extra + last[role[0]][0], "K" + last[role[0]][1]))
            own[q] = min(options)
        last = {q: min(own[q], (5 + own[due[q][0]][0], "I" + own[due[q][0]][1]), (10 + own[due[due[q][0]][0]][0], "II" + own[due[due[q][0]][0]][1])) for q in own}
    return last[""]


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_equals_a_search_over_all_edits(spark):
    rows = conversations(1, 60, 6)
    got = collected(repair_conversations(damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))))
    want = {c: plain_repair(tuple(r)) for c, r in plain_damage(rows).items()}
    assert got == want
    assert all(any(letter in r[6] for r in got.values()) for letter in "DKR")


def test_a_turn_is_inserted_where_that_is_cheapest():
    """No conversation as a whole needs one (deleting a neighbour costs less), so the step is asked with costs to go of its own."""
    to_go, edits = step((50, 50, 50, 0), "a", 0)
    assert to_go == (5, 5, 0, 2) and [edits >> 4 * q & 15 for q in range(4)] == [4, 4, 1, 0]  # insert one and keep; behind a user, keep; else delete
    assert step((50, 50, 50, 3), "a", 5)[1] >> 8 & 15 == 1 and step((50, 50, 4, 50), "a", 0)[1] & 15 == 2
    assert step((3, 9, 9, 0), "s", 0)[1] & 15 == 0  # delete: ASCII-least of equal costs


def test_undamaged_and_long(spark):
    rng = random.Random(4)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"t{k}.", f"u{k}"]), "") for k in range(900)] + [(1, 3, "user", "same.", "")] * 400
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)  # a conversation is longer than a batch
    try:
        got = collected(repair_conversations(spark.createDataFrame(rows, SCHEMA)))[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    plain = sorted(((r[1], r[2], r[3]) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    assert (got[5], got[6]) == plain_search(plain) and got[2] > 399


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damaged(empty)).collect() == []
    with pytest.raises(TypeError):
        repair_conversations(empty.selectExpr("CAST(conv_id AS DOUBLE) AS conv_id", "turn", "role", "text"))
    named = spark.createDataFrame([("c:1", 0, "user", "Hi."), ("", 0, "user", "Hi."), ("c:1", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    assert {c: r[6] for c, r in collected(repair_conversations(named)).items()} == {"c:1": "KK", "": "D"}
