"""SQL in DuckDB's dialect for the queries that SQL can express."""

from __future__ import annotations

#: crc32 of text by its table: t holds the 256 remainders of one byte.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text of one-byte characters; its statement has crc_table in FROM."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


def _edits(q: int, keeps: dict[str, int]) -> str:
    """The least (cost, audit, turns) from state q over the edits of the row itself; w0 to w3 are those behind it."""
    due, role = (2, "user") if q != 2 else (3, "assistant")
    kept = " ".join(f"WHEN '{i}' THEN struct_pack(c := w{to}.c + extra, a := 'K' || w{to}.a, t := list_prepend(role || ':' || text, w{to}.t))" for i, to in keeps.items())
    return f"""CASE WHEN fault IN ('blank', 'duplicate') THEN struct_pack(c := w{q}.c + 2, a := 'D' || w{q}.a, t := w{q}.t)
    ELSE list_min(list_filter([struct_pack(c := w{q}.c + 2, a := 'D' || w{q}.a, t := w{q}.t), struct_pack(c := w{due}.c + extra + 1, a := 'R' || w{due}.a, t := list_prepend('{role}:' || text, w{due}.t)),
      CASE role[1] {kept} END], lambda x: x IS NOT NULL)) END AS b{q}"""


def _inserted(q: int) -> str:
    """The same, with up to three turns inserted before the row."""
    options, audit, turns, p = [f"b{q}"], "", "", q
    for _ in range(3):
        to = 3 if p == 2 else 2
        audit, turns = audit + "I", turns + (", " if turns else "") + ("'assistant:'" if p == 2 else "'user:'")
        options.append(f"struct_pack(c := b{to}.c + {5 * len(audit)}, a := '{audit}' || b{to}.a, t := list_concat([{turns}], b{to}.t))")
        p = to
    return f"list_min([{', '.join(options)}]) AS w{q}"


def _end(cost: int, audit: str, turns: str, q: int) -> str:
    return f"struct_pack(c := {cost}::BIGINT, a := '{audit}', t := {turns}::VARCHAR[]) AS w{q}"


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
kinds AS (SELECT *, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
places AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS was,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending FROM places),
f AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
steps AS (
  SELECT conv_id, max(i) + 1 AS i, {_end(0, "", "[]", 0)}, {_end(10, "II", "['user:', 'assistant:']", 1)}, {_end(5, "I", "['assistant:']", 2)}, {_end(0, "", "[]", 3)} FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {", ".join(map(_inserted, range(4)))} FROM (
    SELECT conv_id, i, {", ".join(_edits(q, k) for q, k in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})))}
    FROM (SELECT s.*, f.role, f.text, f.fault, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra, f.i AS j FROM steps s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1) x(conv_id, k, w0, w1, w2, w3, role, text, fault, extra, i))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND was || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w0.c, 0) AS cost, coalesce(w0.a, '') AS audit, sha256(coalesce(array_to_string(w0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN (SELECT * FROM steps WHERE i = 1) s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


def _leaf(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT *, {_leaf()} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed_text FROM documents, crc_table),
p AS (SELECT doc_id, source, leaf, {_leaf("changed_text")} AS changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
levels AS (SELECT source, 0 AS h, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
  UNION ALL SELECT source, h + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1),
tops AS (SELECT 0 AS h, list(subroot ORDER BY place) AS nodes FROM subroots HAVING count(*) > 0
  UNION ALL SELECT h + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM tops WHERE len(nodes) > 1),
sides AS (
  SELECT doc_id, p.source, pos, h, nodes, pos // pow(3, h)::BIGINT AS i FROM p JOIN levels v ON v.source IS NOT DISTINCT FROM p.source WHERE len(nodes) > 1
  UNION ALL SELECT doc_id, p.source, pos, 1000 + h, nodes, place // pow(3, h)::BIGINT FROM p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source, tops WHERE len(nodes) > 1),
paths AS (SELECT source, pos, list(struct_pack(l := array_to_string(nodes[i // 3 * 3 + 1 : i], ''), r := array_to_string(nodes[i + 2 : i // 3 * 3 + 3], '')) ORDER BY h) AS path FROM sides GROUP BY source, pos),
r AS (SELECT p.*, subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, coalesce(path, []) AS path FROM p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN paths q ON q.source IS NOT DISTINCT FROM p.source AND q.pos = p.pos),
f AS (SELECT *, list_reduce(list_prepend(struct_pack(l := changed, r := ''), path), lambda x, s: struct_pack(l := sha256(s.l || x.l || s.r), r := '')).l AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
