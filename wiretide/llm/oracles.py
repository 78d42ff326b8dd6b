"""DuckDB SQL of those operator queries that SQL can express."""

from __future__ import annotations

from .licenses import RULES, SENTENCES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


OP7 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, win FROM (
    SELECT item_id, 10 AS size, array_to_string(w[i:i+9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
    UNION ALL SELECT item_id, len(w) AS size, array_to_string(w, ' ') AS win FROM b WHERE len(w) BETWEEN 1 AND 9)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i+size-1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '#', '\\h')"

OP8 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(replace({_ESCAPED.format("role")}, ':', '\\c')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _normal(text: str) -> str:
    return f"array_to_string({_words(text)}, ' ')"


def op10() -> str:
    """Sentences between bounds, looked up by their words; only rules of one sentence can match there."""
    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(SENTENCES.items()))
    single = ", ".join(f"('{licence}', '{ids[0]}')" for _, licence, ids in RULES if len(ids) == 1)
    return f"""
WITH known AS (SELECT id, {_normal("said")} AS words FROM (VALUES {known}) AS k(id, said)),
rules AS (SELECT * FROM (VALUES {single}) AS r(licence, id)),
parts AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n|[.!?;:]+(\\s|$)')) AS part FROM documents),
found AS (SELECT p.doc_id, k.id FROM parts p JOIN known k ON {_normal("p.part")} = k.words),
sums AS (SELECT f.doc_id, count(*) AS n, count(r.licence) AS m, string_agg(DISTINCT r.licence, ',' ORDER BY r.licence) AS names FROM found f LEFT JOIN rules r USING (id) GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(names, '') AS licences, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(m, 0) AS BIGINT) AS n_matches
FROM documents d LEFT JOIN sums USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": OP7, "op8_event_sourced_chat": OP8, "op10_license_rules": op10()}
