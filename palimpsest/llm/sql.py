"""DuckDB SQL that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from palimpsest.llm import chat, fingerprint, licenses


def _prints(entries: str, plain: str) -> str:
    subsets = " || '-' || ".join(f"coalesce(substr(md5(string_agg(CASE WHEN mask & {1 << k} <> 0 THEN h END, '' ORDER BY h)), 1, 12), '_')" for k in range(len(fingerprint.SUBSETS)))
    return f"CASE WHEN count(h) = 0 THEN array_to_string(list_resize([first({plain})], {len(fingerprint.SUBSETS)}, first({plain})), '-') ELSE {subsets} END AS {entries}"


def _likeness(a: str, b: str) -> str:
    pairs = f"list_filter(list_zip(string_split({a}, '-'), string_split({b}, '-')), lambda x: x[1] <> '_' OR x[2] <> '_')"
    return f"CASE WHEN len({pairs}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({pairs}, lambda x: x[1] = x[2]))::DOUBLE / len({pairs}) END"


_MASK = " + ".join(f"CASE WHEN ('0x' || substr(md5('{k}:' || term), 1, 8))::BIGINT < {int(share * 2**32)} THEN {1 << k} ELSE 0 END" for k, share in enumerate(fingerprint.SUBSETS))

OP7 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), ordered AS (
  SELECT *, coalesce(lead(doc_id) OVER w, min(doc_id) OVER ()) AS next_id,
         coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id)) AS next_text
  FROM docs WINDOW w AS (ORDER BY doc_id)
), edits AS (
  SELECT doc_id, n, next_id, text, substr(text, 1, (n - n // 4)::BIGINT) || substr(next_text, 1, (n // 4)::BIGINT) AS edited FROM ordered
), sides AS (
  SELECT doc_id, 0 AS side, text AS t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits
), words AS (
  SELECT doc_id, side, list_distinct(list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS terms FROM sides
), counts AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(terms) AS term FROM words WHERE side = 0) GROUP BY term
), lexicon AS (
  SELECT term, substr(md5(term), 1, 16) AS h, {_MASK} AS mask FROM counts
  WHERE n >= {fingerprint.LOW} * (SELECT count(*) FROM documents) AND n <= greatest({fingerprint.HIGH} * (SELECT count(*) FROM documents), 1)
), plain AS (
  SELECT doc_id, side, CASE WHEN len(terms) = 0 THEN '_' ELSE substr(md5(array_to_string(list_sort(terms), ' ')), 1, 12) END AS plain FROM words
), hits AS (
  SELECT doc_id, side, h, mask FROM (SELECT doc_id, side, unnest(terms) AS term FROM words) JOIN lexicon USING (term)
), prints AS (
  SELECT p.doc_id, p.side, {_prints('print', 'plain')} FROM plain p LEFT JOIN hits h ON p.doc_id = h.doc_id AND p.side = h.side GROUP BY p.doc_id, p.side
)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, a.print AS fingerprint, b.print AS edited_fingerprint,
       {_likeness('a.print', 'b.print')} AS near_edited, {_likeness('a.print', 'c.print')} AS near_next
FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.side = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.side = 1
JOIN prints c ON c.doc_id = e.next_id AND c.side = 0
"""

def _shingles(words: str) -> str:
    return f"list_transform(range(len({words}) - {licenses.SHINGLE - 1}), lambda i: array_to_string({words}[i + 1 : i + {licenses.SHINGLE}], ' '))"


_TEMPLATES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES.items())
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

#: Every document against every template, without bands.
OP5 = f"""
WITH templates AS (
  SELECT name, list_distinct({_shingles('w')}) AS own FROM (SELECT name, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) AS t(name, text))
), docs AS (
  SELECT doc_id, {_shingles('w')} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= {licenses.SHINGLE}
), pairs AS (
  SELECT doc_id, name, s, len(own) AS n, list_intersect(own, s) AS held FROM docs, templates
)
SELECT doc_id, name AS template, len(held)::DOUBLE / n AS containment,
       list_min(list_transform(held, lambda h: list_position(s, h)))::BIGINT - 1 AS first_word
FROM pairs WHERE len(held)::DOUBLE / n >= {licenses.CONTAINMENT}
"""

#: Turns are unique in a conversation. The kind of its log tells how its items are ordered: in order, by
#: logged turn; late calls, each result right behind its call; reversed, each chain of calls two turns
#: apart behind its last one, from the last to the first; cyclic chains stay at their turns.
OP10 = f"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, to_json(coalesce(text, ''))::VARCHAR AS q, conv_id % {chat.KINDS} AS kind FROM conversations
), linked AS (
  SELECT a.*, b.role AS prior, c.role AS following, d.role AS two_on, e.role AS two_back,
         2 * a.turn - CASE WHEN a.kind = {chat.LATE_CALLS} AND a.role = 'assistant' THEN 3 ELSE 0 END AS logged
  FROM m a LEFT JOIN m b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN m c ON a.conv_id = c.conv_id AND a.turn = c.turn - 1
       LEFT JOIN m d ON a.conv_id = d.conv_id AND a.turn = d.turn - 2 LEFT JOIN m e ON a.conv_id = e.conv_id AND a.turn = e.turn + 2
), chains AS (
  SELECT *, CASE WHEN role = 'user' THEN turn WHEN role = 'assistant' AND prior = 'user' THEN turn - 1 END AS call_turn FROM linked
), ends AS (
  SELECT conv_id, turn AS last, following = 'assistant' AS answered FROM chains WHERE role = 'user' AND two_on IS DISTINCT FROM 'user'
), placed AS (
  SELECT c.*, e.last, coalesce(e.answered, false) AS answered
  FROM chains c ASOF LEFT JOIN (SELECT conv_id, last, answered, last % 2 AS parity FROM ends) e ON c.conv_id = e.conv_id AND c.call_turn % 2 = e.parity AND c.call_turn <= e.last
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, last ORDER BY call_turn DESC, role = 'assistant') - 1 - CASE WHEN answered THEN 1 ELSE 0 END AS behind FROM placed
), keyed AS (
  SELECT *, CASE WHEN kind = {chat.LATE_CALLS} AND role = 'assistant' AND prior = 'user' THEN 2 * (turn - 1)
                 WHEN kind = {chat.REVERSED} AND last IS NOT NULL AND behind > 0 THEN 2 * last + CASE WHEN answered THEN 2 ELSE 0 END ELSE logged END AS spot,
         CASE WHEN kind = {chat.LATE_CALLS} AND role = 'assistant' AND prior = 'user' THEN 1 WHEN kind = {chat.REVERSED} AND last IS NOT NULL AND behind > 0 THEN behind ELSE 0 END AS step
  FROM numbered
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY spot, step) - 1 AS position, logged AS turn,
       CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role,
       CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
       CASE role WHEN 'user' THEN turn::VARCHAR WHEN 'assistant' THEN (turn - 1)::VARCHAR END AS call_id,
       CASE role WHEN 'user' THEN CASE WHEN kind = {chat.CYCLIC} AND (two_on = 'user' OR two_back = 'user') THEN 'cycle' WHEN following = 'assistant' THEN 'linked' ELSE 'unanswered' END
                 WHEN 'assistant' THEN CASE WHEN prior = 'user' THEN 'linked' ELSE 'orphan' END ELSE 'message' END AS status,
       CASE WHEN role = 'user' THEN text <> '' END AS valid,
       CASE WHEN role = 'user' AND text = '' THEN '$.prompt: too short' END AS error,
       CASE role WHEN 'user' THEN '{{"arguments":{{"prompt":' || q || ',"turn":' || turn || '}},"id":"' || turn || '","name":"respond","role":"user"}}'
                 WHEN 'assistant' THEN '{{"content":' || q || ',"role":"tool","tool_call_id":"' || (turn - 1) || '"}}'
                 ELSE '{{"content":' || q || ',"role":' || to_json(role)::VARCHAR || '}}' END AS json
FROM keyed
"""

SQL: dict[str, str] = {"op10_chat_formatting": OP10, "op5_license_scans": OP5, "op7_document_fingerprints": OP7}
