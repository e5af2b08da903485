"""SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from .chat import CHAIN, REPLY, SHORT
from .mixing import MAX_EPOCHS, SCHEDULES, WEIGHTS, segments
from .url_filter import RULES, domains

_WORD = r"[^\x20\x09-\x0D]+"


def _inverse(share: str, knots) -> str:
    """The schedule's inverse, piece by piece."""
    cases = []
    pieces = segments(knots)
    for n, (t0, t1, w0, w1, done) in enumerate(pieces):
        rest = f"greatest({share} - {done!r}, 0)"
        slope = (w1 - w0) / (t1 - t0)
        root = f"({w0!r} + sqrt(greatest({w0 * w0!r} + {2 * slope!r} * {rest}, 0)))"
        at = f"least({t1!r}, {t0!r} + coalesce(2 * {rest} / nullif({root}, 0), 0))"
        cases.append((pieces[n + 1][4] if n + 1 < len(pieces) else None, at))
    out = cases[-1][1]
    for until, at in reversed(cases[:-1]):
        out = f"CASE WHEN {share} < {until!r} THEN {at} ELSE {out} END"
    return out


def mixing() -> str:
    weight = f"{list(WEIGHTS)}[(rank % {len(WEIGHTS)} + 1)::INT]"
    copies = [f"greatest(0, least(size, floor(target)::BIGINT - ({e} * source_size + start)))" for e in range(MAX_EPOCHS)]
    share = "coalesce(start / nullif(target, 0), 0)"
    at = "CASE " + " ".join(f"WHEN rank % {len(SCHEDULES)} = {k} THEN {_inverse(share, s)}" for k, s in enumerate(SCHEDULES)) + " END"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, {weight}::BIGINT AS weight, source_size * {MAX_EPOCHS} AS cap FROM s),
c AS (SELECT *, row_number() OVER o AS n, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rest_weight FROM w WINDOW o AS (ORDER BY cap / weight, rank), b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / weight < rest / rest_weight AS capped FROM c),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (SELECT arg_min(rest, n) FROM f WHERE NOT capped) / (SELECT arg_min(rest_weight, n) FROM f WHERE NOT capped) END::DOUBLE AS target FROM f),
l AS (SELECT d.*, source_size, rank, target, (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ({" + ".join(copies)})::BIGINT AS taken, ({" + ".join(f"({c} > 0)::INT" for c in copies)})::INT AS copies, CASE WHEN {copies[0]} > 0 THEN round({at}, 6) END AS first_position FROM l"""


def url_filter() -> str:
    host = "lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'))"
    cases = {"rule": "", "verdict": ""}
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        cases["rule"] += f"{fits}'{h}{p}' "
        cases["verdict"] += f"{fits}'{v}' "
    listed = "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in domains()) + ")"
    return f"""WITH p AS (SELECT page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT page_id, host, path, CASE {cases["rule"]}END AS rule, CASE {cases["verdict"]}WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, {listed} AS listed FROM p"""


def chat() -> str:
    """As the driver's conversations have their calls made from user turns, so has the SQL.

    Levels are worked out from the chain of calls: call k of a chain refers to
    the one two turns before, if that is a call.
    """
    assert REPLY == {"reply": {"after": ("string", False), "text": ("string", True), "turn": ("integer", True)}} and CHAIN == 4
    id_ = "'call-' || conv_id || '-' || {}"
    text = "CASE WHEN text IS NULL THEN '' ELSE '\"content\":' || to_json(text)::VARCHAR || ',' END"
    place = "((turn // 2) % 4)"
    after = f"CASE WHEN turn >= 2 AND {place} <> 0 THEN '\"after\":{{\"$ref\":\"' || {id_.format('(turn - 2)')} || '\"}},' ELSE '' END"
    short = f"CASE WHEN length(text) < {SHORT} THEN '\"short\":true,' ELSE '' END"
    number = "CASE WHEN turn % 5 = 4 THEN '\"' || turn || '\"' ELSE turn::VARCHAR END"
    arguments = f"'{{' || {after} || {short} || CASE WHEN text IS NULL THEN '' ELSE '\"text\":' || to_json(text)::VARCHAR || ',' END || '\"turn\":' || {number} || '}}'"
    level = f"CASE WHEN turn < 2 OR {place} = 0 OR NOT l1 THEN 0 WHEN turn < 4 OR {place} = 1 OR NOT l2 THEN 1 WHEN turn < 6 OR {place} = 2 OR NOT l3 THEN 2 ELSE 3 END::INT"
    errors = f"concat_ws(',', CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN turn % 5 = 4 THEN 'type of turn' END, CASE WHEN length(text) < {SHORT} THEN 'unknown short' END)"
    there = ", ".join(f"EXISTS (SELECT 1 FROM k WHERE k.conv_id = c.conv_id AND k.turn = c.turn - {2 * n}) AS l{n}" for n in (1, 2, 3))
    return f"""WITH m AS (SELECT conv_id, turn, role, text, {id_.format("turn")} AS id, {id_.format("(turn - 1)")} AS answers FROM conversations), k AS (SELECT DISTINCT conv_id, turn, id FROM m WHERE role = 'user'), u AS (SELECT c.id, {level} AS level FROM (SELECT *, {there} FROM k c) c), a AS (SELECT answers, count(*) AS n FROM m WHERE role = 'assistant' GROUP BY answers)
SELECT conv_id, turn AS order_turn, 0::INT AS order_index, 0::INT AS order_phase, 'message' AS kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS status, 0::INT AS level, '' AS errors, '{{' || {text} || '"conv_id":' || conv_id || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || ',"type":"message"}}' AS json FROM m WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, turn, 0, 0, 'call', m.id, CASE WHEN a.n > 0 THEN 'answered' ELSE 'unanswered' END, u.level, {errors}, '{{"arguments":' || to_json({arguments})::VARCHAR || ',"conv_id":' || conv_id || ',"id":"' || m.id || '","name":"reply","role":"user","type":"call"}}' FROM m JOIN u ON m.id = u.id LEFT JOIN a ON m.id = a.answers WHERE role = 'user'
UNION ALL SELECT conv_id, CASE WHEN u.id IS NOT NULL THEN turn - 1 ELSE turn END, 0, CASE WHEN u.id IS NOT NULL THEN 1 ELSE 0 END, 'result', m.answers, CASE WHEN u.id IS NOT NULL THEN 'linked' ELSE 'orphan' END, coalesce(u.level, 0), '', '{{' || {text} || '"conv_id":' || conv_id || ',"id":"' || m.answers || '","role":"assistant","type":"result"}}' FROM m LEFT JOIN u ON m.answers = u.id WHERE role = 'assistant'"""


def quality() -> str:
    """All measures, and the verdict of the production rules, which doesn't depend on their order."""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM d),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r, range(5) x(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100 * n_symbols > 25 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutters > 30 * n_words OR 100 * n_upper > 50 * n_words) AS kept FROM b"""


_REACH = "r AS (WITH RECURSIVE reach(id, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON reach.id = e.a) SELECT id, min(c) AS c FROM reach GROUP BY id)"


def near_duplicates() -> str:
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.c, d.doc_id) AS component_id, coalesce(r.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON d.doc_id = r.id"""


def embedding_links() -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), {_REACH}, n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(r.c, vec_id) AS component_id, coalesce(r.c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN r ON vec_id = r.id"""


SQL = {"op1_mixing": mixing(), "op2_url_filter": url_filter(), "op3_quality": quality(), "op5_minhash": near_duplicates(), "op6_metric_join": embedding_links(), "op10_chat": chat()}
