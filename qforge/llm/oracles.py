"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from qforge.llm.secrets import RULES

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex(coalesce({text}, ''), '{at}'), lambda x: x <> '')"
_ALNUM = _SPLIT.format(text=_LOW, at=r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PLAIN = _SPLIT.format(text="text", at=r"[\x20\x09-\x0D]+")

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
 n AS (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM n)),
 spots AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM n))),
 met AS (SELECT DISTINCT doc_id, s, spots.n, item_id FROM spots JOIN win USING (n, k)),
 hit AS (SELECT doc_id, count(DISTINCT p)::bigint AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*)::bigint AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
 win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
 held AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM held),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _spans(order: int) -> str:
    """kind number, start and end of a rule's matches: lengths of the pieces between matches and of the matches, summed up."""
    r = RULES[order]
    pattern = r.pattern.replace("}+", "}").replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{r.kind}' AS kind, ends[i] - length(m[i]) AS s, ends[i] AS e FROM (SELECT doc_id, m, g, list_transform(m, lambda x, i: list_sum(list_transform(p[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y)))) AS ends, unnest(range(1, len(m) + 1)) AS i
 FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g, string_split_regex(text, '{pattern}') AS p FROM documents)) WHERE length(g[i]) >= {r.least}"""


def _listed(name: str, only: str = "true") -> str:
    return f"coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, o, e) FILTER (WHERE {only}), '') AS {name}"


_BASE = [i for i, r in enumerate(RULES) if r.base]
SECRETS = f"""WITH x AS ({" UNION ALL ".join(_spans(i) for i in range(len(RULES)))}),
 a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE o = {i}) AS n_{RULES[i].kind}" for i in _BASE)}, {_listed("base", f"o IN ({', '.join(map(str, _BASE))})")}, {_listed("spans")} FROM x GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{RULES[i].kind}, 0) AS n_{RULES[i].kind}" for i in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""

#: DuckDB has no CRC-32, so it is taken bit by bit: each byte is followed by seven zeros, of which every one shifts once more.
IMPORTANCE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents), i AS (SELECT {_ALNUM} AS w FROM benchmark),
 spots AS MATERIALIZED (SELECT r, array_to_string(w[s:s + n - 1], ' ') AS f FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (VALUES (1), (2), (3)) AS k(n))),
 aims AS MATERIALIZED (SELECT array_to_string(w[s:s + n - 1], ' ') AS f FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i, (VALUES (1), (2), (3)) AS k(n))),
 bits AS (SELECT f, flatten(list_transform(range(1, octet_length(encode(f)) + 1), lambda p: [('0x' || substr(hex(encode(f)), 2 * p - 1, 2))::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint])) AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM spots UNION SELECT f FROM aims))),
 crcs AS MATERIALIZED (SELECT f, (xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384::ubigint)), 4294967295::ubigint) % 10000)::bigint AS k FROM bits),
 own AS MATERIALIZED (SELECT r, k, count(*) AS n FROM spots JOIN crcs USING (f) GROUP BY r, k),
 sums AS (SELECT k, sum(n) AS n FROM own GROUP BY k), goal AS (SELECT k, count(*) AS n FROM aims JOIN crcs USING (f) GROUP BY k),
 total AS (SELECT coalesce((SELECT sum(n) FROM sums), 0)::double + 10000 AS s, coalesce((SELECT sum(n) FROM goal), 0)::double + 10000 AS t),
 gain AS (SELECT k, floor(1000 * ln(((coalesce(goal.n, 0) + 1)::double * total.s) / ((sums.n + 1)::double * total.t)))::bigint AS g FROM sums LEFT JOIN goal USING (k), total),
 scored AS (SELECT r, sum(n * g)::bigint AS weight, sum(n)::bigint AS n_features FROM own JOIN gain USING (k) GROUP BY r),
 alls AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::ubigint::double + 0.5) / 4294967296)))::bigint AS score FROM d LEFT JOIN scored USING (r))
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM alls)"""

#: Costs of finishing row by row from the end, then the least edit character by character from the start; lists of costs are by state: nothing yet, system, user, assistant.
CONVERSATIONS = r"""WITH RECURSIVE bits AS (SELECT *, coalesce(conv_id::varchar, ' ') AS cid, flatten(list_transform(range(1, length(key) + 1), lambda p: [ascii(substr(key, p, 1))::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint, 0::ubigint])) AS b
 FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations)),
 drawn AS MATERIALIZED (SELECT conv_id, cid, turn, role, text, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384::ubigint)), 4294967295::ubigint) % 20 AS d FROM bits),
 damaged AS (SELECT cid, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE d <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, h, copy) AS i, row_number() OVER (PARTITION BY cid, h ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM (SELECT *, md5(length(role) || ':' || role || text) AS h FROM damaged)),
 r AS MATERIALIZED (SELECT cid, i, turn, role, text, CASE WHEN said = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, coalesce(list_position(['s', 'u', 'a'], left(role, 1)), 4) - 1 AS code, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS pair, count(*) OVER (PARTITION BY cid) AS n FROM placed),
 sums AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY cid),
 back(cid, i, c) AS (SELECT cid, n + 1, [0, 6, 3, 0] FROM (SELECT DISTINCT cid, n FROM r)
  UNION ALL SELECT cid, i, [least(l[1], 3 + least(l[3], 3 + l[4])), least(l[2], 3 + least(l[3], 3 + l[4])), least(l[3], 3 + l[4]), least(l[4], 3 + l[3])] FROM (
   SELECT r.cid, r.i, list_transform([1, 2, 3, 4], lambda q: least(4 + c[q], CASE WHEN fault IN (0, 3) THEN fault + 3 + c[[3, 3, 4, 3][q]] ELSE 999999 END, CASE WHEN fault NOT IN (0, 3) THEN 999999 WHEN code = 0 AND q = 1 THEN fault + c[2] WHEN code = 1 AND q <> 3 THEN fault + c[3] WHEN code = 2 AND q = 3 THEN fault + c[4] ELSE 999999 END)) AS l
   FROM back JOIN r ON r.cid = back.cid AND r.i = back.i - 1)),
 costs AS MATERIALIZED (SELECT a.cid, a.i, a.c AS now, b.c AS later, role, text, fault, code FROM back a LEFT JOIN back b ON a.cid = b.cid AND b.i = a.i + 1 LEFT JOIN r ON r.cid = a.cid AND r.i = a.i),
 forth(cid, i, q, audit, kept) AS (SELECT DISTINCT cid, 1::bigint, 1, '', []::varchar[] FROM r
  UNION ALL SELECT cid, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' AND code = 0 THEN 2 ELSE [3, 3, 4, 3][q] END, audit || e,
   CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) ELSE list_append(kept, CASE WHEN q = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (SELECT f.*, role, text, code, CASE WHEN later IS NULL THEN 'I' WHEN 4 + later[q] = now[q] THEN 'D' WHEN 3 + now[[3, 3, 4, 3][q]] = now[q] THEN 'I'
    WHEN fault IN (0, 3) AND (code = 0 AND q = 1 AND fault + later[2] = now[q] OR code = 1 AND q <> 3 AND fault + later[3] = now[q] OR code = 2 AND q = 3 AND fault + later[4] = now[q]) THEN 'K' ELSE 'R' END AS e
   FROM forth f JOIN costs ON costs.cid = f.cid AND costs.i = f.i WHERE later IS NOT NULL OR q IN (2, 3))),
 done AS (SELECT f.cid, audit, sha256(array_to_string(kept, chr(10))) AS repaired_sha256 FROM forth f JOIN (SELECT DISTINCT cid, n FROM r) m ON m.cid = f.cid AND f.i = m.n + 1 WHERE q IN (1, 4))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(now[1], 0)::bigint AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM drawn) LEFT JOIN sums USING (cid) LEFT JOIN done USING (cid) LEFT JOIN (SELECT cid, now FROM costs WHERE i = 1) USING (cid)"""
