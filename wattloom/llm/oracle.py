"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import collocations as cl
from . import decontaminate as dc
from . import divergence as dv
from . import licenses as lic
from . import url_filter as uf

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP10 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(t: str) -> str:
    t = f"regexp_replace(lower(coalesce({t}, '')), {_q(lic.COPYRIGHT_LINE)}, chr(10), 'g')"
    t = f"'  ' || trim(regexp_replace({t}, {_q(lic.NOT_WORD)}, '    ', 'g')) || '  '"
    for a, b in lic.EQUIVALENT:
        t = f"replace({t}, {_q(lic.spaced(a))}, {_q(lic.spaced(b))})"
    return f"trim(replace({t}, '    ', ' '))"


OP5 = f"""
WITH known AS (
  SELECT canonical_sha256, min(license_id) AS license_id FROM (
    SELECT sha256({_canonical("text")}) AS canonical_sha256, license_id FROM (VALUES {", ".join(f"({_q(i)}, {_q(t)})" for i, t in lic.KNOWN)}) v(license_id, text)
    UNION ALL SELECT canonical_sha256, license_id FROM (VALUES {", ".join(f"({_q(i)}, {_q(t)})" for i, t in lic.KNOWN_DIGESTS)}) w(license_id, canonical_sha256)) GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, d.canonical_sha256, license_id, license_id IS NOT NULL AS matched FROM d LEFT JOIN known USING (canonical_sha256)
"""


#: Levels that the SQL spells out; no path of the tables goes deeper, where literals would stay as they are.
SQL_LEVELS = 6


def _op3(templates: bool = False) -> str:
    rules = sorted(uf.RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = lambda r: f"(host = {_q(r.split('/', 1)[0])} OR ends_with(host, {_q('.' + r.split('/', 1)[0])})) AND starts_with(path, {_q('/' + r.split('/', 1)[1])})"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_q(r)}" for r, _ in rules) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(r)} THEN {_q(a)}" for r, a in rules) + " END"
    typed = f"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{uf.NUMBER}') THEN '#' WHEN regexp_matches(s, '{uf.HEX}') AND regexp_matches(s, '[0-9]') THEN '%' ELSE '=' || s END)"
    sql = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
base AS (SELECT *, {rule} AS rule, {action} AS action, {typed} AS segs FROM u),
l0 AS (SELECT host, segs, count(*) AS n, count(*) FILTER (action = 'block') AS nb, count(*) FILTER (action = 'allow') AS na, '' AS prefix, '' AS shape FROM base GROUP BY host, segs)"""
    for k in range(SQL_LEVELS):
        sql += f""",
w{k} AS (SELECT host, prefix FROM (SELECT host, prefix, segs[{k + 1}] AS seg, sum(n) AS n FROM l{k} WHERE segs[{k + 1}] LIKE '=%' GROUP BY ALL)
  GROUP BY host, prefix HAVING count(*) >= {uf.MIN_CHILDREN} AND count(*) >= {uf.MIN_DISTINCT_SHARE} * sum(n)),
p{k} AS (SELECT l{k}.*, CASE WHEN w{k}.host IS NOT NULL AND segs[{k + 1}] LIKE '=%' THEN '*' ELSE segs[{k + 1}] END AS part FROM l{k} LEFT JOIN w{k} USING (host, prefix)),
l{k + 1} AS (SELECT host, segs, n, nb, na, prefix || coalesce('/' || part, '') AS prefix, shape || coalesce(CASE WHEN part LIKE '=%' THEN '/=' ELSE '/' || part END, '') AS shape FROM p{k})"""
    k = SQL_LEVELS
    sql += f""",
c AS (SELECT *, prefix || CASE WHEN len(segs) > {k} THEN '/' || array_to_string(segs[{k + 1}:], '/') ELSE '' END AS template FROM l{k}),
t AS (SELECT host, shape, template, sum(n) AS n, sum(nb)::DOUBLE AS b, sum(nb + na)::DOUBLE AS m FROM c WHERE host <> '' GROUP BY ALL HAVING sum(nb + na) > 0),
tp AS (SELECT *, sum(b) OVER (PARTITION BY host, shape) / sum(m) OVER (PARTITION BY host, shape) AS p, sum(m) OVER (PARTITION BY host, shape) AS pm FROM t),
ts AS (SELECT *, (b / m - p) * (b / m - p) <= {uf.Z * uf.Z} * p * (1 - p) * (1 / m + 1 / pm) AS alike FROM tp),
tm AS (SELECT *, sum(b) FILTER (alike) OVER (PARTITION BY host, shape) AS mb, sum(m) FILTER (alike) OVER (PARTITION BY host, shape) AS mm FROM ts),
j AS (SELECT *, CASE WHEN alike THEN mm ELSE m END >= {uf.MIN_LABELLED}
  AND (CASE WHEN alike THEN mb ELSE b END + {uf.SMOOTHING * uf.PRIOR}) / (CASE WHEN alike THEN mm ELSE m END + {uf.SMOOTHING}) >= {uf.PURITY} AS rejected FROM tm)"""
    if templates:
        return sql + """
SELECT host, template, n::BIGINT AS n, b::BIGINT AS n_block, (m - b)::BIGINT AS n_allow, rejected FROM j
"""
    return sql + """,
badsegs AS (SELECT DISTINCT c.host, c.segs FROM c JOIN (SELECT host, template FROM j WHERE rejected) USING (host, template))
SELECT page_id, base.host, path, rule, coalesce(action, CASE WHEN badsegs.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM base LEFT JOIN badsegs ON base.host = badsegs.host AND base.segs = badsegs.segs
"""


def _op9() -> str:
    """Without seeds: agreeing tokens by document, item and shift, and the best window that begins at one of them.

    A window that reaches beyond what both texts have is the same as the last one inside, which holds all its matches.
    """
    toks = lambda t: f"list_filter(string_split(trim(regexp_replace(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {toks("text")} AS h FROM documents), b AS (SELECT row_number() OVER () AS q, item_id, {toks("text")} AS h FROM benchmark),
dt AS (SELECT r, doc_id, len(h) AS dn, unnest(h) AS tok, generate_subscripts(h, 1) AS dp FROM d), bt AS (SELECT q, item_id, len(h) AS bn, unnest(h) AS tok, generate_subscripts(h, 1) AS bp FROM b),
m AS (SELECT r, q, doc_id, item_id, dp - bp AS shift, bp, least({dc.WINDOW}, bn) AS n, least(bn, dn - (dp - bp)) - greatest(0, bp - dp) AS common FROM dt JOIN bt USING (tok)),
w AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY r, q, shift ORDER BY bp RANGE BETWEEN CURRENT ROW AND {dc.WINDOW - 1} FOLLOWING) AS matched FROM m WHERE common >= n)
SELECT doc_id, item_id, max(matched)::INTEGER AS matched FROM w WHERE matched >= ceil({dc.SHARE} * n) GROUP BY doc_id, item_id
"""


def _op11(least: int = cl.LEAST) -> str:
    """All phrases of all pieces, counted; every cut of the frequent ones."""
    breaks = "[.,;:!?\\x0A-\\x0D]"
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '{breaks}')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws[i : i + k - 1] AS ph FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), (SELECT unnest(range(1, {cl.MOST_WORDS + 1})) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, ph, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {least}),
parts AS (SELECT lang, a, ph, len(ph) AS k, i, j, ph[i : j] AS sub FROM f, (SELECT unnest(range(1, {cl.MOST_WORDS + 1})) AS i), (SELECT unnest(range(1, {cl.MOST_WORDS + 1})) AS j) WHERE len(ph) > 1 AND j <= len(ph) AND i <= j AND j - i + 1 < len(ph)),
inside AS (SELECT lang, sub AS ph, max(a) AS longer FROM parts GROUP BY ALL),
cuts AS (SELECT x.lang, x.ph, x.a, x.j AS cut, fl.a AS l, fr.a AS r, n.n, (1000::HUGEINT * x.a * n.n // (fl.a::HUGEINT * fr.a))::BIGINT AS score
  FROM parts x JOIN parts y ON x.lang = y.lang AND x.ph = y.ph AND x.i = 1 AND y.j = y.k AND y.i = x.j + 1
  JOIN f fl ON fl.lang = x.lang AND fl.ph = x.sub JOIN f fr ON fr.lang = x.lang AND fr.ph = y.sub JOIN n ON n.lang = x.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, ph) WHERE longer IS NULL OR longer < a),
ranked AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked QUALIFY rank <= {cl.MOST_RANK}
"""


def _op12() -> str:
    """Every kept term of every group, zeros spelled out."""
    p = lambda c, n: f"(1 + {dv.SCALE}::HUGEINT * ({c} + {dv.SMOOTHING}) // ({n} + {dv.SMOOTHING} * v))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, {_q(dv.TERM)})) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {dv.LEAST_DOCS}),
l AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS ln FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS gn, any_value(v) AS v, any_value(ln) AS ln FROM (SELECT DISTINCT lang, source FROM d) JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "gn")} AS p, {p("k.n", "ln")} AS lp FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - lp) * (p - lp) // lp)::BIGINT FROM s WHERE n > 0 AND p > lp),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {dv.MOST_TERMS}
"""


ORACLE: dict[str, str] = {
    "op3_url_filter": _op3(),
    "op3_url_templates": _op3(templates=True),
    "op5_license_scan": OP5,
    "op9_decontaminate": _op9(),
    "op10_exact_dedup": OP10,
    "op11_collocations": _op11(),
    "op12_source_divergence": _op12(),
}
