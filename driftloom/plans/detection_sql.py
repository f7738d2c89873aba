"""DuckDB SQL of personal data and drift detection, as CTEs over relations of cells
(seq, path, kind, text): the whole rules again, in another engine's terms."""

from __future__ import annotations

from driftloom.functions import pii, types
from driftloom.plans.fixtures import SEMANTIC

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_pairs = lambda a, b, ps: "(" + " OR ".join(f"({a} = '{x}' AND {b} = '{y}')" for x, y in ps) + ")"
_words = lambda words: rf"'(?:^|[._\[\]])(?:{'|'.join(words)})(?:[._\[\]]|$)'"
#: P(chi-square of 1 degree >= x), by the series of the lower gamma function.
_tail = lambda x: f"CASE WHEN ({x}) <= 0 THEN 1.0 WHEN ({x}) > 57 THEN 0.0 ELSE 1 - list_sum(list_transform(range(0, 400), lambda n: exp(-({x})/2 + (0.5+n)*ln(({x})/2) - lgamma(1.5+n)))) END"
_octet = lambda k: f"coalesce(try_cast(regexp_extract(text, {_quote(pii.IP)}, {k}) AS INT), 999)"
_HINTS = ", ".join(f"('{c}', '{h}')" for c, hs in pii.NAME_HINTS.items() for h in hs)
_SHOWS = {
    "email": f"regexp_matches(text, {_quote(pii.EMAIL)})",
    "phone": "(" + " OR ".join(f"regexp_matches(text, {_quote(p)})" for p in pii.PHONES) + ")",
    "passport": f"regexp_matches(text, {_quote(pii.PASSPORT)})",
    "card_number": f"(regexp_matches(text, {_quote(pii.CARD)}) AND NOT (regexp_matches(lower(path), {_words(pii.ID_WORDS)}) AND NOT regexp_matches(lower(path), {_words(pii.CARD_WORDS)})))",
    "ip_address": f"(regexp_matches(text, {_quote(pii.IP)}) AND greatest({', '.join(map(_octet, (1, 2, 3, 4)))}) <= 255 AND ({_octet(1)} IN (10, 127) OR ({_octet(1)} = 172 AND {_octet(2)} BETWEEN 16 AND 31) OR ({_octet(1)} = 192 AND {_octet(2)} = 168) OR ({_octet(1)} = 169 AND {_octet(2)} = 254) OR greatest({', '.join(map(_octet, (1, 2, 3, 4)))}) > 100))",
    "date_of_birth": f"(regexp_matches(text, {_quote(pii.DOB)}) AND regexp_matches(lower(path), '{'|'.join(pii.DOB_WORDS)}'))",
    "national_id": f"(regexp_matches(text, {_quote(pii.SSN)}) OR regexp_matches(text, {_quote(pii.AADHAAR)}))",
}


def personal(p: str, paths: str, strings: str) -> str:
    """CTE {p}_pii (path, category, confidence, source) of the fields in ``paths`` (path)
    with their first ``strings`` (path, text)."""
    shows = " UNION ALL ".join(f"SELECT DISTINCT path, '{c}' AS category FROM {strings} WHERE {cond}" for c, cond in _SHOWS.items())
    return f"""{p}_name AS (SELECT DISTINCT path, category FROM (SELECT DISTINCT path FROM {paths}), (VALUES {_HINTS}) h(category, hint)
  WHERE CASE WHEN length(hint) <= 4 THEN list_contains(string_split_regex(lower(path), '[.\\[\\]]'), hint) ELSE contains(lower(path), hint) END),
{p}_shows AS ({shows}),
{p}_uuids AS (SELECT path FROM {strings} WHERE regexp_matches(lower(path), {_words(pii.ID_WORDS)}) GROUP BY path HAVING bool_and(regexp_matches(text, {_quote(types.UUID)}))),
{p}_pii AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.category, b.category) AS category,
    CASE WHEN b.path IS NULL THEN {pii.NAME_ONLY} WHEN a.path IS NULL THEN {pii.PATTERN_ONLY} ELSE {pii.BOTH} END::DOUBLE AS confidence, CASE WHEN b.path IS NULL THEN 'name_hint' WHEN a.path IS NULL THEN 'pattern' ELSE 'both' END AS source
  FROM {p}_name a FULL JOIN {p}_shows b ON a.path = b.path AND a.category = b.category WHERE coalesce(a.path, b.path) NOT IN (SELECT path FROM {p}_uuids))"""


def side(p: str, cells: str, n: str) -> str:
    """CTEs of what is observed in ``cells``, of ``n`` events: {p}_p (path, k, presence,
    ty), {p}_h (path, t, c) of the first 200 values, {p}_pii."""
    return f"""{p}_v AS (SELECT path, kind, text, {SEMANTIC} AS t, row_number() OVER (PARTITION BY path ORDER BY seq) AS nth FROM {cells} WHERE kind <> 'null'),
{p}_p AS (SELECT path, k, k / {n} AS presence, coalesce(ty, 'null') AS ty FROM (SELECT path, count(*) AS k FROM {cells} GROUP BY path) LEFT JOIN (SELECT path, CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE 'mixed' END AS ty FROM {p}_v WHERE nth <= 50 GROUP BY path) USING (path)),
{p}_h AS (SELECT path, t, count(*) AS c FROM {p}_v WHERE nth <= 200 GROUP BY ALL),
{p}_s AS (SELECT path, text FROM {p}_v WHERE nth <= {pii.FIRST} AND kind = 'string'),
{personal(p, cells, f"{p}_s")}"""


def drift(p: str, base: str, seen: str, cells: str, base_cells: str, n: str, enums: bool = True, family: str = "tested") -> str:
    """CTE {p}_found from two sides' prefixes; ``cells`` are the observed ones."""
    stamps = "(old_type LIKE 'timestamp_%' AND new_type LIKE 'timestamp_%')"
    wider = _pairs("old_type", "new_type", types.WIDENING)
    quiet = f"(SELECT coalesce(sum((stays AND total >= 30 AND NOT moved)::INT + (stays AND changed AND n >= 5 AND NOT type_hit)::INT), 0) FROM {p}_m)" if family == "tested" else "0"
    gone = "(before >= 0.8 AND after < 0.2)"
    return f"""{p}_enum AS (SELECT path, list_sort(list(DISTINCT text)) AS enum FROM {base_cells} WHERE kind = 'string' AND {str(enums).lower()} GROUP BY path HAVING count(DISTINCT text) <= 15),
{p}_novel AS (SELECT path, avg((NOT list_contains(enum, text))::INT) AS novel, list_sort(list(DISTINCT text))[1:50] AS new_enum FROM {cells} JOIN {p}_enum USING (path) WHERE kind <> 'null' GROUP BY path),
{p}_j AS (SELECT coalesce(b.path, o.path) AS path, b.path IS NOT NULL AS known, b.presence AS before, coalesce(o.presence, 0) AS after, {n} AS total, coalesce(o.k, 0) AS k, b.ty AS old_type, o.ty AS new_type,
    (SELECT coalesce(sum(c), 0) FROM {seen}_h h WHERE h.path = coalesce(b.path, o.path)) AS n, (SELECT coalesce(sum(c), 0) FROM {seen}_h h WHERE h.path = b.path AND h.t <> b.ty) AS off,
    (SELECT count(*) FROM {seen}_pii x WHERE x.path = o.path AND x.category NOT IN (SELECT category FROM {base}_pii y WHERE y.path = x.path)) AS extra, (SELECT count(*) FROM {seen}_pii x WHERE x.path = o.path) AS personal
  FROM {base}_p b FULL JOIN {seen}_p o ON b.path = o.path),
{p}_z AS (SELECT *, CASE WHEN before <= 0 OR before >= 1 THEN CASE WHEN after = before THEN 1.0 ELSE 0.0 END ELSE {_tail("(after-before)*(after-before)/(before*(1-before)/total)")} END AS zp,
    CASE WHEN n >= 5 AND off > 0 THEN {_tail("off*off/n + (off-0.5)*(off-0.5)/0.5")} WHEN n >= 5 THEN 1.0 END AS tp FROM {p}_j),
{p}_m AS (SELECT z.*, novel, new_enum, enum, known AND after < 0.05 AND before >= 0.2 AS removed, known AND NOT (after < 0.05 AND before >= 0.2) AS stays, NOT known AND after >= 0.05 AS fresh,
    coalesce(CASE WHEN total >= 30 THEN zp < 0.01 ELSE abs(after - before) > CASE WHEN before < 0.8 THEN 0.3 ELSE 0.15 END END, false) AS moved,
    coalesce(new_type <> old_type AND new_type <> 'null' AND old_type <> 'null' AND NOT {_pairs("old_type", "new_type", types.REFINEMENTS)}, false) AS changed,
    coalesce(new_type <> old_type AND new_type <> 'null' AND old_type <> 'null' AND NOT {_pairs("old_type", "new_type", types.REFINEMENTS)} AND CASE WHEN n >= 5 THEN tp < 0.01 ELSE off / n > 0.05 END, false) AS type_hit
  FROM {p}_z z LEFT JOIN {p}_novel USING (path) LEFT JOIN {p}_enum USING (path)),
{p}_f AS (SELECT *, 'field_removed' AS drift_type, CASE WHEN total >= 30 THEN zp END AS p FROM {p}_m WHERE removed
  UNION ALL SELECT *, CASE WHEN after < before THEN 'presence_drop' ELSE 'presence_increase' END, CASE WHEN total >= 30 THEN zp END FROM {p}_m WHERE stays AND moved
  UNION ALL SELECT *, 'type_changed', tp FROM {p}_m WHERE stays AND type_hit UNION ALL SELECT *, 'enum_changed', NULL FROM {p}_m WHERE stays AND novel >= 0.05
  UNION ALL SELECT *, 'new_pii', NULL FROM {p}_m WHERE (stays OR fresh) AND extra > 0 UNION ALL SELECT *, 'field_added', NULL FROM {p}_m WHERE fresh AND personal = 0),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL ORDER BY p, path, drift_type) AS rk, count(*) OVER (PARTITION BY p IS NULL) + {quiet} AS family FROM {p}_f),
{p}_a AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(p * family / rk) OVER (PARTITION BY p IS NULL ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_adjusted FROM {p}_r),
{p}_found AS (SELECT path, drift_type, before, after, old_type, new_type,
  (CASE drift_type WHEN 'field_added' THEN CASE WHEN after < 0.5 THEN 1 ELSE 2 END WHEN 'field_removed' THEN CASE WHEN {gone} OR before - after > 0.5 THEN 3 ELSE 2 END WHEN 'presence_drop' THEN CASE WHEN {gone} THEN 3 ELSE 2 END
    WHEN 'presence_increase' THEN 1 WHEN 'type_changed' THEN CASE WHEN {stamps} OR {wider} THEN 2 ELSE 3 END WHEN 'enum_changed' THEN 2 WHEN 'new_pii' THEN 3 ELSE 2 END)::INT AS tier,
  CASE drift_type WHEN 'field_added' THEN CASE WHEN after < 0.5 THEN 'evolution' ELSE 'drift' END WHEN 'type_changed' THEN CASE WHEN {stamps} OR {wider} THEN 'evolution' ELSE 'drift' END
    WHEN 'enum_changed' THEN CASE WHEN len(list_filter(enum, lambda v: NOT list_contains(new_enum, v))) > 0 THEN 'drift' ELSE 'evolution' END WHEN 'presence_increase' THEN 'evolution' ELSE 'drift' END AS class
  FROM {p}_a WHERE p IS NULL OR p_adjusted < 0.01)"""


#: Both halves of the varied events, and the drift between them.
HALVES = ", bc AS (SELECT * FROM cells WHERE half = 'baseline'), oc AS (SELECT * FROM cells WHERE half = 'observed'), bn AS (SELECT count(*) AS n FROM ev WHERE half = 'baseline'), n_o AS (SELECT count(*) AS n FROM ev WHERE half = 'observed'), " + side("b", "bc", "(SELECT n FROM bn)") + ", " + side("o", "oc", "(SELECT n FROM n_o)")
DRIFT = HALVES + ", " + drift("d", "b", "o", "oc", "bc", "(SELECT n FROM n_o)")
