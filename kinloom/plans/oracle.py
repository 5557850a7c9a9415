"""DuckDB twins of the operators, as pieces of SQL over the people view; they share nothing with the Spark code but the fixed values."""

from __future__ import annotations

from ..functions.tables import (
    BLOCKED_BOTH,
    BLOCKED_COMPANY,
    BLOCKED_EMAIL,
    CITY_COUNTRY,
    CITY_NAMES,
    DOTLESS_DOMAINS,
    FIELD_LABELS,
    FIELD_WEIGHTS,
    HONORIFICS,
    LEGAL_FORMS,
    MAX_BUCKET,
    NAME_SUFFIXES,
    PERSONAL_DOMAINS,
    TITLE_ROLES,
    TITLE_WORDS,
)
from .people import PEOPLE_SQL


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def mapping(values: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{strings([k])}: {strings([v])}' for k, v in values.items())}}}"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


FLAT = "|".join(sorted({x.replace(" ", "") for x in LEGAL_FORMS}, key=len, reverse=True))
SMALL_WORDS = {"of", "the", "to", "for", "at", "a", "an"}
#: The roles' titles in the form that cleaning leaves; of equal forms the last one's role, and by sorted parts the first one's.
EXACT = {" ".join(x for w in k.split() for x in TITLE_WORDS.get(w, w).split() if x not in SMALL_WORDS): v for k, v in TITLE_ROLES.items()}
PARTS = {" and ".join(sorted(k.split(" and "))): v for k, v in reversed(EXACT.items())}


def _key(x: str, turns: int = 5) -> str:
    for _ in range(turns):
        x = rf"regexp_replace({x}, '^(.{{3,}}?)(?:{FLAT})$', '\1')"
    return x


EMAIL = rf"""
  mail0 AS (SELECT *, regexp_replace(lower(trim(trim(email), '<>')), '\s+', '', 'g') AS m0 FROM people),
  mail1 AS (SELECT *, split_part(m0, '@', 2) AS dom, regexp_replace(split_part(m0, '@', 1), '\+.*$', '') AS loc0, len(string_split(m0, '@')) AS parts FROM mail0),
  mail2 AS (SELECT *, CASE WHEN dom IN ({strings(DOTLESS_DOMAINS)}) THEN replace(loc0, '.', '') ELSE loc0 END AS loc1 FROM mail1),
  mailed AS (SELECT * EXCLUDE (m0, loc0, loc1, parts, dom), CASE WHEN parts = 2 AND contains(dom, '.') AND loc1 != '' THEN loc1 END AS mail_local,
    CASE WHEN parts = 2 AND contains(dom, '.') AND loc1 != '' THEN loc1 || '@' || dom END AS mail, CASE WHEN parts = 2 AND contains(dom, '.') AND loc1 != '' THEN dom IN ({strings(PERSONAL_DOMAINS)}) END AS personal FROM mail2)"""
COMPANY = rf"""
  comp0 AS (SELECT *, trim(regexp_replace(replace(lower(regexp_replace(nullif(company, ''), '\([^)]*\)', ' ', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS c0 FROM mailed),
  comp1 AS (SELECT * EXCLUDE (c0), nullif(trim(regexp_replace(regexp_replace(c0, '(?: (?:{"|".join(LEGAL_FORMS)}))+$', ''), '(?:(?:^| )(?:and|the))+$', '')), '') AS canonical FROM comp0),
  companied AS (SELECT *, {_key("replace(canonical, ' ', '')")} AS ckey FROM comp1)"""
SLUG = r"""
  slug0 AS (SELECT *, lower(trim(nullif(linkedin_url, ''))) AS l0 FROM companied),
  slugged AS (SELECT * EXCLUDE (l0), nullif(CASE WHEN regexp_matches(l0, 'linkedin\.com/(?:in|pub)/[^/?#]+') THEN regexp_extract(l0, 'linkedin\.com/(?:in|pub)/([^/?#]+)', 1)
    WHEN NOT contains(l0, '/') AND NOT contains(l0, 'linkedin') THEN regexp_replace(l0, '[?#].*$', '') END, '') AS slug FROM slug0)"""
TITLE = rf"""
  title0 AS (SELECT *, trim(regexp_replace(replace(lower(regexp_replace(nullif(title, ''), '(?i)\([^)]*\)|\b(interim|acting|contract)\b', ' ', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS t0 FROM slugged),
  title1 AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(t0, '\bv p\b', 'vice president', 'g'), ' '), lambda w: coalesce({mapping(TITLE_WORDS)}[w], w)), ' ') AS t1 FROM title0),
  title2 AS (SELECT * EXCLUDE (t0, t1), nullif({squeeze(r"regexp_replace(t1, '\b(of|the|to|for|at|a|an)\b', ' ', 'g')")}, '') AS title_clean FROM title1),
  titled AS (SELECT *, coalesce({mapping(EXACT)}[title_clean], {mapping(PARTS)}[array_to_string(list_sort(string_split(title_clean, ' and ')), ' and ')], replace(title_clean, ' ', '_')) AS role FROM title2)"""
NAME = rf"""
  name0 AS (SELECT *, list_filter(list_transform(string_split({squeeze("lower(regexp_replace(nullif(full_name, ''), '[^a-zA-Z\\s''-]', ' ', 'g'))".replace(chr(92) * 2, chr(92)))}, ' '), lambda t: trim(t, '''-')),
    lambda t: t != '' AND t NOT IN ({strings(HONORIFICS + NAME_SUFFIXES)})) AS toks FROM titled),
  named AS (SELECT * EXCLUDE (toks), CASE WHEN len(toks) > 0 THEN array_to_string(toks, ' ') END AS nname, toks[1] AS fname, CASE WHEN len(toks) > 1 THEN toks[-1] END AS lname, list_sort(list_distinct(toks)) AS tokens FROM name0)"""
PLACE = rf"""
  place0 AS (SELECT *, list_filter(list_transform(string_split({squeeze("nullif(location, '')")}, ','), lambda x: trim(x)), lambda x: x != '') AS lp FROM named),
  place1 AS (SELECT *, coalesce({mapping(CITY_NAMES)}[lower(lp[1])], lower(lp[1])) AS city FROM place0),
  placed AS (SELECT * EXCLUDE (lp), coalesce({mapping(CITY_COUNTRY)}[city], lp[2]) AS country FROM place1)"""
LISTS = r"""
  listed AS (SELECT * REPLACE (CASE WHEN needs IS NULL THEN []::VARCHAR[] WHEN needs LIKE '[%' THEN list_filter(from_json(needs, '["VARCHAR"]'), lambda x: trim(x) != '') WHEN trim(needs) != '' THEN [needs] ELSE []::VARCHAR[] END AS needs,
    CASE WHEN offers IS NULL THEN []::VARCHAR[] WHEN offers LIKE '[%' THEN list_filter(from_json(offers, '["VARCHAR"]'), lambda x: trim(x) != '') WHEN trim(offers) != '' THEN [offers] ELSE []::VARCHAR[] END AS offers) FROM placed)"""


def present(f: str) -> str:
    return "(len(needs) > 0 OR len(offers) > 0)" if f == "needs_offers" else f"coalesce(trim({f}) != '', false)"


POINTS = " + ".join(f"CASE WHEN {present(f)} THEN {w} ELSE 0 END" for f, w in FIELD_WEIGHTS.items())
MISSING = "list_filter([" + ", ".join(f"CASE WHEN NOT {present(f)} THEN '{f}' END" for f in FIELD_WEIGHTS) + "], lambda x: x IS NOT NULL)"
NORM = f"""people AS ({PEOPLE_SQL}),{EMAIL},{COMPANY},{SLUG},{TITLE},{NAME},{PLACE},{LISTS},
  norm AS (SELECT *, ({POINTS}) / 100.0::DOUBLE AS score, {MISSING} AS missing,
    CASE WHEN NOT {present("email")} AND NOT {present("company")} THEN {strings([BLOCKED_BOTH])} WHEN NOT {present("email")} THEN {strings([BLOCKED_EMAIL])}
      WHEN NOT {present("company")} THEN {strings([BLOCKED_COMPANY])} END AS blocked_reason FROM listed)"""
SUMMARY = f"CASE WHEN len(missing) = 0 THEN 'Complete' ELSE 'Missing ' || array_to_string(list_transform(missing, lambda f: {mapping(FIELD_LABELS)}[f]), ', ') END"

KEYS = f"""{NORM},
  keyed AS (SELECT id, unnest(list_filter(['li:' || slug, 'em:' || mail_local, 'co:' || ckey || '|' || lname, 'nl:' || substr(lname, 1, 3) || '|' || city, 'nm:' || fname], lambda k: k IS NOT NULL)) AS key FROM norm),
  sizes AS (SELECT key, split_part(key, ':', 1) AS type, count(*) AS size FROM keyed GROUP BY key HAVING count(*) > 1),
  cand AS (SELECT x.id AS a, y.id AS b, list_sort(list(DISTINCT split_part(key, ':', 1))) AS keys FROM keyed x JOIN keyed y USING (key) JOIN sizes USING (key) WHERE x.id < y.id AND size <= {MAX_BUCKET} GROUP BY 1, 2)"""


# a table of distinct string pairs (x, y) with their longest common subsequence, by recursion over the characters of y
def lcs_table(pairs: str) -> str:
    """CTE bodies: lcs_of(x, y, n) for the distinct pairs of a query with columns x, y."""
    return f"""lp AS (SELECT DISTINCT x, y FROM ({pairs}) WHERE x != '' AND y != ''),
  lw AS (SELECT x, y, 0 AS i, list_transform(range(length(x) + 1), lambda z: 0::BIGINT) AS prev FROM lp
    UNION ALL SELECT x, y, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(x) + 1), lambda j: [j])),
      lambda row, j: list_append(row, greatest(row[-1], prev[j[1] + 1], prev[j[1]] + CASE WHEN substr(x, j[1], 1) = substr(y, i + 1, 1) THEN 1 ELSE 0 END))) FROM lw WHERE i < length(y)),
  lcs_of AS (SELECT x, y, prev[-1] AS n FROM lw WHERE i = length(y))"""


SIDES = """sides AS (SELECT c.a, c.b, c.keys, x.mail AS am, y.mail AS bm, x.slug AS asl, y.slug AS bsl, x.nname AS an, y.nname AS bn, x.fname AS af, y.fname AS bf, x.lname AS al, y.lname AS bl,
    x.tokens AS ta, y.tokens AS tb, x.ckey AS ac, y.ckey AS bc, x.role AS ar, y.role AS br FROM cand c JOIN norm x ON x.id = c.a JOIN norm y ON y.id = c.b),
  settled AS (SELECT *, CASE WHEN am = bm THEN 'exact_email' WHEN asl = bsl THEN 'exact_linkedin' END AS exact FROM sides),
  toks AS (SELECT *, list_sort(list_intersect(ta, tb)) AS i, list_sort(list_filter(ta, lambda t: NOT list_contains(tb, t))) AS da, list_sort(list_filter(tb, lambda t: NOT list_contains(ta, t))) AS db FROM settled WHERE exact IS NULL),
  joined AS (SELECT *, array_to_string(da, ' ') AS sa, array_to_string(db, ' ') AS sb, length(array_to_string(i, ' ')) AS n, CASE WHEN len(i) > 0 THEN 1 ELSE 0 END AS g FROM toks)"""


def fits(x: str, y: str) -> str:
    return f"({x} = {y} OR (length({x}) = 1 AND starts_with({y}, {x})) OR (length({y}) = 1 AND starts_with({x}, {y})))"


SCORED = f"""{KEYS},
  {SIDES},
  {lcs_table("SELECT sa AS x, sb AS y FROM joined UNION SELECT ac, bc FROM joined WHERE ac IS NOT NULL AND bc IS NOT NULL")},
  based AS (SELECT j.*, CASE WHEN an IS NULL OR bn IS NULL THEN 0.0 WHEN g = 1 AND (sa = '' OR sb = '') THEN 100.0
      ELSE greatest(100.0 * (1 - (length(sa) + length(sb) - 2.0 * coalesce(l.n, 0)) / (2 * (j.n + g) + length(sa) + length(sb))),
        CASE WHEN g = 1 THEN 100.0 * (1 - (1.0 + length(sa)) / (2 * j.n + 1 + length(sa))) ELSE 0 END, CASE WHEN g = 1 THEN 100.0 * (1 - (1.0 + length(sb)) / (2 * j.n + 1 + length(sb))) ELSE 0 END) END::DOUBLE AS base,
    CASE WHEN ac IS NOT NULL AND bc IS NOT NULL THEN 200.0 * coalesce(m.n, 0) / (length(ac) + length(bc)) END::DOUBLE AS comp, ar = br AS agrees
    FROM joined j LEFT JOIN lcs_of l ON l.x = sa AND l.y = sb LEFT JOIN lcs_of m ON m.x = ac AND m.y = bc),
  lifted AS (SELECT *, CASE WHEN coalesce({fits("af", "bf")} AND {fits("al", "bl")} AND NOT (af = bf AND al = bl), false) THEN greatest(base, 95.0) ELSE base END AS nm FROM based),
  blended AS (SELECT *, CASE WHEN comp IS NULL THEN least(nm, 91.0) ELSE 0.65 * nm + 0.35 * comp END + CASE WHEN agrees THEN 3.0 WHEN NOT agrees THEN -2.0 ELSE 0.0 END AS raw FROM lifted),
  capped AS (SELECT *, CASE WHEN comp IS NULL OR nm < 90 THEN least(raw, 91.0) ELSE raw END AS cap FROM blended),
  vetoed AS (SELECT *, coalesce(NOT agrees, false) AND cap >= 92 AS veto FROM capped),
  scored AS (SELECT *, round(greatest(0.0, least(100.0, CASE WHEN veto THEN greatest(78.0, least(cap, 91.0)) ELSE cap END))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS score FROM vetoed)"""
ROUTED = f"""{SCORED},
  routed AS (SELECT a, b, keys, 'deterministic' AS stage, exact AS method, 'same_person' AS verdict, 'auto_merged' AS review_state, 100.0::DOUBLE AS score FROM settled WHERE exact IS NOT NULL
    UNION ALL SELECT a, b, keys, 'fuzzy', CASE WHEN score >= 92 THEN 'fuzzy_auto' ELSE 'escalated_not_adjudicated' END, CASE WHEN score >= 92 THEN 'same_person' ELSE 'insufficient_evidence' END,
      CASE WHEN score >= 92 THEN 'auto_merged' ELSE 'pending' END, score FROM scored WHERE score >= 78)"""


def closure(edges: str, name: str = "member") -> str:
    """CTE bodies: name(id, cluster) for a query with columns a, b."""
    return f"""{name}_ed AS ({edges}), {name}_both AS (SELECT a, b FROM {name}_ed UNION SELECT b, a FROM {name}_ed),
  {name}_reach AS (SELECT a AS id, a AS r FROM {name}_both UNION SELECT x.id, e.b FROM {name}_reach x JOIN {name}_both e ON e.a = x.r),
  {name} AS (SELECT id, min(r) AS cluster FROM {name}_reach GROUP BY id)"""


MERGE_EDGES = "SELECT a, b FROM routed WHERE review_state = 'auto_merged'"
CLUSTERED = f"{ROUTED}, {closure(MERGE_EDGES)}"
