"""Named queries over the driver's tables, each with its DuckDB twin.

Entity queries run on the people view (see people.py). Arrays come out as joined texts, so that values compare alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity, text
from ..functions.tables import INITIAL_SCORE, REASONS
from ..operators import blocking, cascade, decisions, enrichment, evaluate, matching, rubric, survivorship
from ..operators.records import describe_gaps, histogram, normalize_records
from ..operators.shared import connected_components, materialize, numbered
from ..sources import answers, layers
from . import oracle as O  # noqa: N812
from . import reports
from .people import people, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def whole_counts(sql: str) -> str:
    """count_if(x) as a filtered count, which is a BIGINT in DuckDB."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = whole_counts(sql)
        return f

    return add


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized layer; both it and the records are tables, as in a real run."""
    return materialize(normalize_records(materialize(people(spark, sf_dir), "people")), "records")


def joined(c: str, sep: str = "|"):
    return F.array_join(c, sep)


# --- normalizers -----------------------------------------------------------------------------------------------------


@query(f"WITH {O.NORM} SELECT id, mail AS normalized, mail_local AS local, personal AS is_personal FROM norm")
def norm_email(spark, sf_dir):
    return norm(spark, sf_dir).select("id", "mail.normalized", "mail.local", "mail.is_personal")


@query(f"WITH {O.NORM} SELECT id, canonical, ckey AS company_key FROM norm")
def norm_company(spark, sf_dir):
    return norm(spark, sf_dir).select("id", F.col("company_canonical").alias("canonical"), "company_key")


@query(f"WITH {O.NORM} SELECT id, slug FROM norm")
def norm_slug(spark, sf_dir):
    return norm(spark, sf_dir).select("id", "slug")


@query(f"WITH {O.NORM} SELECT id, title_clean, role FROM norm")
def norm_title(spark, sf_dir):
    return norm(spark, sf_dir).select("id", "title_clean", F.col("title_canonical").alias("role"))


@query(f"WITH {O.NORM} SELECT id, nname AS normalized, fname AS first, lname AS last, array_to_string(tokens, '|') AS tokens FROM norm")
def norm_name(spark, sf_dir):
    return norm(spark, sf_dir).select("id", "name.normalized", "name.first", "name.last", F.array_join("name.tokens", "|").alias("tokens"))


@query(f"WITH {O.NORM} SELECT id, city, country FROM norm")
def norm_location(spark, sf_dir):
    return norm(spark, sf_dir).select("id", "place.city", "place.country")


@query(f"WITH {O.NORM} SELECT id, array_to_string(needs, '|') AS needs, array_to_string(offers, '|') AS offers, len(offers) AS n_offers FROM norm")
def json_list_parse(spark, sf_dir):
    return norm(spark, sf_dir).select("id", joined("needs").alias("needs"), joined("offers").alias("offers"), F.size("offers").cast("long").alias("n_offers"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g'))) AS folded FROM documents")
def fold_match_text(spark, sf_dir):
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.md5(N.match_text(F.col("text"))).alias("folded"))


# --- completeness ----------------------------------------------------------------------------------------------------


@query(f"WITH {O.NORM} SELECT id, score, array_to_string(missing, '|') AS missing, blocked_reason IS NOT NULL AS blocked, blocked_reason, {O.SUMMARY} AS summary FROM norm")
def completeness_score(spark, sf_dir):
    c = F.col("completeness")
    return norm(spark, sf_dir).select("id", c["score"].alias("score"), F.array_join(c["missing"], "|").alias("missing"), c["blocked"].alias("blocked"), c["blocked_reason"].alias("blocked_reason"), describe_gaps(c["missing"]).alias("summary"))


@query(f"""WITH {O.NORM}, b AS (SELECT CASE WHEN score >= 1 THEN '1.00' WHEN score >= 0.8 THEN '0.80-0.99' WHEN score >= 0.6 THEN '0.60-0.79' WHEN score >= 0.4 THEN '0.40-0.59' ELSE '< 0.40' END AS bucket FROM norm)
SELECT bucket, count(b.bucket) AS n FROM (SELECT unnest(['1.00', '0.80-0.99', '0.60-0.79', '0.40-0.59', '< 0.40']) AS bucket) LEFT JOIN b USING (bucket) GROUP BY bucket""")
def completeness_hist(spark, sf_dir):
    return histogram(norm(spark, sf_dir))


# --- blocking and scoring --------------------------------------------------------------------------------------------


@query(f"WITH {O.KEYS} SELECT a, b, array_to_string(keys, '|') AS keys FROM cand")
def block_pairs(spark, sf_dir):
    return blocking.candidates(norm(spark, sf_dir)).select("a", "b", joined("keys").alias("keys"))


@query(f"WITH {O.KEYS} SELECT type, sum(size * (size - 1) // 2)::BIGINT AS pairs FROM sizes WHERE size <= 40 GROUP BY type")
def block_key_counts(spark, sf_dir):
    return blocking.key_counts(norm(spark, sf_dir))


@query(f"WITH {O.KEYS} SELECT key, size FROM sizes WHERE size > 40")
def block_skipped(spark, sf_dir):
    return blocking.skipped(norm(spark, sf_dir))


SMALL_CAP = 10


@query(f"WITH {O.KEYS} SELECT key, size FROM sizes WHERE size > {SMALL_CAP}")
def block_skipped_small(spark, sf_dir):
    """With a cap that buckets of the smallest tables exceed too."""
    return blocking.skipped(norm(spark, sf_dir), SMALL_CAP)


@query(f"WITH {O.KEYS.replace(f'size <= {O.MAX_BUCKET} GROUP', f'size <= {SMALL_CAP} GROUP')} SELECT a, b, array_to_string(keys, '|') AS keys FROM cand")
def block_pairs_small(spark, sf_dir):
    return blocking.candidates(norm(spark, sf_dir), SMALL_CAP).select("a", "b", joined("keys").alias("keys"))


@query(f"WITH {O.KEYS}, {O.SIDES} SELECT a, b, exact AS method FROM settled WHERE exact IS NOT NULL")
def exact_match_pairs(spark, sf_dir):
    n = norm(spark, sf_dir)
    return cascade.scored(n, blocking.candidates(n))[0].select("a", "b", F.col("exact").alias("method"))


@query(f"WITH RECURSIVE {O.SCORED} SELECT a, b, round(nm::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS name_sim, round(comp::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS company_sim, agrees AS title_agrees, veto AS title_vetoed, score FROM scored")
def fuzzy_blend_veto(spark, sf_dir):
    n = norm(spark, sf_dir)
    rows = cascade.scored(n, blocking.candidates(n))[1]
    return rows.select("a", "b", F.round("name_sim", 2).alias("name_sim"), F.round("company_sim", 2).alias("company_sim"), "title_agrees", "title_vetoed", "score")


@query(f"WITH RECURSIVE {O.ROUTED} SELECT a, b, stage, method, verdict, review_state, score, array_to_string(keys, '|') AS keys FROM routed")
def cascade_route(spark, sf_dir):
    n = norm(spark, sf_dir)
    return cascade.route(n, blocking.candidates(n)).select("a", "b", "stage", "method", "verdict", "review_state", "score", joined("keys").alias("keys"))


VERDICTS = "CASE WHEN CAST(substr(a, 3) AS BIGINT) % 4 = 0 THEN NULL WHEN CAST(substr(a, 3) AS BIGINT) % 4 = 1 THEN 'same_person' WHEN CAST(substr(a, 3) AS BIGINT) % 4 = 2 THEN 'different_people' ELSE 'insufficient_evidence' END"


def verdicts_of(pairs: DataFrame) -> DataFrame:
    """Cached answers for the tests' pairs, by a rule on the id; every fourth pair has none."""
    return pairs.select("a", "b", F.expr(VERDICTS).alias("verdict"), F.lit(0.9).alias("confidence"), F.lit("by rule").alias("reason")).filter("verdict IS NOT NULL")


@query(f"""WITH RECURSIVE {O.SCORED}, v AS (SELECT a, b, score, {VERDICTS} AS v FROM scored WHERE score >= 78 AND score < 92)
SELECT a, b, coalesce(v, 'insufficient_evidence') AS verdict, CASE WHEN v = 'same_person' THEN 'auto_merged' WHEN v = 'different_people' THEN 'rejected' ELSE 'pending' END AS review_state,
  CASE WHEN v IS NULL THEN 'no verdict returned for this pair' ELSE 'by rule' END AS reason FROM v""")
def adjudicate_join(spark, sf_dir):
    n = norm(spark, sf_dir)
    c = materialize(blocking.candidates(n), "candidates")
    return cascade.route(n, c, verdicts_of(c)).filter("stage = 'llm'").select("a", "b", "verdict", "review_state", "reason")


@query(f"""WITH RECURSIVE {O.SCORED}, m AS (SELECT (SELECT count(*) FROM norm) AS records, (SELECT count(*) FROM cand) AS candidate_pairs, (SELECT count(*) FROM sizes WHERE size > 40) AS blocking_buckets_skipped,
  (SELECT count(*) FROM settled WHERE exact IS NOT NULL) AS stage1_merged, (SELECT count(*) FROM scored) AS stage2_scored, (SELECT count(*) FROM scored WHERE score >= 92) AS stage2_auto_merged,
  (SELECT count(*) FROM scored WHERE score >= 78 AND score < 92) AS stage2_escalated, (SELECT count(*) FROM scored WHERE score < 78) AS stage2_dropped,
  (SELECT count(*) FROM scored WHERE veto AND score >= 78 AND score < 92) AS stage2_title_vetoed)
SELECT metric, n FROM (SELECT *, records * (records - 1) // 2 AS possible_pairs FROM m) UNPIVOT (n FOR metric IN (records, possible_pairs, candidate_pairs, blocking_buckets_skipped, stage1_merged, stage2_scored, stage2_auto_merged, stage2_escalated, stage2_dropped, stage2_title_vetoed))""")
def dedupe_funnel(spark, sf_dir):
    n = norm(spark, sf_dir)
    return cascade.funnel(n, materialize(blocking.candidates(n), "candidates"), blocking.skipped(n))


BLOCK_NAMES = "SELECT x.p_name AS x, y.p_name AS y FROM (SELECT DISTINCT p_name, p_brand, p_size FROM part) x JOIN (SELECT DISTINCT p_name, p_brand, p_size FROM part) y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_name < y.p_name"


@query(f"WITH RECURSIVE pr AS (SELECT DISTINCT x, y FROM ({BLOCK_NAMES})), {O.lcs_table('SELECT x, y FROM pr')} SELECT x, y, round(200.0 * n / (length(x) + length(y)) + 1e-11, 4) AS ratio FROM lcs_of")
def fuzzy_ratio(spark, sf_dir):
    part = tables(spark, sf_dir, "part")["part"].select("p_name", "p_brand", "p_size").distinct()
    pairs = part.withColumnRenamed("p_name", "x").join(part.withColumnRenamed("p_name", "y"), ["p_brand", "p_size"]).filter("x < y").select("x", "y").distinct()
    return pairs.select("x", "y", F.round(similarity.ratio(F.col("x"), F.col("y")), 4).alias("ratio"))


@query(f"""WITH RECURSIVE pr AS (SELECT DISTINCT x, y FROM ({BLOCK_NAMES})), s AS (SELECT x, y, array_to_string(list_sort(string_split(x, ' ')), ' ') AS sx, array_to_string(list_sort(string_split(y, ' ')), ' ') AS sy FROM pr),
  {O.lcs_table('SELECT sx AS x, sy AS y FROM s')} SELECT s.x, s.y, round(200.0 * n / (length(sx) + length(sy)) + 1e-11, 4) AS token_sort FROM s JOIN lcs_of l ON l.x = sx AND l.y = sy""")
def token_sort(spark, sf_dir):
    part = tables(spark, sf_dir, "part")["part"].select("p_name", "p_brand", "p_size").distinct()
    pairs = part.withColumnRenamed("p_name", "x").join(part.withColumnRenamed("p_name", "y"), ["p_brand", "p_size"]).filter("x < y").select("x", "y").distinct()
    return pairs.select("x", "y", F.round(similarity.token_sort_ratio(F.col("x"), F.col("y")), 4).alias("token_sort"))


# --- clusters and survivorship ---------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS lo, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) SELECT doc_id AS node, lo AS component FROM g WHERE n > 1""")
def cluster_components(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.md5("text").alias("h"))
    # a chain through each group of equal texts, so that components need more than one hop
    from pyspark.sql import Window

    before = F.lag("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    edges = docs.select(before.alias("a"), F.col("doc_id").alias("b")).filter("a IS NOT NULL")
    return connected_components(edges)


@query(f"WITH RECURSIVE {O.CLUSTERED} SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM member GROUP BY cluster) GROUP BY size")
def cluster_sizes(spark, sf_dir):
    n = norm(spark, sf_dir)
    pairs = cascade.route(n, blocking.candidates(n)).filter("review_state = 'auto_merged'")
    return survivorship.clusters(pairs.select("a", "b")).groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


PLANS_SQL = """m AS (SELECT member.cluster, norm.*, coalesce(created_at, '') AS d FROM member JOIN norm USING (id)),
  stages AS (SELECT x.cluster, list(DISTINCT stage) AS s FROM routed JOIN member x ON x.id = a JOIN member y ON y.id = b AND y.cluster = x.cluster GROUP BY 1),
  g AS (SELECT cluster, arg_min(id, (-score, coalesce(nullif(created_at, ''), '9999'), id)) AS canonical_id, array_to_string(list_sort(list(id)), '|') AS source_ids,
    arg_max(linkedin_url, (d, id)) FILTER (linkedin_url != '') AS linkedin_url, arg_max(title, (d, id)) FILTER (title != '') AS title, arg_max(location, (d, id)) FILTER (location != '') AS location, arg_max(source, (d, id)) FILTER (source != '') AS source,
    coalesce(arg_max(email, (d, id)) FILTER (mail IS NOT NULL AND NOT personal), arg_max(email, (d, id)) FILTER (mail IS NOT NULL AND personal)) AS email,
    list_sort(coalesce(list(DISTINCT mail) FILTER (NOT personal), []::VARCHAR[])) AS works, list_sort(coalesce(list(DISTINCT mail) FILTER (personal), []::VARCHAR[])) AS privates,
    arg_max(trim(full_name), (len(list_filter(tokens, lambda t: length(t) > 1)), length(nname), CASE WHEN trim(full_name) NOT IN (upper(trim(full_name)), lower(trim(full_name))) THEN 1 ELSE 0 END, d, id)) FILTER (nname IS NOT NULL) AS full_name,
    arg_min(bio, (-length(trim(bio)), id)) FILTER (trim(bio) != '') AS bio, arg_max(company, (length(ckey), d, id)) FILTER (ckey IS NOT NULL) AS company, list_sort(coalesce(list(DISTINCT ckey) FILTER (ckey IS NOT NULL), []::VARCHAR[])) AS ckeys,
    min(nullif(created_at, '')) AS first_contact_at, list(needs ORDER BY d, id) AS nl FROM m GROUP BY cluster),
  h AS (SELECT *, (SELECT k FROM (SELECT unnest(ckeys) AS k) ORDER BY length(k) DESC, k LIMIT 1) AS longest FROM g),
  plan AS (SELECT *, len(works) > 1 AS c1, len(privates) > 1 AS c2, len(ckeys) > 1 AND NOT list_bool_and(list_transform(ckeys, lambda k: k = longest OR (length(k) >= 3 AND starts_with(longest, k)))) AS c3,
    CASE WHEN s = ['deterministic'] THEN 'stage1_exact' WHEN list_contains(s, 'fuzzy') THEN 'stage2_fuzzy' ELSE 'mixed' END AS decided_by FROM h JOIN stages USING (cluster))
"""
PLAN_SQL = f"WITH RECURSIVE {O.CLUSTERED}, {PLANS_SQL}"


def plans_of(spark, sf_dir) -> DataFrame:
    n = norm(spark, sf_dir)
    return survivorship.build_plans(n, materialize(cascade.route(n, blocking.candidates(n)), "pairs"))


@query(f"""{PLAN_SQL} SELECT cluster, canonical_id, source_ids, linkedin_url, title, location, source, email, full_name, bio, company, first_contact_at,
  CASE WHEN c1 OR c2 OR c3 THEN 'pending_review' ELSE 'merged' END AS status, decided_by FROM plan""")
def merge_plan(spark, sf_dir):
    p = plans_of(spark, sf_dir)
    return p.select("cluster", "canonical_id", joined("source_ids").alias("source_ids"), *(f"resolved.{c}" for c in ("linkedin_url", "title", "location", "source", "email", "full_name", "bio", "company")), "first_contact_at", "status", "decided_by")


@query(f"""{PLAN_SQL} SELECT cluster, unnest(list_filter([CASE WHEN c1 THEN 'email:' || array_to_string(works, '|') END, CASE WHEN c2 THEN 'email:' || array_to_string(privates, '|') END, CASE WHEN c3 THEN 'company:' || array_to_string(ckeys, '|') END], lambda x: x IS NOT NULL)) AS conflict FROM plan""")
def conflict_flags(spark, sf_dir):
    return plans_of(spark, sf_dir).select("cluster", F.explode("conflicts").alias("c")).select("cluster", F.concat(F.col("c.field"), F.lit(":"), F.array_join("c.values", "|")).alias("conflict"))


UNION_SQL = """f AS (SELECT cluster, unnest(flatten(nl)) AS v, generate_subscripts(flatten(nl), 1) AS i FROM plan), o AS (SELECT cluster, v, min(i) AS i FROM f GROUP BY 1, 2)
SELECT cluster, string_agg(v, '|' ORDER BY i) AS needs FROM o GROUP BY cluster"""


@query(f"{PLAN_SQL}, {UNION_SQL}")
def survivor_union(spark, sf_dir):
    return plans_of(spark, sf_dir).select("cluster", F.array_join("resolved.needs", "|").alias("needs")).filter("needs != ''")


# clusters of four different people by a rule on the id: values of all kinds disagree in them
WIDE = 4
WIDE_SQL = f"""WITH {O.NORM}, member AS (SELECT id, 'w-' || (CAST(substr(id, 3) AS BIGINT) // {WIDE})::VARCHAR AS cluster FROM norm), routed AS (SELECT x.id AS a, y.id AS b, CASE WHEN CAST(substr(y.id, 3) AS BIGINT) % 8 = 1 THEN 'fuzzy' ELSE 'deterministic' END AS stage
  FROM norm x JOIN norm y ON CAST(substr(y.id, 3) AS BIGINT) = CAST(substr(x.id, 3) AS BIGINT) + 1), {PLANS_SQL}, f0 AS (SELECT cluster, count(*) AS n FROM member GROUP BY 1 HAVING count(*) > 1)"""


def wide_plans(spark, sf_dir) -> DataFrame:
    n = norm(spark, sf_dir)
    k = n.select("id", F.col("id").substr(3, 8).cast("long").alias("k"))
    pairs = k.select(F.col("id").alias("a"), (F.col("k") + 1).alias("k")).join(k.withColumnRenamed("id", "b"), "k").select("a", "b", F.when(F.col("k") % 8 == 1, "fuzzy").otherwise("deterministic").alias("stage"))
    members = n.join(k.select("id", F.concat(F.lit("w-"), F.expr(f"k div {WIDE}").cast("string")).alias("cluster")), "id")
    return survivorship.merge_plans(members, pairs)


@query(f"""{WIDE_SQL} SELECT cluster, canonical_id, source_ids, linkedin_url, title, location, source, email, full_name, bio, company, first_contact_at, CASE WHEN c1 OR c2 OR c3 THEN 'pending_review' ELSE 'merged' END AS status, decided_by FROM plan JOIN f0 USING (cluster)""")
def merge_plan_wide(spark, sf_dir):
    p = wide_plans(spark, sf_dir)
    return p.select("cluster", "canonical_id", joined("source_ids").alias("source_ids"), *(f"resolved.{c}" for c in ("linkedin_url", "title", "location", "source", "email", "full_name", "bio", "company")), "first_contact_at", "status", "decided_by")


@query(f"""{WIDE_SQL}, c AS (SELECT cluster, unnest(list_filter([CASE WHEN c1 THEN 'email:' || array_to_string(works, '|') || ':' || len(works) || ' different work addresses across the cluster' END,
  CASE WHEN c2 THEN 'email:' || array_to_string(privates, '|') || ':' || len(privates) || ' different personal addresses across the cluster' END,
  CASE WHEN c3 THEN 'company:' || array_to_string(ckeys, '|') || ':records disagree on the employer after canonicalization' END], lambda x: x IS NOT NULL)) AS conflict FROM plan JOIN f0 USING (cluster)) SELECT cluster, conflict FROM c""")
def conflict_flags_wide(spark, sf_dir):
    rows = wide_plans(spark, sf_dir).select("cluster", F.explode("conflicts").alias("c"))
    return rows.select("cluster", F.concat_ws(":", F.col("c.field"), F.array_join("c.values", "|"), F.col("c.detail")).alias("conflict"))


@query(f"{WIDE_SQL}, {UNION_SQL}".replace("FROM plan)", "FROM plan JOIN f0 USING (cluster))"))
def survivor_union_wide(spark, sf_dir):
    return wide_plans(spark, sf_dir).select("cluster", F.array_join("resolved.needs", "|").alias("needs")).filter("needs != ''")


PLACE_SQL = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in ("linkedin_url", "title", "location", "source", "full_name", "email", "company", "bio"))


@query(f"{WIDE_SQL} SELECT cluster, array_to_string(list_sort(list_filter([{PLACE_SQL}], lambda x: x IS NOT NULL)), '|') AS known FROM plan JOIN f0 USING (cluster)")
def provenance_fields(spark, sf_dir):
    """The fields whose source a plan names: those that have a value."""
    return wide_plans(spark, sf_dir).select("cluster", F.array_join(F.array_sort(F.map_keys("provenance")), "|").alias("known"))


@query(f"{WIDE_SQL}, gk AS (SELECT cluster, CASE WHEN c1 OR c2 OR c3 THEN 'pending' ELSE 'merged' END AS k FROM plan JOIN f0 USING (cluster)) SELECT count_if(k = 'merged') AS merged, count_if(k = 'pending') AS pending, (SELECT count_if(k = 'merged') FROM gk) AS reverted FROM gk")
def merge_state_counts(spark, sf_dir):
    """Groups of a run over a history in which all merged ones were reverted once."""
    plans = materialize(wide_plans(spark, sf_dir), "plans")
    old = survivorship.merge_state(plans, plans.limit(0).withColumns({"created_at": F.lit(""), "reverted_at": F.lit("")}), "2024-01-01")[0]
    history = old.withColumns({"reverted_at": F.when(F.col("status") == "merged", "2024-02-01"), "status": F.when(F.col("status") == "merged", "reverted").otherwise(F.col("status"))})
    return survivorship.group_counts(survivorship.merge_state(plans, history, "2024-03-01")[0])


@query(f"""{PLAN_SQL}, s AS (SELECT canonical_id, unnest(string_split(source_ids, '|')) AS id FROM plan WHERE NOT (c1 OR c2 OR c3)) SELECT id, canonical_id AS merged_into FROM s WHERE id != canonical_id""")
def merge_state_apply(spark, sf_dir):
    return survivorship.merge_pointers(plans_of(spark, sf_dir))


@query("""SELECT conv_id, arg_max(role, turn) AS last_role, arg_min(text, (-length(trim(text)), turn)) AS longest, min(turn) AS first_turn, count(*) AS n FROM conversations GROUP BY conv_id""")
def survivor_longest(spark, sf_dir):
    c = tables(spark, sf_dir, "conversations")["conversations"]
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.min_by("text", F.struct(-F.length(F.trim("text")), F.col("turn"))).alias("longest"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"))


# --- decisions -------------------------------------------------------------------------------------------------------

LOG_SQL = """log AS (SELECT user_id, user_id % 97 AS a, 97 + (user_id * 7 + event_id) % 101 AS b, CASE event_type WHEN 'view' THEN 'merge' WHEN 'click' THEN 'keep_both' WHEN 'error' THEN 'not_sure' WHEN 'signup' THEN 'block' ELSE 'restore' END AS decision, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS decided_at FROM events)"""


def log_of(spark, sf_dir) -> DataFrame:
    """Events as a decision log over pairs; odd events write their pair the other way round."""
    e = tables(spark, sf_dir, "events")["events"]
    kind = F.when(F.col("event_type") == "view", "merge").when(F.col("event_type") == "click", "keep_both").when(F.col("event_type") == "error", "not_sure").when(F.col("event_type") == "signup", "block").otherwise("restore")
    a, b = F.col("user_id") % 97, 97 + (F.col("user_id") * 7 + F.col("event_id")) % 101
    odd = F.col("event_id") % 2 == 1
    rows = e.select(F.when(odd, b).otherwise(a).alias("a"), F.when(odd, a).otherwise(b).alias("b"), kind.alias("decision"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("decided_at"))
    return rows


@query(f"WITH {LOG_SQL} SELECT a, b, max(struct_pack(d := decided_at, k := decision)).k AS decision, max(decided_at) AS decided_at FROM log GROUP BY a, b")
def decision_latest(spark, sf_dir):
    return decisions.latest_decisions(log_of(spark, sf_dir)).select("a", "b", "decision", "decided_at")


@query(f"WITH {LOG_SQL}, l AS (SELECT a, b, max(struct_pack(d := decided_at, k := decision)) AS s FROM log WHERE decision IN ('block', 'restore') GROUP BY a, b) SELECT a, b, s.d AS decided_at FROM l WHERE s.k = 'block'")
def blocked_fold(spark, sf_dir):
    return decisions.blocked_pairs(log_of(spark, sf_dir))


DECIDED = "CASE WHEN CAST(substr(a, 3) AS BIGINT) % 5 = 0 THEN 'keep_both' WHEN CAST(substr(a, 3) AS BIGINT) % 5 = 1 THEN 'merge' WHEN CAST(substr(a, 3) AS BIGINT) % 5 = 2 THEN 'not_sure' END"


def reviews_of(pairs: DataFrame) -> DataFrame:
    """Human decisions on routed pairs, by a rule on the id."""
    return pairs.select("a", "b", F.expr(DECIDED).alias("decision"), F.lit("2024-06-01").alias("decided_at")).filter("decision IS NOT NULL")


@query(f"""WITH RECURSIVE {O.ROUTED}, r AS (SELECT *, {DECIDED} AS decision FROM routed)
SELECT a, b, CASE decision WHEN 'keep_both' THEN 'rejected' ELSE review_state END AS review_state, decision,
  CASE WHEN decision IS NOT NULL THEN decision = 'keep_both' AND verdict = 'same_person' AND review_state = 'auto_merged' END AS overruled FROM r""")
def keep_both_filter(spark, sf_dir):
    n = norm(spark, sf_dir)
    pairs = materialize(cascade.route(n, blocking.candidates(n)), "pairs")
    out = decisions.apply_decisions(pairs, reviews_of(pairs))
    return out.select("a", "b", "review_state", "decision", F.when(F.col("decision").isNotNull(), F.col("reason").endswith("[overruled by an operator: keep_both]")).alias("overruled"))


@query(f"""WITH RECURSIVE {O.ROUTED}, r AS (SELECT *, {DECIDED} AS decision FROM routed)
SELECT a, b, CASE decision WHEN 'keep_both' THEN 'rejected' WHEN 'merge' THEN 'auto_merged' WHEN 'not_sure' THEN 'pending' ELSE review_state END AS review_state, decision FROM r""")
def decided_states(spark, sf_dir):
    n = norm(spark, sf_dir)
    pairs = materialize(cascade.route(n, blocking.candidates(n)), "pairs")
    return decisions.decide(pairs, reviews_of(pairs)).select("a", "b", "review_state", "decision")


@query(f"""{PLAN_SQL}, gone AS (SELECT unnest(string_split(source_ids, '|')) AS id FROM (SELECT source_ids FROM plan WHERE NOT (c1 OR c2 OR c3) ORDER BY canonical_id LIMIT 1)),
  left_ AS (SELECT a, b FROM routed WHERE review_state = 'auto_merged' AND NOT (a IN (SELECT id FROM gone) AND b IN (SELECT id FROM gone))), {O.closure("SELECT a, b FROM left_", "again")} SELECT id, cluster FROM again""")
def revert_merge(spark, sf_dir):
    """The members of all groups after one was reverted and everything was recomputed."""
    n = norm(spark, sf_dir)
    pairs = materialize(cascade.route(n, blocking.candidates(n)), "pairs")
    plans = materialize(survivorship.build_plans(n, pairs), "plans")
    first = plans.filter("status = 'merged'").agg(F.min("canonical_id")).first()[0]
    events = decisions.revert_events(plans, pairs, first, "2024-07-01")
    assert decisions.revert(plans, first, "2024-07-01").filter("status = 'reverted'").count() == 1
    return survivorship.build_plans(n, pairs, decisions.latest_decisions(events)).select(F.explode("source_ids").alias("id"), "cluster")


@query(f"""WITH RECURSIVE {O.ROUTED}, e AS (SELECT a, b FROM routed WHERE review_state = 'auto_merged' AND coalesce({DECIDED}, '') != 'keep_both' UNION SELECT a, b FROM routed WHERE {DECIDED} = 'merge'),
  {O.closure("SELECT a, b FROM e")} SELECT id, cluster FROM member""")
def revert_fold(spark, sf_dir):
    n = norm(spark, sf_dir)
    pairs = materialize(cascade.route(n, blocking.candidates(n)), "pairs")
    plans = survivorship.build_plans(n, pairs, reviews_of(pairs))
    return plans.select(F.explode("source_ids").alias("id"), "cluster")


# --- enrichment and rubric -------------------------------------------------------------------------------------------

ENRICH_SQL = """SELECT CAST(c_custkey AS STRING) AS person_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'founder' WHEN 'AUTOMOBILE' THEN 'operator' WHEN 'MACHINERY' THEN 'investor' WHEN 'HOUSEHOLD' THEN 'pilot' ELSE 'ic' END AS persona,
  split_part('founder,c_level,vp,director,head_or_lead,senior_ic,mid,junior,unknown', ',', CAST(c_custkey % 9 AS INT) + 1) AS seniority,
  split_part('pre_seed,seed,series_a,series_b,growth,public,not_applicable,unknown', ',', CAST(c_nationkey % 8 AS INT) + 1) AS company_stage,
  split_part('fintech,climate,devtools,other', ',', CAST(c_custkey % 4 AS INT) + 1) AS sector,
  CASE WHEN c_custkey % 41 = 0 THEN 'mars' ELSE 'europe' END AS geography,
  CAST(c_custkey % 12 AS DOUBLE) / 10 AS confidence FROM customer"""


def answers_of(spark, sf_dir) -> DataFrame:
    rows = spark.sql(ENRICH_SQL.replace("FROM customer", "FROM {customer}"), **tables(spark, sf_dir, "customer"))
    empty = F.array().cast("array<string>")
    evidence = F.array(F.struct(F.lit("bio").alias("field"), F.lit("Works").alias("quote"), F.lit("persona").alias("supports")))
    return rows.withColumns({"needs": empty, "offers": empty, "evidence": evidence})


LISTED = {"persona": "'founder','operator','investor','service_provider','ic','unknown'", "geography": "'india','south_east_asia','middle_east','europe','north_america','latin_america','africa','apac','unknown'"}
VALID_SQL = f"persona IN ({LISTED['persona']}) AND geography IN ({LISTED['geography']}) AND confidence BETWEEN 0 AND 1"


@query(f"WITH e AS ({ENRICH_SQL}) SELECT person_id, {VALID_SQL} AS valid FROM e")
def enum_validate(spark, sf_dir):
    return answers_of(spark, sf_dir).select("person_id", enrichment.valid().alias("valid"))


@query(f"""WITH e AS ({ENRICH_SQL}), u AS (SELECT 'persona' AS enum, persona AS value FROM e UNION ALL SELECT 'seniority', seniority FROM e UNION ALL SELECT 'company_stage', company_stage FROM e UNION ALL SELECT 'sector', sector FROM e UNION ALL SELECT 'geography', geography FROM e),
  c AS (SELECT enum, value, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY enum ORDER BY n DESC, value) AS rank FROM c) SELECT enum, value, n, rank::INT AS rank FROM r WHERE rank <= 6""")
def enum_distribution(spark, sf_dir):
    return enrichment.distribution(answers_of(spark, sf_dir))


@query("""WITH q AS (SELECT trim(text) AS quote, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g')) AS folded FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g')) AS folded FROM documents)
SELECT d.doc_id, count(*) AS total, sum(CASE WHEN length(q.quote) >= 4 AND contains(d.folded, q.folded) THEN 1 ELSE 0 END)::BIGINT AS verified FROM d JOIN q ON true GROUP BY d.doc_id""")
def evidence_verify(spark, sf_dir):
    t = tables(spark, sf_dir, "documents", "benchmark")
    null = F.lit(None).cast("string")
    docs = t["documents"].select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.col("text").alias("bio"), *(null.alias(c) for c in ("full_name", "email", "linkedin_url", "company", "title", "location")), *(F.array().cast("array<string>").alias(c) for c in ("needs", "offers")))
    quotes = t["benchmark"].select(F.lit("bio").alias("field"), F.col("text").alias("quote"))
    return enrichment.verify_shared(docs, quotes).select(F.col("person_id").cast("long").alias("doc_id"), "total", "verified")


APPLY_SQL = "SELECT CAST(o_orderkey AS STRING) AS person_id, CASE WHEN o_orderkey % 3 = 0 THEN 'We have 40 customers' WHEN o_orderkey % 3 = 1 THEN 'grew a lot' END AS building_now, CASE WHEN o_orderkey % 4 = 1 THEN 'mentoring' ELSE ' ' END AS contribution, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN 'nobody' ELSE CAST(o_custkey AS STRING) END AS referred_by, o_custkey FROM orders"
RUBRIC_SQL = f"""WITH a AS ({APPLY_SQL}), e AS ({ENRICH_SQL}), j AS (SELECT a.*, e.persona, e.seniority, e.company_stage, (o_custkey % 20) / 20.0 AS complete FROM a LEFT JOIN e ON e.person_id = a.person_id),
  p AS (SELECT person_id, CASE coalesce(persona, 'unknown') WHEN 'founder' THEN 30 WHEN 'operator' THEN 20 WHEN 'investor' THEN 14 WHEN 'service_provider' THEN 10 WHEN 'ic' THEN 8 ELSE 6 END AS p1,
    CASE coalesce(seniority, 'unknown') WHEN 'c_level' THEN 20 WHEN 'founder' THEN 18 WHEN 'vp' THEN 16 WHEN 'director' THEN 13 WHEN 'head_or_lead' THEN 12 WHEN 'senior_ic' THEN 9 WHEN 'mid' THEN 5 WHEN 'junior' THEN 2 ELSE 4 END AS p2,
    CASE coalesce(company_stage, 'unknown') WHEN 'growth' THEN 20 WHEN 'public' THEN 19 WHEN 'series_b' THEN 18 WHEN 'series_a' THEN 15 WHEN 'seed' THEN 10 WHEN 'pre_seed' THEN 5 WHEN 'not_applicable' THEN 12 ELSE 6 END AS p3,
    CASE WHEN referred_by IS NULL THEN 4 WHEN referred_by IN (SELECT CAST(c_custkey AS STRING) FROM customer WHERE c_acctbal > 0) THEN 15 ELSE 8 END AS p4,
    round(round(complete * 8, 2) + CASE WHEN building_now LIKE '%customers%' THEN 4 ELSE 0 END + CASE WHEN trim(contribution) != '' THEN 3 ELSE 0 END, 2)::DOUBLE AS p5 FROM j),
  s AS (SELECT *, round(p1 + p2 + p3 + p4 + p5, 2) AS total FROM p), b AS (SELECT *, CASE WHEN total >= 75 THEN 'strong' WHEN total >= 55 THEN 'review' ELSE 'weak' END AS band FROM s)"""


def scores_of(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir, "orders", "customer")
    apps = spark.sql(APPLY_SQL.replace("FROM orders", "FROM {orders}"), orders=t["orders"])
    complete = apps.select(F.col("person_id").alias("id"), ((F.col("o_custkey") % 20) / 20.0).alias("score"))
    members = t["customer"].filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))
    return rubric.score_applicants(apps.drop("o_custkey"), answers_of(spark, sf_dir), complete, members)


@query(f"{RUBRIC_SQL} SELECT person_id, p1::DOUBLE AS persona_fit, p2::DOUBLE AS seniority, p3::DOUBLE AS company_stage, p4::DOUBLE AS referral_signal, p5 AS profile_signal, total, band FROM b")
def rubric_score(spark, sf_dir):
    parts = ["persona_fit", "seniority", "company_stage", "referral_signal", "profile_signal"]
    return scores_of(spark, sf_dir).select("person_id", *(F.col("components")[i]["points"].alias(c) for i, c in enumerate(parts)), "total", "band")


@query(f"{RUBRIC_SQL} SELECT count(*) AS applicants, count_if(band = 'strong') AS strong, count_if(band = 'review') AS review, count_if(band = 'weak') AS weak, count_if(band = 'weak') AS why_not FROM b")
def band_counts(spark, sf_dir):
    return rubric.summarise(scores_of(spark, sf_dir)).drop("explained")


@query(f"""{RUBRIC_SQL}, c AS (SELECT person_id, unnest([struct_pack(k := -p1 / 30, i := 0, name := 'persona_fit'), struct_pack(k := -p2 / 20, i := 1, name := 'seniority'), struct_pack(k := -p3 / 20, i := 2, name := 'company_stage'), struct_pack(k := -p4 / 15, i := 3, name := 'referral_signal'), struct_pack(k := -p5 / 15, i := 4, name := 'profile_signal')]) AS s FROM b)
SELECT person_id, array_to_string(list_transform(list_sort(list(s))[1:2], lambda x: x.name), '|') AS strongest FROM c GROUP BY person_id""")
def component_rank(spark, sf_dir):
    return scores_of(spark, sf_dir).select("person_id", F.array_join(rubric.by_share(2), "|").alias("strongest"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'none' WHEN c_acctbal > 0 THEN 'member' ELSE 'unknown_referrer' END AS referral FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def referral_class(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "customer")
    rows = t["orders"].join(t["customer"], F.col("c_custkey") == F.col("o_custkey"), "left")
    who = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string"))
    return rows.select("o_orderkey", rubric.referral_class(who, F.coalesce(F.col("c_acctbal") > 0, F.lit(False))).alias("referral"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(\d[\d,.]*\s*(?:crore|lakh|cr|k|m|mn|million|%)|[$₹]\s*\d|\d+\s*(?:customers|people|users|employees|accounts|pilots))') AS traction FROM documents")
def traction_regex(spark, sf_dir):
    from ..functions.tables import TRACTION

    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.col("text").rlike(TRACTION).alias("traction"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?'))), '|') AS numbers FROM documents")
def number_audit(spark, sf_dir):
    return tables(spark, sf_dir, "documents")["documents"].select("doc_id", F.array_join(F.sort_array(rubric.numbers_in(F.col("text"))), "|").alias("numbers"))


@query("""SELECT event_id, sha256('local|rules|' || event_type || '|{"id":' || event_id::VARCHAR || ',"user":' || user_id::VARCHAR || '}') AS key FROM events""")
def cache_key(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"]
    payload = text.canonical_json(user=F.col("user_id"), id=F.col("event_id"))
    return e.select("event_id", text.cache_key(F.lit("local"), F.lit("rules"), F.col("event_type"), payload).alias("key"))


# --- matching --------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS square, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS whole FROM embeddings")
def vec_normalize(spark, sf_dir):
    v = tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.round(matching.dot(F.col("v"), F.col("v")), 4).alias("square"), F.round(matching.unit(F.col("v"))[0], 6).alias("first"), F.round(F.aggregate(matching.unit(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("whole"))


UNITS_SQL = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9)) AS v FROM embeddings)"
# a person has the vectors of three neighbouring ids, needs, offers and profile, each with its label as a direction, so that equal labels are near
PULL = 1.5
LABELLED_SQL = f"""w AS (SELECT vec_id, list_concat(v, list_transform(range(10), lambda i: CASE WHEN i = label THEN {PULL} ELSE 0.0 END)) AS v FROM u),
  lu AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM w)"""
MATCH_SQL = f"""WITH {UNITS_SQL}, {LABELLED_SQL}, p AS (SELECT n.vec_id // 3 AS k, 'v-' || lpad((n.vec_id // 3)::VARCHAR, 6, '0') AS id, n.v AS need, o.v AS offer, f.v AS prof FROM lu n JOIN lu o ON o.vec_id = n.vec_id + 1 JOIN lu f ON f.vec_id = n.vec_id + 2 WHERE n.vec_id % 3 = 0),
  s AS (SELECT x.id AS x, y.id AS y, list_dot_product(x.need, y.offer) AS f, list_dot_product(y.need, x.offer) AS b, list_dot_product(x.prof, y.prof) AS sim FROM p x JOIN p y ON x.id < y.id),
  t AS (SELECT CASE WHEN f >= b THEN x ELSE y END AS a, CASE WHEN f >= b THEN y ELSE x END AS b, greatest(f, b) AS hi, least(f, b) AS lo, sim FROM s WHERE greatest(f, b) >= 0.68),
  sc AS (SELECT a, b, round(0.6 * hi + 0.15 * lo + 0.1 * sim + CASE WHEN lo >= 0.62 THEN 0.15 ELSE 0 END, 4) AS score, round(hi, 4) AS complementarity, lo >= 0.62 AS reciprocal FROM t), scored AS (SELECT * FROM sc WHERE score >= 0.55)"""


def vectors_of(spark, sf_dir) -> DataFrame:
    u = tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "label", matching.unit(F.col("embedding")).alias("v"))
    pulled = F.concat("v", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), PULL).otherwise(0.0)))
    u = u.select(F.expr("vec_id div 3").alias("k"), (F.col("vec_id") % 3).alias("part"), pulled.alias("v")).select("k", "part", matching.unit(F.col("v")).alias("v"))
    one = lambda i: F.max(F.when(F.col("part") == i, F.col("v")))
    rows = u.groupBy("k").agg(one(0).alias("n"), one(1).alias("o"), one(2).alias("profile")).filter("n IS NOT NULL AND o IS NOT NULL AND profile IS NOT NULL")
    return rows.select(F.concat(F.lit("v-"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"), F.array("n").alias("needs"), F.array("o").alias("offers"), "profile")


@query(f"{MATCH_SQL} SELECT a, b, score, complementarity, reciprocal FROM scored")
def pair_score(spark, sf_dir):
    return matching.score_pairs(vectors_of(spark, sf_dir)).select("a", "b", "score", "complementarity", "reciprocal")


# a person has the vectors of five neighbouring ids: two needs, two offers (equal ones for even people, so that they tie) and a profile; every seventh has no offers
LISTS_SQL = f"""WITH {UNITS_SQL}, {LABELLED_SQL}, p AS (SELECT n.vec_id // 5 AS k, 'm-' || lpad((n.vec_id // 5)::VARCHAR, 6, '0') AS id, n.v AS n0, m.v AS n1, o.v AS o0, CASE WHEN (n.vec_id // 5) % 2 = 0 THEN o.v ELSE q.v END AS o1, f.v AS prof
    FROM lu n JOIN lu m ON m.vec_id = n.vec_id + 1 JOIN lu o ON o.vec_id = n.vec_id + 2 JOIN lu q ON q.vec_id = n.vec_id + 3 JOIN lu f ON f.vec_id = n.vec_id + 4 WHERE n.vec_id % 5 = 0),
  needs AS (SELECT id, 0 AS i, n0 AS v FROM p UNION ALL SELECT id, 1, n1 FROM p), offers AS (SELECT id, 0 AS j, o0 AS v FROM p WHERE k % 7 != 0 UNION ALL SELECT id, 1, o1 FROM p WHERE k % 7 != 0),
  best AS (SELECT n.id AS x, o.id AS y, max(round(list_dot_product(n.v, o.v), 9)) AS f, arg_max({{'i': i, 'j': j}}, (round(list_dot_product(n.v, o.v), 9), -i, -j)) AS w FROM needs n JOIN offers o ON n.id != o.id GROUP BY 1, 2),
  s AS (SELECT x.id AS x, y.id AS y, coalesce(f.f, 0) AS f, coalesce(g.f, 0) AS b, coalesce(f.w.i, -1) AS fi, coalesce(f.w.j, -1) AS fj, coalesce(g.w.i, -1) AS gi, coalesce(g.w.j, -1) AS gj, list_dot_product(x.prof, y.prof) AS sim
    FROM p x JOIN p y ON x.id < y.id LEFT JOIN best f ON f.x = x.id AND f.y = y.id LEFT JOIN best g ON g.x = y.id AND g.y = x.id),
  t AS (SELECT CASE WHEN f >= b THEN x ELSE y END AS a, CASE WHEN f >= b THEN y ELSE x END AS b, greatest(f, b) AS hi, least(f, b) AS lo, sim, CASE WHEN f >= b THEN fi ELSE gi END AS need_i, CASE WHEN f >= b THEN fj ELSE gj END AS offer_j, CASE WHEN f >= b THEN gi ELSE fi END AS reverse_i, CASE WHEN f >= b THEN gj ELSE fj END AS reverse_j FROM s WHERE greatest(f, b) >= 0.68),
  sc AS (SELECT *, round(0.6 * hi + 0.15 * lo + 0.1 * sim + CASE WHEN lo >= 0.62 THEN 0.15 ELSE 0 END, 4) AS score, lo >= 0.62 AS reciprocal FROM t), scored AS (SELECT * FROM sc WHERE score >= 0.55)"""


def lists_of(spark, sf_dir) -> DataFrame:
    u = tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "label", matching.unit(F.col("embedding")).alias("v"))
    pulled = F.concat("v", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), PULL).otherwise(0.0)))
    u = u.select(F.expr("vec_id div 5").alias("k"), (F.col("vec_id") % 5).alias("part"), pulled.alias("v")).select("k", "part", matching.unit(F.col("v")).alias("v"))
    rows = u.groupBy("k").agg(*(F.max(F.when(F.col("part") == i, F.col("v"))).alias(f"v{i}") for i in range(5))).filter(" AND ".join(f"v{i} IS NOT NULL" for i in range(5)))
    offers = F.when(F.col("k") % 7 != 0, F.array("v2", F.when(F.col("k") % 2 == 0, F.col("v2")).otherwise(F.col("v3"))))
    return rows.select(F.concat(F.lit("m-"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("id"), F.array("v0", "v1").alias("needs"), offers.alias("offers"), F.col("v4").alias("profile"))


@query(f"{LISTS_SQL} SELECT a, b, score, reciprocal, need_i, offer_j, reverse_i, reverse_j FROM scored")
def pair_score_lists(spark, sf_dir):
    return matching.score_pairs(lists_of(spark, sf_dir)).select("a", "b", "score", "reciprocal", "need_i", "offer_j", "reverse_i", "reverse_j")


@query(f"WITH {UNITS_SQL} SELECT n.vec_id, max(list_dot_product(n.v, o.v)) >= 0.68 AS strong, arg_max(o.vec_id, (round(list_dot_product(n.v, o.v), 9), -o.vec_id)) AS best FROM u n JOIN u o ON o.label = n.label AND o.vec_id != n.vec_id GROUP BY n.vec_id")
def vec_best_match(spark, sf_dir):
    u = tables(spark, sf_dir, "embeddings")["embeddings"].select("vec_id", "label", matching.unit(F.col("embedding")).alias("v"))
    return matching.best_of_label(u).select("vec_id", (F.col("sim") >= 0.68).alias("strong"), "best")


GREEDY_SQL = f"""{MATCH_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, edges AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS r FROM scored),
  g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS used, false AS ok UNION ALL
    SELECT e.r, CASE WHEN x THEN list_concat(used, [a, b]) ELSE used END, x FROM (SELECT e.*, used, len(list_filter(used, lambda v: v = a)) < 3 AND len(list_filter(used, lambda v: v = b)) < 3 AS x FROM g JOIN edges e ON e.r = g.r + 1) e)
SELECT a, b, score, reciprocal FROM g JOIN edges USING (r) WHERE ok"""


@query(GREEDY_SQL)
def greedy_capped_match(spark, sf_dir):
    return matching.greedy_match(materialize(matching.score_pairs(vectors_of(spark, sf_dir)), "scored")).select("a", "b", "score", "reciprocal")


FILTER_SQL = f"""WITH e AS ({ENRICH_SQL}), p AS (SELECT c_custkey AS k, person_id AS id, 'c' || (c_custkey % 211)::VARCHAR AS ck, persona, sector, company_stage, list_position(['pre_seed','seed','series_a','series_b','growth'], company_stage) AS st FROM e JOIN customer ON CAST(c_custkey AS STRING) = person_id),
  r AS (SELECT CASE WHEN x.ck = y.ck THEN 'same_company' WHEN x.persona = 'founder' AND y.persona = 'founder' AND x.sector = y.sector AND x.sector NOT IN ('unknown', 'other') AND x.company_stage != 'unknown' AND y.company_stage != 'unknown'
      AND (x.company_stage = y.company_stage OR (coalesce(x.st, 0) > 0 AND coalesce(y.st, 0) > 0 AND abs(x.st - y.st) <= 1)) THEN 'competitors' WHEN y.k = x.k + 1 THEN 'blocked_pair' WHEN y.k = x.k + 2 THEN 'already_introduced' ELSE 'no_shared_signal' END AS reason FROM p x JOIN p y ON x.k < y.k)
SELECT reason, count(r.reason) AS n FROM (SELECT unnest([{", ".join(f"'{x}'" for x in REASONS)}]) AS reason) LEFT JOIN r USING (reason) GROUP BY reason"""


@query(FILTER_SQL)
def pair_filters_attrib(spark, sf_dir):
    rows = answers_of(spark, sf_dir).select(F.col("person_id").alias("id"), F.concat(F.lit("c"), (F.col("person_id").cast("long") % 211).cast("string")).alias("company_key"), "persona", "sector", "company_stage")
    k = rows.select(F.col("id").cast("long").alias("k"))
    near = lambda d: k.select(F.col("k").cast("string").alias("a"), (F.col("k") + d).cast("string").alias("b")).join(k.select(F.col("k").cast("string").alias("b")), "b", "left_semi")
    none = spark.createDataFrame([], "a string, b string")
    return matching.rejections(rows, 0, near(1), near(2), none)


@query(FILTER_SQL.replace("SELECT reason, count(r.reason) AS n FROM", "SELECT reason, count(r.reason) AS n, row_number() OVER (ORDER BY count(r.reason) DESC, reason)::INT AS place FROM"))
def rejections_ranked(spark, sf_dir):
    return reports.by_count(pair_filters_attrib(spark, sf_dir))


@query("SELECT status, count(s.status) AS n FROM (SELECT unnest(['suggested', 'approved', 'dismissed']) AS status) LEFT JOIN (SELECT CASE event_type WHEN 'view' THEN 'suggested' WHEN 'purchase' THEN 'approved' ELSE 'other' END AS status FROM events) s USING (status) GROUP BY status")
def status_counts_zero_filled(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"]
    return reports.status_counts(e.select(F.when(F.col("event_type") == "view", "suggested").when(F.col("event_type") == "purchase", "approved").otherwise("other").alias("status")))


# --- reports ---------------------------------------------------------------------------------------------------------


def state_of(spark, sf_dir) -> dict[str, DataFrame]:
    """A whole state from the tables: records, routed pairs, plans, decisions by rule, scores of some people, suggestions."""
    n = norm(spark, sf_dir)
    pairs = materialize(cascade.route(n, blocking.candidates(n)), "pairs")
    plans = materialize(survivorship.build_plans(n, pairs), "plans")
    log = reviews_of(pairs)
    folk = n.join(survivorship.merge_pointers(plans), "id", "left")
    k = F.col("id").substr(3, 8).cast("long")
    enriched = n.select(F.col("id").alias("person_id"), F.when(k % 3 == 0, "founder").otherwise("ic").alias("persona"), F.when(k % 4 != 0, 0.8).otherwise(0.0).alias("confidence"))
    total = (30 + k % 60).cast("double")
    scores = n.filter("source = 'applicant_form'").select(F.col("id").alias("person_id"), total.alias("total"), rubric.band(total).alias("band"), F.when(k % 3 == 0, "clear").when(k % 3 == 1, "").alias("explanation"))
    intros = pairs.select("a", "b", F.round(F.col("score") / 100, 4).alias("score"), F.when(F.col("review_state") == "pending", "suggested").otherwise("dismissed").alias("status"), F.when(F.col("score") >= 90, "both sides gain").alias("why"))
    return {"people": folk, "pairs": pairs, "plans": plans, "decisions": log, "enrichment": enriched, "scores": scores, "intros": intros, "applications": scores.select("person_id")}


# the same without decisions' effect on plans: groups, who is merged into whom, and what is undecided
STATE_SQL = PLAN_SQL.rstrip() + f""", held AS (SELECT unnest(string_split(source_ids, '|')) AS id, cluster, c1 OR c2 OR c3 AS conflict FROM plan), review AS (SELECT a, b, {DECIDED} AS decision FROM routed),
  open_ AS (SELECT r.* FROM routed r JOIN review v USING (a, b) WHERE v.decision IS NULL), need AS (SELECT o.* FROM open_ o LEFT JOIN held x ON x.id = o.a LEFT JOIN held y ON y.id = o.b WHERE verdict = 'insufficient_evidence' OR (x.conflict AND x.cluster = y.cluster)),
  folk AS (SELECT norm.*, s.canonical_id AS merged_into FROM norm LEFT JOIN (SELECT canonical_id, unnest(string_split(source_ids, '|')) AS id FROM plan WHERE NOT (c1 OR c2 OR c3)) s ON s.id = norm.id AND s.canonical_id != norm.id),
  sc AS (SELECT id AS person_id, (30 + CAST(substr(id, 3) AS BIGINT) % 60)::DOUBLE AS total FROM norm WHERE source = 'applicant_form'), sb AS (SELECT *, CASE WHEN total >= 75 THEN 'strong' WHEN total >= 55 THEN 'review' ELSE 'weak' END AS band FROM sc)"""


@query(f"{STATE_SQL} SELECT n.a, n.b, n.score, n.verdict, x.full_name AS a_name, y.full_name AS b_name FROM need n JOIN norm x ON x.id = n.a JOIN norm y ON y.id = n.b")
def queue_pending(spark, sf_dir):
    return reports.pending(state_of(spark, sf_dir)).select("a", "b", "score", "verdict", "a_name", "b_name")


@query(f"{STATE_SQL} SELECT id, score, blocked_reason IS NOT NULL AS blocked, {O.SUMMARY} AS summary FROM folk WHERE merged_into IS NULL AND (blocked_reason IS NOT NULL OR score < 1)")
def queue_incomplete(spark, sf_dir):
    return reports.incomplete(state_of(spark, sf_dir)["people"]).select("id", "score", "blocked", "summary")


@query(f"{STATE_SQL} SELECT r.a, r.b, r.score, decision FROM routed r JOIN review USING (a, b) WHERE decision IS NOT NULL")
def duplicates_decided(spark, sf_dir):
    return reports.duplicates(state_of(spark, sf_dir), "decided").select("a", "b", "score", "decision")


@query(f"{STATE_SQL} SELECT r.a, r.b, round(r.score / 100, 4) AS score, x.company AS a_company, y.company AS b_company FROM routed r JOIN norm x ON x.id = r.a JOIN norm y ON y.id = r.b WHERE review_state = 'pending' ORDER BY 3 DESC, 1, 2 LIMIT 10")
def top_intros(spark, sf_dir):
    return reports.todays_intros(state_of(spark, sf_dir)).select("a", "b", "score", "a_company", "b_company")


@query(f"{STATE_SQL} SELECT row_number() OVER (ORDER BY CASE band WHEN 'review' THEN 0 WHEN 'strong' THEN 1 ELSE 2 END, total DESC, person_id)::INT AS place, person_id, total, band, full_name, CAST(substr(person_id, 3) AS BIGINT) % 4 = 0 AS enrichment_missing FROM sb JOIN norm ON id = person_id")
def applicants_ranked(spark, sf_dir):
    rows = reports.applicants(state_of(spark, sf_dir)).withColumn("first", F.when(F.col("band") == "review", 0).when(F.col("band") == "strong", 1).otherwise(2)).withColumn("less", -F.col("total"))
    rows = numbered(rows, ["first", "less", "person_id"])
    return rows.select((F.col("n") + 1).cast("int").alias("place"), "person_id", "total", "band", "full_name", "enrichment_missing")


@query(f"""{STATE_SQL} SELECT id, full_name, CASE WHEN CAST(substr(id, 3) AS BIGINT) % 4 != 0 THEN CASE WHEN CAST(substr(id, 3) AS BIGINT) % 3 = 0 THEN 'founder' ELSE 'ic' END END AS persona, total
FROM folk LEFT JOIN sb ON person_id = id WHERE merged_into IS NULL AND contains(lower(concat_ws(' ', coalesce(trim(full_name), ''), coalesce(company, ''), coalesce(title, ''), coalesce(email, ''), coalesce(location, ''))), 'labs inc')
  AND CAST(substr(id, 3) AS BIGINT) % 4 != 0 AND CAST(substr(id, 3) AS BIGINT) % 3 = 0""")
def people_search(spark, sf_dir):
    return reports.search(state_of(spark, sf_dir), q=" Labs INC ", persona="founder", limit=None).select("id", "full_name", "persona", "total")


@query(f"""{STATE_SQL}, f AS (SELECT id, full_name, band FROM folk JOIN sb ON person_id = id WHERE merged_into IS NULL AND band = 'review' AND (blocked_reason IS NOT NULL OR score < 1))
SELECT id, full_name, band, (SELECT count(*) FROM f) AS found FROM f ORDER BY id LIMIT 20""")
def people_search_page(spark, sf_dir):
    return reports.search(state_of(spark, sf_dir), band="review", incomplete=True, limit=20).select("id", "full_name", "band", "found")


@query(f"{STATE_SQL} SELECT f.id, f.merged_into FROM folk f WHERE merged_into = (SELECT min(merged_into) FROM folk)")
def merged_children(spark, sf_dir):
    state = state_of(spark, sf_dir)
    first = state["people"].agg(F.min("merged_into")).first()[0]
    return reports.person(state, first)["merged"].select("id", "merged_into")


@query(f"{STATE_SQL} SELECT r.a, r.b, CASE WHEN r.a = 'p-00000003' THEN r.b ELSE r.a END AS other, round(r.score / 100, 4) AS score, n.full_name AS other_name FROM routed r JOIN norm n ON n.id = CASE WHEN r.a = 'p-00000003' THEN r.b ELSE r.a END WHERE r.a = 'p-00000003' OR r.b = 'p-00000003'")
def person_neighbors(spark, sf_dir):
    return reports.person(state_of(spark, sf_dir), "p-00000003")["suggestions"].select("a", "b", "other", "score", "other_name")


@query(f"{STATE_SQL} SELECT canonical_id, source_ids, decided_by, full_name FROM plan WHERE NOT (c1 OR c2 OR c3) ORDER BY canonical_id DESC LIMIT 100")
def merges_log(spark, sf_dir):
    plans = state_of(spark, sf_dir)["plans"].withColumn("created_at", F.lit("2024-06-01"))
    return reports.merges(plans).select("canonical_id", joined("source_ids").alias("source_ids"), "decided_by", "resolved.full_name")


@query(f"""{STATE_SQL}, mm AS (SELECT (SELECT count(*) FROM need) AS pending, (SELECT count_if(verdict != 'insufficient_evidence') FROM open_) AS auto_resolved, (SELECT count_if(NOT (c1 OR c2 OR c3)) FROM plan) AS merged_clusters,
  (SELECT count(*) FROM folk WHERE merged_into IS NULL AND (blocked_reason IS NOT NULL OR score < 1)) AS incomplete, (SELECT count(*) FROM folk WHERE merged_into IS NULL AND blocked_reason IS NOT NULL) AS blocked,
  (SELECT count(*) FROM sb) AS applicants, (SELECT count_if(band = 'review') FROM sb) AS needs_review, (SELECT count_if(band = 'strong') FROM sb) AS strong, (SELECT count_if(review_state = 'pending') FROM routed) AS introductions,
  (SELECT count_if(CAST(substr(id, 3) AS BIGINT) % 4 != 0) FROM norm) AS enriched, (SELECT count_if(merged_into IS NULL) FROM folk) AS canonical)
SELECT metric, n FROM mm UNPIVOT (n FOR metric IN (pending, auto_resolved, merged_clusters, incomplete, blocked, applicants, needs_review, strong, introductions, enriched, canonical))""")
def queue_counts(spark, sf_dir):
    return reports.queue_counts(state_of(spark, sf_dir))


@query(f"""{STATE_SQL}, mm AS (SELECT (SELECT count(*) FROM norm) AS people, (SELECT count_if(merged_into IS NULL) FROM folk) AS canonical, (SELECT count(*) FROM norm) AS enrichment, (SELECT count_if(CAST(substr(id, 3) AS BIGINT) % 4 != 0) FROM norm) AS enriched,
  (SELECT count(*) FROM sb) AS applicant_scores, (SELECT count_if(CAST(substr(person_id, 3) AS BIGINT) % 3 = 0) FROM sb) AS explained, (SELECT count(*) FROM routed) AS introductions, (SELECT count_if(score >= 90) FROM routed) AS intros_with_copy, (SELECT count_if(review_state = 'pending') FROM routed) AS intros_suggested)
SELECT metric, n FROM mm UNPIVOT (n FOR metric IN (people, canonical, enrichment, enriched, applicant_scores, explained, introductions, intros_with_copy, intros_suggested))""")
def health_counts(spark, sf_dir):
    return reports.health(state_of(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN n_chars / 100000.0 <= 1 THEN floor(n_chars / 100000.0 * 100 + 0.5)::BIGINT::VARCHAR ELSE floor(n_chars / 100000.0 + 0.5)::BIGINT::VARCHAR END AS score, source FROM documents")
def display_score(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", text.score100(F.col("n_chars") / 100000.0).alias("score"), text.join_parts(F.col("source"), F.lit(" ")).alias("source"))


# --- evaluation ------------------------------------------------------------------------------------------------------

TRUTH_SQL = "truth AS (SELECT x.id AS a, y.id AS b FROM norm x JOIN norm y ON CAST(substr(y.id, 3) AS BIGINT) = CAST(substr(x.id, 3) AS BIGINT) + 1 WHERE CAST(substr(y.id, 3) AS BIGINT) % 7 = 3)"


def truth_of(n: DataFrame) -> DataFrame:
    k = n.select(F.col("id").substr(3, 8).cast("long").alias("k"), "id")
    return k.filter("k % 7 = 3").select((F.col("k") - 1).alias("k"), F.col("id").alias("b")).join(k.withColumnRenamed("id", "a"), "k").select("a", "b")


@query(f"""WITH RECURSIVE {O.ROUTED}, {TRUTH_SQL}, j AS (SELECT t.a IS NOT NULL AS t, coalesce(r.verdict = 'same_person', false) AS p, coalesce(r.method = 'escalated_not_adjudicated', false) AS u FROM truth t FULL JOIN routed r ON r.a = t.a AND r.b = t.b),
  m AS (SELECT count_if(t AND p AND NOT u) AS tp, count_if(NOT t AND p AND NOT u) AS fp, count_if(t AND NOT (p AND NOT u) AND NOT u) AS fn, count_if(t AND u) AS unresolved_truth FROM j), q AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / (tp + fn)::DOUBLE AS re FROM m)
SELECT tp, fp, fn, unresolved_truth, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / (pr + re), 4) AS f1 FROM q""")
def pair_metrics(spark, sf_dir):
    n = norm(spark, sf_dir)
    pairs = materialize(cascade.route(n, blocking.candidates(n)), "pairs")
    return evaluate.pair_metrics(truth_of(n), *evaluate.split_predictions(pairs))


@query(f"""WITH RECURSIVE {O.ROUTED}, near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM norm x JOIN norm y ON x.lname = y.lname AND x.ckey = y.ckey AND x.id < y.id AND x.fname != y.fname)
SELECT count(*) AS near_misses, round(avg(CASE WHEN r.a IS NULL THEN 1.0 ELSE 0.0 END), 4) AS rejection_rate FROM near LEFT JOIN (SELECT a, b FROM routed WHERE verdict = 'same_person') r USING (a, b)""")
def near_miss_rate(spark, sf_dir):
    n = norm(spark, sf_dir)
    side = n.select("id", F.col("name.last").alias("l"), F.col("name.first").alias("f"), "company_key")
    near = side.select(F.col("id").alias("a"), "l", "company_key", F.col("f").alias("fa")).join(side.select(F.col("id").alias("b"), "l", "company_key", F.col("f").alias("fb")), ["l", "company_key"]).filter("a < b AND fa != fb").select("a", "b").distinct()
    return evaluate.near_miss_rate(near, evaluate.split_predictions(cascade.route(n, blocking.candidates(n)))[0])


@query(f"""WITH RECURSIVE {O.SCORED}, {TRUTH_SQL}, d AS (SELECT a, b, 'stage1_merged' AS outcome, 100.0 AS score, NULL::DOUBLE AS nm, NULL::DOUBLE AS comp FROM settled WHERE exact IS NOT NULL UNION ALL SELECT a, b, CASE WHEN score >= 92 THEN 'stage2_auto_merged' WHEN score >= 78 THEN 'stage2_escalated' ELSE 'stage2_dropped' END, score, nm, comp FROM scored),
  shared AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y USING (key) JOIN truth t ON t.a = x.id AND t.b = y.id)
SELECT t.a, t.b, coalesce(outcome, 'never_a_candidate') AS outcome, CASE WHEN outcome IS NULL AND s.a IS NULL THEN 'never became a candidate: no shared blocking key' WHEN outcome IS NULL THEN 'never became a candidate: blocking bucket too large'
  WHEN outcome = 'stage2_dropped' THEN 'scored ' || score::VARCHAR || ' < ESCALATE_FLOOR (name ' || round(nm::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE::VARCHAR || ', company ' || coalesce(round(comp::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE::VARCHAR, 'None') || ')'
  WHEN outcome = 'stage2_escalated' THEN 'escalated at ' || score::VARCHAR || ', awaiting stage 3' ELSE outcome END AS why FROM truth t LEFT JOIN d USING (a, b) LEFT JOIN shared s ON s.a = t.a AND s.b = t.b""")
def miss_diagnosis(spark, sf_dir):
    n = norm(spark, sf_dir)
    return cascade.explain_miss(truth_of(n), n, materialize(blocking.candidates(n), "candidates"))


@query(f"""{PLAN_SQL}, {TRUTH_SQL}, held AS (SELECT unnest(string_split(source_ids, '|')) AS id, cluster FROM plan WHERE NOT (c1 OR c2 OR c3)), made AS (SELECT x.id AS a, y.id AS b FROM held x JOIN held y USING (cluster) WHERE x.id < y.id),
  mt AS (SELECT (SELECT count(*) FROM truth JOIN made USING (a, b)) AS tp, (SELECT count(*) FROM made) AS n, (SELECT count(*) FROM truth) AS t), q AS (SELECT tp, n - tp AS fp, t - tp AS fn, tp / n::DOUBLE AS pr, tp / t::DOUBLE AS re FROM mt)
SELECT tp, fp, fn, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / (pr + re), 4) AS f1 FROM q""")
def effective_metrics(spark, sf_dir):
    """Of the pairs that are merged in effect, transitively; groups held back by a conflict merge nothing."""
    n = norm(spark, sf_dir)
    plans = survivorship.build_plans(n, materialize(cascade.route(n, blocking.candidates(n)), "pairs"))
    members = plans.filter("status = 'merged'").select("cluster", F.explode("source_ids").alias("id"))
    return evaluate.group_metrics(truth_of(n), materialize(members, "members"))


def half_sql(part: int) -> str:
    """The cascade's figures on half of the people, by a rule on the id."""
    norm_ = O.ROUTED.replace(" AS blocked_reason FROM listed)", f" AS blocked_reason FROM listed WHERE CAST(substr(id, 3) AS BIGINT) // 14 % 2 = {part})")
    return f"""(WITH RECURSIVE {norm_}, {TRUTH_SQL}, j AS (SELECT t.a IS NOT NULL AS t, coalesce(r.verdict = 'same_person', false) AS p, coalesce(r.method = 'escalated_not_adjudicated', false) AS u FROM truth t FULL JOIN routed r ON r.a = t.a AND r.b = t.b),
  m AS (SELECT count_if(t AND p AND NOT u) AS tp, count_if(NOT t AND p AND NOT u) AS fp, count_if(t AND NOT (p AND NOT u) AND NOT u) AS fn FROM j), q AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / (tp + fn)::DOUBLE AS re FROM m)
  SELECT metric, value FROM (SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / (pr + re), 4) AS f1 FROM q) UNPIVOT (value FOR metric IN (tp, fp, fn, precision, recall, f1)))"""


@query(f"SELECT metric, x.value AS tuned, y.value AS held_out, y.value < x.value AS regressed FROM {half_sql(0)} x JOIN {half_sql(1)} y USING (metric)")
def holdout_compare(spark, sf_dir):
    n = norm(spark, sf_dir)

    def run(part: int) -> DataFrame:
        half = materialize(n.filter(F.expr("CAST(substr(id, 3) AS BIGINT) div 14") % 2 == part), "half")
        pairs = materialize(cascade.route(half, blocking.candidates(half)), "pairs")
        return evaluate.as_metrics(evaluate.pair_metrics(truth_of(half), *evaluate.split_predictions(pairs)).drop("unresolved_truth"))

    return evaluate.compare_runs(run(0), run(1))


# --- layers, answers and texts ---------------------------------------------------------------------------------------


@query(f"WITH {O.KEYS}, {O.SIDES} SELECT a, b, coalesce({O.fits('af', 'bf')} AND {O.fits('al', 'bl')} AND NOT (af = bf AND al = bl), false) AS lifted FROM settled")
def initials_match(spark, sf_dir):
    n = norm(spark, sf_dir)
    rows = cascade.attach(blocking.candidates(n), n)
    return rows.select("a", "b", (similarity.name_score("ra", "rb", F.lit(1.0)) == INITIAL_SCORE).alias("lifted"))


@query(f"WITH {O.KEYS} SELECT a, b, array_to_string(list_transform(keys, lambda k: {O.mapping(text.KEY_LABELS)}[k]), ', ') AS label FROM cand")
def blocking_labels(spark, sf_dir):
    return blocking.candidates(norm(spark, sf_dir)).select("a", "b", text.blocking_keys(F.col("keys")).alias("label"))


UPSERT_SQL = f"""WITH people AS ({O.PEOPLE_SQL}), new AS (SELECT * REPLACE ('Advisor' AS title) FROM people WHERE CAST(substr(id, 3) AS BIGINT) % 3 = 0),
  old AS (SELECT * FROM people WHERE CAST(substr(id, 3) AS BIGINT) % 2 = 0) SELECT id, title, ingested_at, merged_into FROM (
  SELECT id, title, '2024-01-02' AS ingested_at, NULL::VARCHAR AS merged_into FROM new UNION ALL SELECT id, title, '2024-01-01', 'p-x' FROM old WHERE id NOT IN (SELECT id FROM new))"""


@query(UPSERT_SQL)
def people_upsert(spark, sf_dir):
    rows = materialize(people(spark, sf_dir), "people")
    k = F.col("id").substr(3, 8).cast("long")
    old = rows.filter(k % 2 == 0).withColumns({"ingested_at": F.lit("2024-01-01"), "merged_into": F.lit("p-x")})
    return layers.load_people(old, rows.filter(k % 3 == 0).withColumn("title", F.lit("Advisor")), "2024-01-02").select("id", "title", "ingested_at", "merged_into")


@query("""WITH q AS (SELECT event_id, user_id % 3 != 0 AS hit FROM events), c AS (SELECT count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS misses FROM q)
SELECT cache_hits, misses, ceil(misses / 8)::BIGINT AS calls, round(cache_hits / (cache_hits + misses), 4) AS hit_rate, ceil(misses / 8) <= 300 AS within_budget FROM c""")
def answer_usage(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"].select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("payload"), "user_id", F.col("ts").alias("created_at"))
    cached = answers.Replay(e.filter("user_id % 3 != 0").withColumn("response", F.col("payload")))
    return answers.usage(answers.ask(e.select("key", "payload"), cached), 8)


@query(f"WITH e AS ({ENRICH_SQL}) SELECT o_custkey AS person, coalesce(persona, 'unknown') AS persona, coalesce(confidence, 0) AS confidence, coalesce(confidence, 0) < 0.5 AS low_confidence FROM (SELECT DISTINCT o_custkey + 100 AS o_custkey FROM orders) LEFT JOIN e ON person_id = CAST(o_custkey AS STRING)")
def enrichment_complete(spark, sf_dir):
    ids = tables(spark, sf_dir, "orders")["orders"].select((F.col("o_custkey") + 100).cast("string").alias("id")).distinct()
    return enrichment.complete(ids, answers_of(spark, sf_dir)).select(F.col("person_id").cast("long").alias("person"), "persona", "confidence", "low_confidence")


@query(f"WITH e AS ({ENRICH_SQL}) SELECT o_custkey AS person FROM (SELECT DISTINCT o_custkey + 100 AS o_custkey FROM orders) WHERE CAST(o_custkey AS STRING) NOT IN (SELECT person_id FROM e WHERE confidence > 0)")
def enrichment_remaining(spark, sf_dir):
    ids = tables(spark, sf_dir, "orders")["orders"].select((F.col("o_custkey") + 100).cast("string").alias("id")).distinct()
    return enrichment.remaining(ids, answers_of(spark, sf_dir)).select(F.col("id").cast("long").alias("person"))


@query(f"WITH people AS ({O.PEOPLE_SQL}), t AS (SELECT id, CASE WHEN regexp_matches(full_name, '[a-z]') THEN full_name ELSE array_to_string(list_transform(string_split(full_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS shown FROM people) SELECT id, shown, split_part(shown, ' ', 1) AS first FROM t")
def display_names(spark, sf_dir):
    return materialize(people(spark, sf_dir), "people").select("id", text.title_case(F.col("full_name")).alias("shown"), text.first_name(F.col("full_name")).alias("first"))


@query(f"WITH people AS ({O.PEOPLE_SQL}) SELECT id, coalesce(nullif(replace(concat_ws(' ', nullif(title, ''), nullif(company, ''), nullif(bio, '')), '_', ' '), ''), full_name, '') AS profile FROM people")
def profile_text(spark, sf_dir):
    null = F.lit(None).cast("string")
    rows = materialize(people(spark, sf_dir), "people").withColumns({c: null for c in ("persona", "sector", "geography")})
    return rows.select("id", text.profile_text().alias("profile"))


@query(f"""WITH {LOG_SQL}, l AS (SELECT a, b, max(struct_pack(d := decided_at, k := decision)) AS s FROM log GROUP BY a, b), i AS (SELECT DISTINCT b AS x, a AS y FROM log UNION SELECT 1000, 2000)
SELECT x AS a, y AS b, CASE s.k WHEN 'block' THEN 'dismissed' ELSE 'suggested' END AS status, CASE WHEN s.k != 'restore' THEN s.d END AS decided_at FROM i LEFT JOIN l ON l.a = y AND l.b = x""")
def intro_decisions(spark, sf_dir):
    log = log_of(spark, sf_dir)
    pairs = log.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().unionByName(spark.sql("SELECT 1000L AS a, 2000L AS b"))
    return decisions.intro_states(pairs, log).select("a", "b", "status", "decided_at")


@query(f"WITH e AS ({ENRICH_SQL}), n AS (SELECT * REPLACE ('unknown' AS sector) FROM e WHERE CAST(person_id AS BIGINT) % 3 = 0), o AS (SELECT * FROM e WHERE CAST(person_id AS BIGINT) % 2 = 0), g AS (SELECT * FROM n WHERE {VALID_SQL}) SELECT person_id, sector FROM g UNION ALL SELECT person_id, sector FROM o WHERE person_id NOT IN (SELECT person_id FROM g)")
def enrichment_upsert(spark, sf_dir):
    rows = answers_of(spark, sf_dir)
    k = F.col("person_id").cast("long")
    return enrichment.store(rows.filter(k % 2 == 0), rows.filter(k % 3 == 0).withColumn("sector", F.lit("unknown")))[0].select("person_id", "sector")


@query(f"""WITH e AS ({ENRICH_SQL}), r AS (SELECT CAST(c_custkey AS STRING) AS person_id, CASE WHEN c_custkey % 5 != 0 THEN 'Works as ' || c_mktsegment END AS bio FROM customer UNION ALL SELECT 'x-' || CAST(n_nationkey AS STRING), NULL FROM nation),
  j AS (SELECT r.person_id, bio, e.persona, e.confidence, e.person_id IS NOT NULL AS got FROM r LEFT JOIN e USING (person_id)),
  f AS (SELECT count(*)::DOUBLE AS records, count_if(got)::DOUBLE AS returned, count_if(NOT got)::DOUBLE AS missing, count_if(got AND persona = 'unknown')::DOUBLE AS unknown_persona, count_if(got AND confidence < 0.5)::DOUBLE AS low_confidence, round(avg(coalesce(confidence, 0)), 3) AS mean_confidence,
    count_if(got)::DOUBLE AS evidence_total, count_if(got AND bio IS NOT NULL)::DOUBLE AS evidence_verified, count_if(got AND bio IS NULL)::DOUBLE AS records_with_bad_evidence, round(count_if(got AND bio IS NOT NULL) / count_if(got)::DOUBLE, 4) AS evidence_rate FROM j)
SELECT metric, value FROM f UNPIVOT (value FOR metric IN (records, returned, missing, unknown_persona, low_confidence, mean_confidence, evidence_total, evidence_verified, records_with_bad_evidence, evidence_rate))""")
def enrichment_funnel(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "nation")
    null = F.lit(None).cast("string")
    rows = t["customer"].select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("Works as "), "c_mktsegment")).alias("bio")).unionByName(t["nation"].select(F.concat(F.lit("x-"), F.col("n_nationkey").cast("string")).alias("id"), null.alias("bio")))
    records = rows.select("id", "bio", *(null.alias(c) for c in ("full_name", "email", "linkedin_url", "company", "title", "location")), *(F.array().cast("array<string>").alias(c) for c in ("needs", "offers")))
    return enrichment.funnel(records, answers_of(spark, sf_dir))


@query(f"WITH e AS ({ENRICH_SQL}), o AS (SELECT DISTINCT CAST(o_custkey + 100 AS STRING) AS person_id FROM orders) SELECT (SELECT count(*) FROM customer) AS canonical, (SELECT count(*) FROM e WHERE confidence > 0) AS enriched, (SELECT count(*) FROM o) AS applicants, (SELECT count(*) FROM e JOIN o USING (person_id) WHERE confidence > 0) AS applicants_enriched")
def backfill_progress(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "orders")
    folk = t["customer"].select(F.col("c_custkey").cast("string").alias("id"), F.lit(None).cast("string").alias("merged_into"))
    return enrichment.progress(folk, answers_of(spark, sf_dir), t["orders"].select((F.col("o_custkey") + 100).cast("string").alias("person_id")).distinct())


@query(f"{RUBRIC_SQL} SELECT person_id, p1::DOUBLE AS persona_fit, p5 AS profile_signal, total, CASE WHEN band = 'weak' THEN 'why_not' ELSE 'why' END AS explanation_kind, '12.345|999' AS unsupported FROM b")
def score_audit(spark, sf_dir):
    """Scores to store, with prose that names the total, the points of a component, and two numbers that nothing supports."""
    scores = materialize(scores_of(spark, sf_dir), "scores")
    said = F.concat(F.lit("In all "), F.col("total").cast("string"), F.lit(" of 100, 12.345 better than 999 others"))
    prose = scores.select("person_id", said.alias("explanation"), F.array(F.concat(F.lit("persona_fit: "), F.col("components")[0]["points"].cast("int").cast("string"))).alias("bullets"))
    return rubric.score_rows(scores, prose, "2024-01-01").select("person_id", "persona_fit", "profile_signal", "total", "explanation_kind", F.array_join("unsupported_numbers", "|").alias("unsupported"))


@query("SELECT vec_id::VARCHAR AS person_id, 'profile' AS kind, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS first, 'given' AS model FROM embeddings")
def embedding_rows(spark, sf_dir):
    v = tables(spark, sf_dir, "embeddings")["embeddings"].select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("profile"))
    return layers.embedding_rows(v, "given", "2024-01-01").select("person_id", "kind", "dim", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), "model")


@query("SELECT to_json({'status': status, 'n': count(s.status)})::VARCHAR AS report FROM (SELECT unnest(['suggested', 'approved', 'dismissed']) AS status) LEFT JOIN (SELECT CASE event_type WHEN 'view' THEN 'suggested' WHEN 'purchase' THEN 'approved' ELSE 'other' END AS status FROM events) s USING (status) GROUP BY status")
def report_json(spark, sf_dir):
    return reports.as_json(status_counts_zero_filled(spark, sf_dir))


@query("""WITH d AS (SELECT o_custkey % 50 AS a, 50 + o_orderkey % 50 AS b, max(o_orderpriority) AS note FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), c AS (SELECT DISTINCT o_custkey % 50 AS a, 50 + o_orderkey % 50 AS b FROM orders)
SELECT a, b, note FROM d UNION ALL SELECT a, b, 'new' FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.a = c.a AND d.b = c.b)""")
def intro_rewrite(spark, sf_dir):
    """Suggestions written anew, decided ones as they were."""
    o = tables(spark, sf_dir, "orders")["orders"].withColumns({"a": F.col("o_custkey") % 50, "b": 50 + F.col("o_orderkey") % 50})
    kept = o.filter("o_orderstatus = 'F'").groupBy("a", "b").agg(F.max("o_orderpriority").alias("note"))
    return layers.rewrite_keeping(o.select("a", "b", F.lit("new").alias("note")).distinct(), kept, ["a", "b"])


@query("WITH q AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events WHERE event_type = 'click') SELECT event_id, n // 10 AS batch, n % 10 AS pair_index FROM q")
def adjudication_batches(spark, sf_dir):
    e = tables(spark, sf_dir, "events")["events"].filter("event_type = 'click'")
    return cascade.batches(e.select("event_id", F.col("event_id").alias("a"), F.lit(0).alias("b"))).select("event_id", "batch", "pair_index")


@query("SELECT event_type AS stage, max(event_id) AS id, arg_max(user_id, event_id) AS records_in FROM events GROUP BY event_type")
def last_runs(spark, sf_dir):
    """The last run of every stage of a run log made from events."""
    e = tables(spark, sf_dir, "events")["events"]
    zero = F.lit(0).cast("long")
    runs = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.date_format("ts", "yyyy-MM-dd").alias("started_at"), zero.alias("llm_calls"), zero.alias("cache_hits"), F.col("user_id").alias("records_in"), zero.alias("records_out"), F.create_map(F.lit("x"), F.lit(1).cast("long")).alias("notes"))
    kinds = [r.stage for r in runs.select("stage").distinct().collect()]  # a closed list of stages
    out = [layers.last_run(runs, k).select("stage", "id", "records_in") for k in kinds]
    return reduce(DataFrame.unionByName, out)
