"""Scores of applications by a fixed rubric: points, signals and bands are all computed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import strip
from ..functions.normalize import table
from ..functions.tables import COMPONENTS, CONTRIBUTION_POINTS, PERSONA_POINTS, PERSONA_SIGNALS, PROFILE_MAX, REFERRAL_POINTS, REFERRAL_SIGNALS, REVIEW, SENIORITY_POINTS, STAGE_POINTS, STAGE_SIGNALS, STRONG, TRACTION, TRACTION_POINTS


def _points(values: dict[str, int], key: Column, default: str = "unknown") -> Column:
    lookup = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(lookup, key), F.lit(values[default])).cast("double")


def band(total: Column) -> Column:
    return F.when(total >= STRONG, "strong").when(total >= REVIEW, "review").otherwise("weak")


def referral_class(referred_by: Column, is_member: Column) -> Column:
    return F.when(referred_by.isNull() | (referred_by == ""), "none").when(is_member, "member").otherwise("unknown_referrer")


def members(people: DataFrame) -> DataFrame:
    """People already in: canonical, and not known from an application only."""
    return people.filter("merged_into IS NULL AND (source IS NULL OR source != 'applicant_form')").select("id")


def score_applicants(applications: DataFrame, enrichment: DataFrame, completeness: DataFrame, members: DataFrame) -> DataFrame:
    """(person_id, components, total, band, kind) of every application; missing inputs count as unknown or nothing."""
    rows = applications.join(enrichment.select("person_id", "persona", "seniority", "company_stage"), "person_id", "left")
    rows = rows.join(completeness.select(F.col("id").alias("person_id"), F.col("score").alias("complete")), "person_id", "left")
    rows = rows.join(members.select(F.col("id").alias("referred_by"), F.lit(True).alias("is_member")).distinct(), "referred_by", "left")
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = rows.withColumns({c: known(c) for c in ("persona", "seniority", "company_stage")}).withColumn("complete", F.coalesce("complete", F.lit(0.0)))
    rows = rows.withColumn("ref", referral_class(F.col("referred_by"), F.coalesce("is_member", F.lit(False))))
    traction = F.coalesce(F.col("building_now").rlike(TRACTION), F.lit(False))
    contributes = F.coalesce(strip(F.col("contribution")) != "", F.lit(False))
    profile = F.round(F.round(F.col("complete") * PROFILE_MAX, 2) + F.when(traction, TRACTION_POINTS).otherwise(0) + F.when(contributes, CONTRIBUTION_POINTS).otherwise(0), 2)
    said = F.concat_ws("; ", F.concat(F.lit("profile "), F.round(F.col("complete") * 100).cast("int").cast("string"), F.lit("% complete")), F.when(traction, "application states concrete traction").otherwise("no concrete traction figure given"), F.when(contributes, "says what they would contribute").otherwise("does not say what they would contribute"))
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    parts = {
        "persona_fit": (_points(PERSONA_POINTS, F.col("persona")), F.coalesce(F.element_at(table(PERSONA_SIGNALS), F.col("persona")), F.lit(PERSONA_SIGNALS["unknown"])), F.concat(F.lit("enrichment.persona="), "persona")),
        "seniority": (_points(SENIORITY_POINTS, F.col("seniority")), F.when(F.col("seniority") == "unknown", "seniority not evidenced in the record").otherwise(F.concat(F.lit("operating seniority: "), spaced("seniority"))), F.concat(F.lit("enrichment.seniority="), "seniority")),
        "company_stage": (_points(STAGE_POINTS, F.col("company_stage")), F.coalesce(F.element_at(table(STAGE_SIGNALS), F.col("company_stage")), F.concat(F.lit("company at "), spaced("company_stage"))), F.concat(F.lit("enrichment.company_stage="), "company_stage")),
        "referral_signal": (_points(REFERRAL_POINTS, F.col("ref"), "none"), F.element_at(table(REFERRAL_SIGNALS), F.col("ref")), F.concat(F.lit("application.referred_by="), F.coalesce(F.nullif("referred_by", F.lit("")), F.lit("null")))),
        "profile_signal": (profile, said, F.lit("record completeness + application text")),
    }
    components = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("points"), F.lit(COMPONENTS[n]).alias("max_points"), s.alias("signal"), b.alias("basis")) for n, (p, s, b) in parts.items()))
    rows = rows.select("person_id", components.alias("components"))
    rows = rows.withColumn("total", F.round(F.aggregate("components", F.lit(0.0), lambda s, c: s + c["points"]), 2)).withColumn("band", band(F.col("total")))
    return rows.withColumn("kind", F.when(F.col("band") == "weak", "why_not").otherwise("why"))


def by_share(n: int = 2, strongest: bool = True) -> Column:
    """Names of the components of greatest (or least) share of their points; the rubric's order breaks ties."""
    sign = -1 if strongest else 1
    keyed = F.transform("components", lambda c, i: F.struct((sign * c["points"] / c["max_points"]).alias("k"), i.alias("i"), c["name"].alias("name")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["name"])


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), 0))


def _number_text(x: Column) -> Column:
    """As Python writes a float of up to two decimals."""
    return F.regexp_replace(F.format_string("%.2f", x), r"0$", "")


def allowed_numbers() -> Column:
    """Numbers that a text about a breakdown (total, components) may use."""
    own = F.flatten(F.transform("components", lambda c: F.concat(F.array(_number_text(c["points"]), F.regexp_replace(_number_text(c["points"]), r"\.0$", ""), c["points"].cast("int").cast("string"), c["max_points"].cast("string")), numbers_in(c["signal"]))))
    fixed = F.array(*(F.lit(str(x)) for x in (100, STRONG, REVIEW)))
    return F.array_distinct(F.concat(F.array(_number_text(F.col("total")), F.col("total").cast("int").cast("string")), own, fixed))


def unsupported_numbers(text: Column) -> Column:
    return F.sort_array(F.array_except(numbers_in(text), allowed_numbers()))


def score_rows(scores: DataFrame, prose: DataFrame, now: str) -> DataFrame:
    """Rows to store: points by component, prose (person_id, explanation, bullets) and the numbers in it that the score doesn't support."""
    none = F.array().cast("array<string>")
    rows = scores.join(prose.select("person_id", "explanation", "bullets"), "person_id", "left")
    rows = rows.withColumns({"explanation": F.coalesce("explanation", F.lit("")), "bullets": F.coalesce("bullets", none)})
    points = [F.col("components")[i]["points"].alias(n) for i, n in enumerate(COMPONENTS)]  # the rubric's order
    said = F.concat(F.col("explanation"), F.lit(" "), F.array_join("bullets", " "))
    return rows.select("person_id", *points, "total", "band", F.to_json("components").alias("signals"), "explanation", "bullets", F.col("kind").alias("explanation_kind"), unsupported_numbers(said).alias("unsupported_numbers"), F.lit(now).alias("created_at"))


def summarise(scores: DataFrame) -> DataFrame:
    """Applicants by band, those explained and those declined; explanation may be missing as a column."""
    e = F.col("explanation") if "explanation" in scores.columns else F.lit("")
    return scores.agg(F.count(F.lit(1)).alias("applicants"), *(F.count_if(F.col("band") == b).alias(b) for b in ("strong", "review", "weak")), F.count_if(F.coalesce(e, F.lit("")) != "").alias("explained"), F.count_if(F.col("kind") == "why_not").alias("why_not"))
