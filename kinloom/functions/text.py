"""Texts for people and models: keys of cached answers, prompts, and how stored values read on a screen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import strip
from .normalize import table
from .tables import ENUMS

# Labels of blocking keys, methods, verdicts, states and merge reasons, and acronyms that stay in capitals.
KEY_LABELS = {"li": "LinkedIn slug", "em": "email", "co": "company + surname", "nl": "surname + city", "nm": "first name"}
METHOD_LABELS = {"exact_email": "identical email", "exact_linkedin": "identical LinkedIn", "fuzzy_auto": "fuzzy name and company match", "llm_adjudication": "reviewed by the model", "escalated_not_adjudicated": "escalated, not yet reviewed"}
VERDICT_LABELS = {"same_person": "same person", "different_people": "different people", "insufficient_evidence": "not enough evidence to say"}
STATUS_LABELS = {"suggested": "suggested", "approved": "approved", "dismissed": "dismissed", "auto_merged": "merged automatically", "pending": "awaiting a decision", "rejected": "rejected"}
INTRO_LABELS = {"suggested": "Awaiting your approval", "approved": "Approved", "dismissed": "Dismissed"}
MERGE_LABELS = {"stage1_exact": "matched on an identical email or LinkedIn profile", "stage2_fuzzy": "matched on name and company", "llm": "settled by model adjudication", "human": "merged by you"}
COMPONENT_LABELS = {"persona_fit": "Persona fit", "seniority": "Seniority", "company_stage": "Company stage", "referral_signal": "Referral", "profile_signal": "Profile signal"}
ACRONYMS = [
    "AI", "API", "APAC", "AVP", "BD", "CEO", "CFO", "CIO", "CISO", "CMO", "COO", "CPO", "CRO", "CTO", "CX", "EMEA", "EU", "EVP", "GM", "GP", "HR", "IC", "IPO", "IT", "KPI", "LP", "MD", "ML", "NLP",
    "OKR", "PE", "PR", "QA", "R&D", "ROI", "SDR", "SEO", "SRE", "SVP", "UI", "UK", "US", "USA", "UX", "VC", "VP",
]


def cache_key(provider: Column, model: Column, task: Column, payload: Column) -> Column:
    """payload: JSON with sorted keys and no spaces (see canonical_json)."""
    return F.sha2(F.concat_ws("|", provider, model, task, payload).cast("binary"), 256)


def canonical_json(**fields: Column) -> Column:
    """JSON of scalar fields with sorted keys; nulls stay."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def safe_task(task: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(task), "[^a-z0-9_]+", "_"), F.lit("")), F.lit("task"))


def label(c: Column, labels: dict[str, str] | None = None) -> Column:
    spaced = F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))
    return F.coalesce(F.element_at(table(labels), c), spaced) if labels else spaced


def blocking_keys(codes: Column) -> Column:
    named = F.transform(codes, lambda k: F.coalesce(F.element_at(table(KEY_LABELS), k), k))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.array_join(named, ", ")).otherwise("no shared key")


def score100(v: Column) -> Column:
    """A score of any scale as an integer of 0 to 100; none as a dash."""
    return F.when(v.isNull(), "—").otherwise(F.floor(F.when(v <= 1, v * 100).otherwise(v) + 0.5).cast("long").cast("string"))


def join_parts(*parts: Column, separator: str = " · ") -> Column:
    return F.concat_ws(separator, *(F.nullif(strip(p), F.lit("")) for p in parts))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def intro_reason(c: Column) -> Column:
    return F.coalesce(_capital(F.regexp_replace(strip(c), r"(?i)^they should meet because\s+", "")), F.lit(""))


def truncate_words(c: Column, most: int = 120) -> Column:
    """At most so many characters, cut at a word if one ends in the second half."""
    cut = F.substring(c, 1, most)
    at = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    short = F.substr(cut, F.lit(1), F.when(at > most * 0.5, at).otherwise(most))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(short, r"[,;:.\s]+$", ""), F.lit("…")))


def match_reason(c: Column) -> Column:
    """The stored reason of a match as a sentence."""
    t = strip(c)
    pattern = r"(?i)^name ([\d.]+), company ([\d.]+|None|null), title agrees: (True|False|None)$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    how = lambda x: F.when(F.try_to_number(x, F.lit("999D99")) >= 99, "exactly").when(F.try_to_number(x, F.lit("999D99")) >= 90, "almost exactly").when(F.try_to_number(x, F.lit("999D99")).isNotNull(), "loosely")
    role = F.when(F.lower(part(3)) == "true", "same role").when(F.lower(part(3)) == "false", "different roles")
    sentence = F.concat_ws(", ", F.concat(F.lit("names match "), how(part(1))), F.coalesce(F.concat(F.lit("company matches "), how(part(2))), F.lit("no company to compare")), role)
    return F.when(F.lower(t) == "identical normalized email", "Identical email address").when(F.lower(t) == "identical linkedin slug", "Identical LinkedIn profile").when(t.rlike(pattern), _capital(sentence)).otherwise(F.coalesce(t, F.lit("")))


def title_case(c: Column) -> Column:
    """Text in capitals alone with a capital a word, acronyms kept; other text as it is."""
    t = F.regexp_replace(strip(c), r"\s+", " ")
    core = lambda w: F.regexp_replace(w, r"^[^A-Za-z&]+|[^A-Za-z&]+$", "")
    word = lambda w: F.when(core(w).isin(ACRONYMS), w).otherwise(F.array_join(F.transform(F.split(F.lower(w), r"(?<=[-/&(.])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), ""))
    return F.coalesce(F.when(t.rlike("[a-z]"), t).otherwise(F.array_join(F.transform(F.split(t, " "), word), " ")), F.lit(""))


def first_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(title_case(c), " ", 1), F.lit("")), F.lit("They"))


def score_bullet(c: Column) -> Column:
    t = strip(c)
    key = F.regexp_extract(t, r"^([a-z][a-z0-9_]*)\s*:\s*", 1)
    name = F.element_at(table(COMPONENT_LABELS), key)
    return F.coalesce(F.concat(name, F.lit(": "), F.regexp_replace(t, r"^([a-z][a-z0-9_]*)\s*:\s*", "")), t, F.lit(""))


def profile_text(record: str = "", enrichment: str = "") -> Column:
    """What a person is, for similarity."""
    p, e = (f"{x}." if x else "" for x in (record, enrichment))
    parts = [F.nullif(F.col(c), F.lit("")) for c in (f"{p}title", f"{p}company", f"{p}bio", f"{e}persona", f"{e}sector", f"{e}geography")]
    return F.coalesce(F.nullif(F.replace(F.concat_ws(" ", *parts), F.lit("_"), F.lit(" ")), F.lit("")), F.col(f"{p}full_name"), F.lit(""))


def render_record(record: str, indent: int = 6, missing: str = "(missing)") -> Column:
    """A record's fields, one a line, for a prompt."""
    fields = {"name": "full_name", "email": "email", "linkedin": "slug", "company": "company", "title": "title", "location": "location", "bio": "bio"}
    return F.concat_ws("\n", *(F.concat(F.lit(f"{' ' * indent}{k}: "), F.coalesce(F.nullif(F.col(f"{record}.{c}"), F.lit("")), F.lit(missing))) for k, c in fields.items()))


def render_pair(index: Column, score: Column) -> Column:
    """A numbered pair (structs ra, rb) for adjudication."""
    return F.concat(F.lit("  Pair "), index.cast("string"), F.lit(" (fuzzy score "), score.cast("string"), F.lit("):\n    Record A ("), F.col("ra.id"), F.lit("):\n"), render_record("ra"), F.lit("\n    Record B ("), F.col("rb.id"), F.lit("):\n"), render_record("rb"))


def render_person(record: str) -> Column:
    """A record for classification; lists joined, empty fields marked."""
    fields = ["full_name", "email", "linkedin_url", "company", "title", "location", "bio"]
    own = [F.concat(F.lit(f"    {c}: "), F.coalesce(F.nullif(F.col(f"{record}.{c}"), F.lit("")), F.lit("(empty)"))) for c in fields]
    lists = [F.concat(F.lit(f"    {c}: "), F.coalesce(F.nullif(F.array_join(f"{record}.{c}", "; "), F.lit("")), F.lit("(empty)"))) for c in ("needs", "offers")]
    return F.concat_ws("\n", F.concat(F.lit("  person_id: "), F.col(f"{record}.id")), *own, *lists)


def render_intro(index: Column, need: Column, offer: Column, back_need: Column, back_offer: Column, reciprocal: Column) -> Column:
    """A numbered suggestion (structs ra, rb) for drafting; the way back only where both sides gain."""
    who = lambda r: F.concat_ws(" — ", F.coalesce(F.nullif(F.col(f"{r}.full_name"), F.lit("")), F.lit("(unnamed)")), F.nullif(F.col(f"{r}.title"), F.lit("")), F.nullif(F.col(f"{r}.company"), F.lit("")))
    line = lambda k, v: F.concat(F.lit(f"    {k}: "), v)
    back = F.when(reciprocal & (F.coalesce(back_need, F.lit("")) != ""), F.concat_ws("\n", line("B needs", back_need), line("A offers", back_offer)))
    return F.concat_ws("\n", F.concat(F.lit("  pair "), index.cast("string"), F.lit(":")), line("person_a", who("ra")), line("person_b", who("rb")), line("reciprocal", F.initcap(reciprocal.cast("string"))), line("A needs", need), line("B offers", offer), back)


def field_spec() -> str:
    """The closed lists, one a line, for a prompt."""
    return "\n".join(f"  {name:<14} {' | '.join(values)}" for name, values in ENUMS.items())


def render_breakdown() -> Column:
    """A score's components, one a line; nothing else of the person."""
    return F.array_join(F.transform("components", lambda c: F.concat(F.lit("    - "), c["name"], F.lit(": "), c["points"].cast("string"), F.lit(" of "), c["max_points"].cast("string"), F.lit(" — "), c["signal"])), "\n")


def estimate_tokens(suggestions: int, prompt_chars: int, batch: int = 4) -> dict[str, int]:
    """Rough cost of drafting: four characters a token, 420 characters a pair, 170 tokens an answer."""
    batches = -(-suggestions // batch) if suggestions else 0
    asked = batches * ((prompt_chars + batch * 420) // 4)
    told = batches * batch * 170
    return {"suggestions": suggestions, "batch_size": batch, "batches": batches, "est_prompt_tokens": asked, "est_completion_tokens": told, "est_total_tokens": asked + told}
