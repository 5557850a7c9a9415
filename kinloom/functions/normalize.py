"""Normalizers of single fields, as column expressions. Null and empty input give null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import ascii_fold, blank_null, collapse, compat_fold, let, literal_map, strip
from .tables import CITY_COUNTRY, CITY_NAMES, DOTLESS_DOMAINS, HONORIFICS, LEGAL_FORMS, NAME_SUFFIXES, PERSONAL_DOMAINS, TITLE_ROLES, TITLE_WORDS


def table(values: dict[str, str]) -> Column:
    return literal_map(tuple(values.items()))


def email(c: Column) -> Column:
    """struct(normalized, local, domain, is_personal)."""
    v = F.regexp_replace(F.lower(F.regexp_replace(strip(compat_fold(blank_null(c))), "^[<>]+|[<>]+$", "")), r"(?U)\s+", "")

    def of(parts: Column) -> Column:
        domain = F.get(parts, F.lit(1))
        plain = F.regexp_replace(F.get(parts, F.lit(0)), r"(?s)\+.*$", "")
        return F.struct(F.size(parts).alias("n"), F.when(domain.isin(DOTLESS_DOMAINS), F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain).alias("local"), domain.alias("domain"))

    def whole(x: Column) -> Column:
        ok = (x["n"] == 2) & x["domain"].contains(".") & (x["local"] != "")
        return F.when(ok, F.struct(F.concat(x["local"], F.lit("@"), x["domain"]).alias("normalized"), x["local"].alias("local"), x["domain"].alias("domain"), x["domain"].isin(PERSONAL_DOMAINS).alias("is_personal")))

    return let(let(F.split(v, "@", -1), of), whole)


def company(c: Column) -> Column:
    """The name without legal forms at its end, in lower-case words."""
    v = F.lower(F.regexp_replace(ascii_fold(blank_null(c)), r"\([^)]*\)", " "))
    v = F.trim(F.regexp_replace(F.replace(v, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    v = F.regexp_replace(v, f"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")
    return blank_null(F.trim(F.regexp_replace(v, "(?:(?:^| )(?:and|the))+$", "")))


def company_key(canonical: Column) -> Column:
    """One word for comparison: legal forms go as long as more than two characters stay."""
    flat = sorted({x.replace(" ", "") for x in LEGAL_FORMS}, key=len, reverse=True)
    pattern = f"^(.{{3,}}?)(?:{'|'.join(flat)})$"
    turns = lambda key: F.sequence(F.lit(0), F.floor(F.length(key) / 2).cast("int"))
    short = lambda key: F.when(key.rlike(pattern), F.aggregate(turns(key), key, lambda k, _: F.regexp_replace(k, pattern, "$1"))).otherwise(key)
    return blank_null(let(F.replace(canonical, F.lit(" "), F.lit("")), short))


def profile_slug(c: Column) -> Column:
    """The last part of a profile's address, or a bare slug."""
    pattern = r"linkedin\.com/(?:in|pub)/([^/?#]+)"
    slug = lambda v: F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1)).when(~v.contains("/") & ~v.contains("linkedin"), F.regexp_replace(v, r"(?s)[?#].*$", ""))
    return blank_null(ascii_fold(let(F.lower(strip(blank_null(c))), slug)))


def clean_title(c: Column) -> Column:
    """Lower-case words with abbreviations expanded and qualifiers and small words dropped."""
    v = F.lower(F.regexp_replace(ascii_fold(blank_null(c)), r"(?i)\([^)]*\)|\b(interim|acting|contract)\b", " "))
    v = F.trim(F.regexp_replace(F.replace(v, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    v = F.regexp_replace(v, r"\bv p\b", "vice president")
    words = table(TITLE_WORDS)
    v = F.array_join(F.transform(F.split(v, " "), lambda w: F.coalesce(F.element_at(words, w), w)), " ")
    v = F.regexp_replace(v, r"\b(of|the|to|for|at|a|an)\b", " ")
    return blank_null(F.trim(F.regexp_replace(v, r"\s+", " ")))


def _plain_clean(title: str) -> str:
    """clean_title() for the plain keys of TITLE_ROLES."""
    words = " ".join(TITLE_WORDS.get(w, w) for w in title.split())
    return " ".join(re.sub(r"\b(of|the|to|for|at|a|an)\b", " ", words).split())


def role_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Roles by cleaned title (the last of equal ones) and by its parts in order (the first)."""
    exact = {_plain_clean(k): v for k, v in TITLE_ROLES.items()}
    parts: dict[str, str] = {}
    for k, v in exact.items():
        parts.setdefault(" and ".join(sorted(k.split(" and "))), v)
    return exact, parts


def title(c: Column) -> Column:
    """A role, or the cleaned title in one word."""
    exact, parts = role_tables()
    ordered = lambda clean: F.array_join(F.array_sort(F.filter(F.transform(F.split(clean, " and "), F.trim), lambda p: p != "")), " and ")
    role = lambda clean: F.coalesce(F.element_at(table(exact), clean), F.element_at(table(parts), ordered(clean)), F.replace(clean, F.lit(" "), F.lit("_")))
    return let(clean_title(c), role)


def name(c: Column) -> Column:
    """struct(normalized, first, last, tokens)."""
    v = F.trim(F.regexp_replace(F.lower(F.regexp_replace(ascii_fold(blank_null(c)), r"[^a-zA-Z\s'-]", " ")), r"\s+", " "))
    parts = F.transform(F.split(v, " "), lambda t: F.regexp_replace(t, "^['-]+|['-]+$", ""))
    parts = F.filter(parts, lambda t: (t != "") & ~t.isin(HONORIFICS + NAME_SUFFIXES))
    whole = lambda x: F.when(F.size(x) > 0, F.struct(F.array_join(x, " ").alias("normalized"), F.element_at(x, 1).alias("first"), F.when(F.size(x) > 1, F.element_at(x, -1)).alias("last"), F.array_sort(F.array_distinct(x)).alias("tokens")))
    return let(parts, whole)


def location(c: Column) -> Column:
    """struct(city, country); the country of a known city wins."""
    v = F.trim(F.regexp_replace(ascii_fold(blank_null(c)), r"\s+", " "))
    parts = F.filter(F.transform(F.split(v, ","), F.trim), lambda p: p != "")
    names = table(CITY_NAMES)
    known = lambda x: F.coalesce(F.element_at(names, x), x)
    city = lambda x: let(let(F.lower(F.get(x, F.lit(0))), known), known)
    whole = lambda x, y: F.struct(blank_null(y).alias("city"), F.coalesce(F.element_at(table(CITY_COUNTRY), y), F.get(x, F.lit(1))).alias("country"))
    return let(parts, lambda x: let(city(x), lambda y: whole(x, y)))


def string_list(c: Column) -> Column:
    """A JSON array of strings as an array without blanks; other text as its only entry; null as none."""
    parsed = F.from_json(c, "array<string>")
    one = F.when(strip(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    found = F.when(strip(c).startswith("["), F.coalesce(parsed, one)).otherwise(one)
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (strip(x) != "")), F.array().cast("array<string>"))


def match_text(c: Column) -> Column:
    """Folded, lower-case, single spaces: for comparing quotes."""
    return F.trim(collapse(F.lower(ascii_fold(c))))
