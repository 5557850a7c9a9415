import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import fold, normalize, similarity, text


def run(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("o"))
    return [r.o for r in rows.orderBy("i").collect()]


def test_email(spark):
    same = ["Priya.Nair@Vantage.com", "  PRIYA.NAIR@VANTAGE.COM  ", "priya.nair+newsletter+crm@vantage.com", "<priya.nair@vantage.com>"]
    assert {r.normalized for r in run(spark, normalize.email, same)} == {"priya.nair@vantage.com"}
    gmail = run(spark, normalize.email, ["a.k.a.s.h.g.o.e.l@gmail.com"])[0]
    assert (gmail.normalized, gmail.is_personal) == ("akashgoel@gmail.com", True)
    assert run(spark, normalize.email, [None, "", "not-an-email", "a@b@c.com", "@vantage.com", "+x@a.b"]) == [None] * 6


def test_company(spark):
    same = ["Northwind Labs Inc.", "NORTHWIND LABS", "Northwind Labs Pvt Ltd", "Northwind Labs (formerly Acme)"]
    assert run(spark, normalize.company, [*same, "Quanta Stack", "Mehta & Co", None, "", "()"]) == ["northwind"] * 4 + ["quanta stack", "mehta", None, None, None]
    key = lambda c: normalize.company_key(normalize.company(c))
    assert run(spark, key, ["Cardinal Technologies", "CardinalTechnologies", None]) == ["cardinal", "cardinal", None]


def test_slug(spark):
    ways = ["https://www.linkedin.com/in/priya-nair-2291", "http://linkedin.com/in/priya-nair-2291/", "linkedin.com/in/Priya-Nair-2291?x=1", "www.linkedin.com/pub/priya-nair-2291#a", "priya-nair-2291"]
    assert set(run(spark, normalize.profile_slug, ways)) == {"priya-nair-2291"}
    assert run(spark, normalize.profile_slug, ["https://twitter.com/priya", None, ""]) == [None] * 3


def test_title(spark):
    out = run(spark, normalize.title, ["Co-founder & CEO", "Cofounder and CEO", "CEO & Founder", "VP Sales", "V.P. Sales", "Vice President of Sales", "GP", "General Partner", "Principal Engineer (interim)", "Principal Engineer", None, " "])
    assert out == ["founder_ceo"] * 3 + ["vice_president_sales"] * 3 + ["general_partner"] * 2 + ["principal_engineer"] * 2 + [None, None]


def test_name_and_location(spark):
    a, b, c, d, e = run(spark, normalize.name, ["Dr. Priya Raghavan", "Priya Raghavan Jr", "P. Raghavan", "Madonna", "ß"])
    assert a == b and a.normalized == "priya raghavan" and (c.first, c.last) == ("p", "raghavan") and d.last is None and e is None
    places = [(r.city, r.country) for r in run(spark, normalize.location, ["Bangalore", "NYC", "SF Bay Area", "Someville", None])]
    assert places == [("bengaluru", "India"), ("new york", "United States"), ("san francisco", "United States"), ("someville", None), (None, None)]


def test_fold_is_compatibility_decomposition(spark):
    import unicodedata

    values = ["Ünïcödé", "ﬁne ™ ½ ﷺ", "中文 abc", "𝐀𝐁", "é", "", None, "ßœøđ"]
    want = [None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert run(spark, fold.ascii_fold, values) == want


def test_string_list(spark):
    assert run(spark, normalize.string_list, ['["a"," ","b"]', "plain", None, "[bad", "", " "]) == [["a", "b"], ["plain"], [], ["[bad"], [], []]


@pytest.mark.parametrize(("a", "b", "want"), [("rohit zaidi", "rohia zaidi", 90.9091), ("michael mukherjee", "mike mukherjee", 83.8710), ("william bose", "fatima bose", 60.8696), ("madhav varma", "rahul varma", 69.5652), ("joseph whitfield", "joseph w", 85.7143), ("a b", "b a c", 100), ("", "a", 0)])
def test_token_set(a, b, want):
    assert similarity.token_set_of(a, b) == pytest.approx(want, abs=1e-4)


def test_ratio():
    assert similarity.ratio_of("vantagesystems", "vantagegrid") == pytest.approx(56.0)
    assert similarity.ratio_of("slatestack", "obsidianhealth") == pytest.approx(33.3333, abs=1e-4)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abc ", max_size=40))
def test_lcs_is_the_table(a, b):
    row = [0] * (len(a) + 1)
    for c in b:
        new = [0]
        for j, d in enumerate(a):
            new.append(max(new[-1], row[j + 1], row[j] + (c == d)))
        row = new
    assert similarity.lcs_length(a, b) == row[-1]


def test_lcs_in_sql(spark):
    assert spark.sql(f"SELECT {similarity.lcs_sql(repr('rohit zaidi'), repr('rohia zaidi'))} AS n").first().n == 10


def test_texts(spark):
    assert run(spark, text.title_case, ["UMA KUMAR", "FOUNDER & CPO", "Co-founder & CEO", None]) == ["Uma Kumar", "Founder & CPO", "Co-founder & CEO", ""]
    assert run(spark, text.first_name, ["UMA KUMAR", None]) == ["Uma", "They"]
    assert run(spark, text.match_reason, ["name 100.0, company 95.0, title agrees: True", "identical normalized email", "other", None]) == ["Names match exactly, company matches almost exactly, same role", "Identical email address", "other", ""]
    assert run(spark, text.intro_reason, ["They should meet because x needs y", "a"]) == ["X needs y", "A"]
    assert run(spark, lambda c: text.truncate_words(c, 10), ["short", "a word cut here", "unbrokenlongword"]) == ["short", "a word…", "unbrokenlo…"]
    assert run(spark, text.score_bullet, ["persona_fit: 30 of 30", "other: x"]) == ["Persona fit: 30 of 30", "other: x"]
    assert run(spark, lambda c: text.score100(c.cast("double")), ["0.925", "92.5", None]) == ["93", "93", "—"]
    assert text.estimate_tokens(5, 1000) == {"suggestions": 5, "batch_size": 4, "batches": 2, "est_prompt_tokens": 1340, "est_completion_tokens": 1360, "est_total_tokens": 2700}
