"""Enrichment answers: validation against closed lists, checks of quoted evidence, and their counts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import let, strip
from ..functions.normalize import match_text
from ..functions.tables import CITABLE, ENUMS, LOW_CONFIDENCE, MAX_EVIDENCE, MAX_PHRASES, MIN_QUOTE
from .shared import materialize


def valid() -> Column:
    """Whether an answer's values are all in their lists and bounds."""
    ok = F.col("person_id").isNotNull() & F.col("confidence").between(0.0, 1.0)
    for c, values in ENUMS.items():
        ok = ok & F.col(c).isin(values)
    ok = ok & (F.coalesce(F.size("needs"), F.lit(0)) <= MAX_PHRASES) & (F.coalesce(F.size("offers"), F.lit(0)) <= MAX_PHRASES)
    ok = ok & (F.coalesce(F.size("evidence"), F.lit(0)) <= MAX_EVIDENCE) & F.forall(F.coalesce("evidence", F.array().cast("array<struct<field:string,quote:string,supports:string>>")), lambda e: e["field"].isin(CITABLE))
    return F.coalesce(ok, F.lit(False))


def validate(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid answers, those to be set aside)."""
    rows = answers.withColumn("valid", valid())
    return rows.filter("valid").drop("valid"), rows.filter("NOT valid").drop("valid")


def source_text(record: str = "") -> Column:
    """The text of each citable field of a record."""
    p = f"{record}." if record else ""
    text = {f: F.when(F.size(p + f) > 0, F.array_join(p + f, "; ")) if f in ("needs", "offers") else F.col(p + f) for f in CITABLE}
    return F.create_map(*(x for f, c in text.items() for x in (F.lit(f), c)))


def verify_evidence(records: DataFrame, answers: DataFrame) -> DataFrame:
    """(person_id, total, verified, unverified, rate) of each answer's quotes against its record."""
    none = F.array().cast("array<struct<field:string,quote:string,supports:string>>")
    rows = answers.select("person_id", F.coalesce("evidence", none).alias("evidence")).join(records.select(F.col("id").alias("person_id"), source_text().alias("texts")), "person_id", "left")

    def check(e: Column, folded: Column) -> Column:
        source, quote = F.element_at("texts", e["field"]), F.coalesce(strip(e["quote"]), F.lit(""))
        why = F.when(F.coalesce(source == "", F.lit(True)), F.concat(F.lit("field '"), F.coalesce(e["field"], F.lit("None")), F.lit("' is empty or unknown"))).when(F.length(quote) < MIN_QUOTE, "quote too short to be evidence").when(~F.element_at(folded, e["field"]).contains(match_text(quote)), "quote does not appear in that field")
        return F.struct(e["field"].alias("field"), e["quote"].alias("quote"), e["supports"].alias("supports"), why.alias("why"))

    # each text is folded once, however many quotes cite it
    checks = let(F.transform_values("texts", lambda _, t: match_text(t)), lambda folded: F.transform("evidence", lambda e: check(e, folded)))
    checked = rows.select("person_id", checks.alias("checks"))
    out = checked.select("person_id", F.size("checks").cast("long").alias("total"), F.filter("checks", lambda c: c["why"].isNotNull()).alias("unverified"))
    out = out.select("person_id", "total", (F.col("total") - F.size("unverified")).alias("verified"), "unverified")
    return out.withColumn("rate", F.when(F.col("total") == 0, 1.0).otherwise(F.col("verified") / F.col("total")))


#: So many different quotes in one row of verify_shared; so many, and of so many characters in all, that are broadcast.
QUOTES, BROADCAST, CHARACTERS = 512, 100_000, 1 << 20


def verify_shared(records: DataFrame, evidence: DataFrame, block: int = QUOTES, characters: int = CHARACTERS) -> DataFrame:
    """(person_id, total, verified) of one list of quotes, (field, quote) rows, against every record, by the rules of verify_evidence.

    Equal quotes are checked once and counted each, and each text is folded once. Quotes of up to `characters` in all are
    searched for together, in one pass over a text (an Aho-Corasick automaton a field in Arrow functions); beyond that
    each text meets them in blocks, which are broadcast up to BROADCAST different quotes and else dealt as a product.
    Without quotes there are no rows.
    """
    quote = F.coalesce(strip("quote"), F.lit(""))
    kinds = materialize(evidence.select("field", match_text(quote).alias("folded"), (F.length(quote) >= MIN_QUOTE).alias("long")).groupBy("field", "folded", "long").agg(F.count(F.lit(1)).alias("n")), "quotes")
    texts = records.select(F.col("id").alias("person_id"), F.transform_values(source_text(), lambda _, t: F.when(t != "", match_text(t))).alias("texts"))
    size = kinds.agg(F.count(F.lit(1)).alias("different"), F.coalesce(F.sum(F.length("folded")), F.lit(0)).alias("characters"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    if size.different and size.characters <= characters and size.different <= BROADCAST:
        wanted = [(r.field, r.folded, r.n) for r in kinds.filter("long").collect() if r.field in CITABLE]
        return _search(texts.select("person_id", *(F.element_at("texts", F.lit(f)).alias(f) for f in CITABLE)), wanted, size.total)
    slot = F.pmod(F.xxhash64("folded"), F.lit(max(1, -(-size.different // block))))
    quotes = kinds.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("field", "folded", "long", "n")).alias("quotes")).select("quotes")
    if size.different <= BROADCAST:
        quotes = F.broadcast(quotes)
    found = lambda q: q["long"] & reduce(lambda a, f: a | ((q["field"] == f) & F.coalesce(F.element_at("texts", F.lit(f)).contains(q["folded"]), F.lit(False))), CITABLE, F.lit(False))
    count = lambda keep: F.aggregate("quotes", F.lit(0).cast("long"), lambda s, q: s + F.when(keep(q), q["n"]).otherwise(0))
    rows = texts.crossJoin(quotes).select("person_id", count(lambda q: F.lit(True)).alias("total"), count(found).alias("verified"))
    return rows.groupBy("person_id").agg(F.sum("total").alias("total"), F.sum("verified").alias("verified"))


def _search(texts: DataFrame, wanted: list[tuple[str, str, int]], total: int) -> DataFrame:
    """verify_shared's rows by automata; texts: person_id and a folded text a field."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    fields = [f for f in CITABLE if any(w[0] == f for w in wanted)]

    def run(batches):
        import ahocorasick

        found = {}
        for f in fields:
            found[f] = ahocorasick.Automaton()
            for i, (own, folded, _) in enumerate(shared.value):
                if own == f and folded:
                    found[f].add_word(folded, i)
            if len(found[f]):
                found[f].make_automaton()
        blank = {f: sum(n for own, folded, n in shared.value if own == f and not folded) for f in fields}  # quotes that fold to nothing are in every text
        for batch in batches:
            sums = [0] * batch.num_rows
            for f in fields:
                for row, text in enumerate(batch.column(batch.schema.get_field_index(f))):
                    if text.is_valid:
                        seen = {i for _, i in found[f].iter(text.as_py())} if len(found[f]) else ()
                        sums[row] += blank[f] + sum(shared.value[i][2] for i in seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([total] * len(sums), pa.int64()), pa.array(sums, pa.int64())], ["person_id", "total", "verified"])

    return texts.select("person_id", *fields).mapInArrow(run, "person_id string, total long, verified long")


def complete(records: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a record: its answer, or an explicit unknown with confidence 0; low_confidence below the threshold."""
    rows = records.select(F.col("id").alias("person_id")).join(answers, "person_id", "left")
    for c in ENUMS:
        rows = rows.withColumn(c, F.coalesce(c, F.lit("unknown")))
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("low_confidence", F.col("confidence") < LOW_CONFIDENCE)


def remaining(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Records that no answer with confidence has reached."""
    return records.join(answers.filter("confidence > 0").select(F.col("person_id").alias("id")), "id", "left_anti")


def distribution(answers: DataFrame, top: int = 6) -> DataFrame:
    """The most frequent values of each closed list (a top-k report): (enum, value, n, rank)."""
    from pyspark.sql import Window

    names = ", ".join(f"'{c}', {c}" for c in ENUMS)
    counts = answers.selectExpr(f"stack({len(ENUMS)}, {names}) AS (enum, value)").groupBy("enum", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("enum").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)


def store(current: DataFrame, new: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the enrichment layer with valid new answers, answers set aside): in place of all earlier ones, or of those of the same people."""
    from ..sources.layers import upsert

    good, bad = validate(new)
    return (good.select(current.columns) if replace else upsert(current, good, "person_id")), bad


def funnel(records: DataFrame, answers: DataFrame) -> DataFrame:
    """(metric, value) of a run: records, returned and missing answers, unknown and unsure ones, mean confidence over all records, and evidence."""
    ids = records.select(F.col("id").alias("person_id"))
    rows = ids.join(answers.select("person_id", "persona", "confidence", F.lit(True).alias("returned")), "person_id", "left")
    got, c = F.coalesce("returned", F.lit(False)), F.coalesce("confidence", F.lit(0.0))
    n = rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(got).alias("returned"), F.count_if(~got).alias("missing"), F.count_if(got & (F.col("persona") == "unknown")).alias("unknown_persona"), F.count_if(got & (c < LOW_CONFIDENCE)).alias("low_confidence"), F.round(F.avg(c), 3).alias("mean_confidence"))
    checks = verify_evidence(records, answers.join(ids, "person_id", "left_semi"))
    total, good = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("verified"), F.lit(0))
    e = checks.agg(total.alias("evidence_total"), good.alias("evidence_verified"), F.count_if(F.col("verified") < F.col("total")).alias("records_with_bad_evidence"), F.round(F.when(total > 0, good / total).otherwise(1.0), 4).alias("evidence_rate"))
    from .evaluate import as_metrics

    return as_metrics(n).unionByName(as_metrics(e))


def progress(people: DataFrame, answers: DataFrame, applications: DataFrame) -> DataFrame:
    """One row: canonical people, those with a confident answer, applications, and applicants with a confident answer."""
    sure = answers.filter("confidence > 0").select("person_id")
    one = lambda df, name: int(df.agg(F.count(F.lit(1)).alias(name)).first()[0])
    row = (one(people.filter("merged_into IS NULL"), "n"), one(sure, "n"), one(applications, "n"), one(sure.join(applications.select("person_id"), "person_id"), "n"))
    return people.sparkSession.createDataFrame([row], "canonical long, enriched long, applicants long, applicants_enriched long")
