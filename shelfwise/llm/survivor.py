"""The best representative of each duplicate group, field by field.

Two operators stand here. ``surviving_fields`` takes, for each field, the value of the most trusted
candidate that has one; TESTDATA.md fixes that order, so that it, not the model, decides ``p5_found``.
``truth_model`` is the latent two-sided quality model: expectation-maximisation infers the sensitivity and
specificity of each source in the data, and every value judged true is kept, several of one field if need be.

Defined results: exact repeats count once; null item ids or candidate ids are left out; a null, NaN or
negative confidence is 0, one above 1 a percentage; a null fetched_at is the oldest; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

FIELDS = ("title", "abstract", "publication_year", "doi", "venue")

#: Sources in order of trust; those of one line are equals (fixed values).
TRUST = (
    ("crossref",),
    ("arxiv",),
    ("grobid",),
    ("openlibrary",),
    ("llm",),
    ("zotero_import", "manual"),
    ("manual_required",),
)

#: Words that stand where a value is missing (fixed values).
FILLERS = (
    "-", "--", "?", "??", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tba", "tbd", "unknown", "pending", "[no title]",
    "no title", "[untitled]", "untitled", "not available", "unavailable", "not known", "missing", "undefined", ".", "...",
)

FIRST_YEAR, LAST_YEAR = 1500, 2026
DOI = r"10\.[0-9]{4,9}/\S"


def plain_source(source: Column) -> Column:
    """The source's name whatever its case, padding and separators."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"(?U)[\s_\-]+", "_"), "^_|_$", "")


def trust_rank(source: Column) -> Column:
    """0 for the most trusted source; unlisted and null sources come last."""
    plain, rank = plain_source(source), F.lit(len(TRUST))
    for place in reversed(range(len(TRUST))):
        rank = F.when(plain.isin(*TRUST[place]), place).otherwise(rank)
    return rank


def fraction(confidence: Column) -> Column:
    """Confidence between 0 and 1: percentages as fractions; null, NaN and negative as 0."""
    return F.when(confidence.isNull() | F.isnan(confidence) | (confidence < 0), 0.0).when(confidence > 1, confidence / 100).otherwise(confidence)


def has_value(field: str) -> Column:
    """Whether the field holds a value that may survive."""
    if field == "publication_year":
        return F.col(field).between(FIRST_YEAR, LAST_YEAR)
    if field == "doi":
        return F.coalesce(F.col(field).rlike(DOI), F.lit(False))
    word = F.regexp_replace(F.lower(F.col(field)), r"(?U)^\s+|\s+$", "")
    return F.col(field).isNotNull() & (word != "") & ~word.isin(*FILLERS)


def _order() -> Column:
    return F.struct(
        trust_rank(F.col("source")).alias("rank"),
        (-fraction(F.col("confidence"))).alias("doubt"),
        F.coalesce(-F.unix_micros("fetched_at"), F.lit(2**63 - 1)).alias("age"),
        F.col("candidate_id").alias("candidate_id"),
    )


def surviving_records(candidates: DataFrame) -> DataFrame:
    """item_id and a struct (order, value) for each field: the first candidate with a value, null where none has.

    One aggregation by item; minima are formed before the shuffle, so that an item with a third of all rows
    sends no more than any other.
    """
    wins = [F.min(F.when(has_value(f), F.struct(_order().alias("order"), F.col(f).alias("value")))).alias(f) for f in FIELDS]
    return (
        candidates.where("item_id is not null and candidate_id is not null")
        .groupBy("item_id")
        .agg(F.min("candidate_id").alias("first_id"), F.max("candidate_id").alias("last_id"), *wins)
    )


def surviving_fields(candidates: DataFrame) -> DataFrame:
    """(item_id, field, candidate_id) for items with at least two candidates."""
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["order"]["candidate_id"].alias("candidate_id")) for f in FIELDS]))
    return (
        surviving_records(candidates)
        .where("first_id <> last_id")
        .select("item_id", per_field.alias("x"))
        .select("item_id", "x.field", "x.candidate_id")
        .where("candidate_id is not null")
    )


def best_records(candidates: DataFrame) -> DataFrame:
    """One record per item, with the surviving value of each field."""
    return surviving_records(candidates).select("item_id", *[F.col(f)["value"].alias(f) for f in FIELDS])


# --- the latent two-sided quality model -------------------------------------------------------------------

#: Rounds of expectation-maximisation at most, and the change of a quality below which it ends.
ROUNDS, STILL = 40, 1e-4


def _plain_value(field: str) -> Column:
    """A value in one dress, so that spellings of it agree."""
    if field == "publication_year":
        return F.col(field).cast("string")
    if field == "doi":
        return F.regexp_replace(F.lower(F.regexp_extract(field, r"(10\.[0-9]{4,9}/\S+)", 1)), r"[.,;]+$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(F.col(field)), r"\(preprint\)", ""), r"(?U)^[\W_]+|[\W_]+$", "")


def claims(candidates: DataFrame) -> DataFrame:
    """(item_id, field, value, said, silent): the sources that give the value, and those that give another, as sorted arrays."""
    source = F.coalesce(F.nullif(plain_source(F.col("source")), F.lit("")), F.lit("(none)"))
    made = candidates.where("item_id is not null").select(
        "item_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(has_value(f), _plain_value(f)).alias("value")) for f in FIELDS])).alias("x"),
        source.alias("source"),
    ).where("x.value <> ''")
    facts = made.groupBy("item_id", "x.field", "x.value").agg(F.array_sort(F.collect_set("source")).alias("said"))
    heard = made.groupBy("item_id", "x.field").agg(F.array_sort(F.collect_set("source")).alias("heard"))
    return facts.join(heard, ["item_id", "field"]).withColumn("silent", F.array_except("heard", "said")).drop("heard")


def _odds(names: list[str], gains: list[float]) -> Column:
    """A map from sources to what each adds to the log odds of a value."""
    return F.create_map(*[F.lit(x) for pair in zip(names, gains) for x in pair])


def _probability(sources: dict[str, tuple[float, float]], prior: float) -> Column:
    names = sorted(sources)
    yes = _odds(names, [log(sources[s][0] / (1 - sources[s][1])) for s in names])
    no = _odds(names, [log((1 - sources[s][0]) / sources[s][1]) for s in names])
    total = F.lit(log(prior / (1 - prior)))
    total = total + F.aggregate("said", F.lit(0.0), lambda a, x: a + yes[x]) + F.aggregate("silent", F.lit(0.0), lambda a, x: a + no[x])
    return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(50.0)), F.lit(-50.0))))


def truth_model(candidates: DataFrame, keep: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Values judged true, and the quality of each source.

    First: (item_id, field, value, probability, kept), every value with a probability of ``keep`` or more kept, several of
    one field if need be. Second: (source, sensitivity, specificity), a row for each source in the data.

    A value's probability depends on the sources that give it and those that give another alone, so the rounds run
    over the distinct pairs of such sets with their counts, as a table; of a round only sums come to the driver,
    one row for each source. A value starts as true in the share of heard sources that give it.
    """
    spark = candidates.sparkSession
    facts, _ = cut(claims(candidates), "claims")
    patterns, _ = cut(facts.groupBy("said", "silent").agg(F.count(F.lit(1)).alias("n")), "patterns")
    sources: dict[str, tuple[float, float]] = {}
    true: Column = (F.size("said") + 0.5) / (F.size("said") + F.size("silent") + 1.0)
    prior = 0.5
    for _ in range(ROUNDS):
        judged = patterns.select("said", "silent", "n", true.alias("t"))
        mark = lambda y: lambda x: F.struct(x.alias("source"), F.lit(y).alias("said"))
        marks = F.explode(F.concat(F.transform("said", mark(1)), F.transform("silent", mark(0))))
        sums = judged.select("n", "t", marks.alias("m")).groupBy("m.source").agg(
            F.sum(F.col("n") * F.col("t") * F.col("m.said")).alias("hit"),
            F.sum(F.col("n") * F.col("t")).alias("true"),
            F.sum(F.col("n") * (1 - F.col("t")) * (1 - F.col("m.said"))).alias("passed"),
            F.sum(F.col("n") * (1 - F.col("t"))).alias("false"),
        )
        rows = sums.collect()
        if not rows:
            break
        whole = judged.agg(F.sum(F.col("n") * F.col("t")).alias("t"), F.sum("n").alias("n")).first()
        before = sources
        sources = {r.source: ((r.hit + 2) / (r.true + 3), (r.passed + 2) / (r.false + 3)) for r in rows}
        prior = (whole.t + 1) / (whole.n + 2)
        true = _probability(sources, prior)
        if before and max(abs(a - b) for s in sources for a, b in zip(sources[s], before[s])) < STILL:
            break
    quality = spark.createDataFrame([(s, round(a, 6), round(b, 6)) for s, (a, b) in sorted(sources.items())], "source string, sensitivity double, specificity double")
    values = facts.withColumn("probability", F.round(true, 6)).select("item_id", "field", "value", "probability", (F.col("probability") >= keep).alias("kept"))
    return values, quality
