"""Registry answers and events as sources, with SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import registry as R
from ..streaming import ingest as S


def registry_doi_records(spark, sf_dir):
    """Items dressed as a DOI registry's answers, and read back."""
    work = F.struct(
        F.array("title").alias("title"), F.concat(F.lit("<jats:p>"), "abstract", F.lit("</jats:p>")).alias("abstract"), F.col("doi").alias("DOI"), F.array("venue").alias("container-title"),
        F.struct(F.array(F.array("publication_year")).alias("date-parts")).alias("issued"), F.lit("journal-article").alias("type"),
    )
    rows = table(spark, sf_dir, "library_items").where("doi is not null and abstract is not null and venue is not null and publication_year is not null")
    answers = rows.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(work.alias("message"))).alias("json"))
    return R.doi_records(answers).select("key", "item_type", "title", "publication_year", "doi", "venue", "source")


def event_windows(spark, sf_dir):
    """Events by type in windows of an hour: the batch form of the streaming count."""
    return S.windowed(table(spark, sf_dir, "events"))


QUERIES = {"registry_doi_records": registry_doi_records, "event_windows": event_windows}

SQL = {
    "registry_doi_records": """SELECT CAST(id AS VARCHAR) AS key, 'paper' AS item_type, title, publication_year, lower(doi) AS doi, CASE WHEN trim(venue) <> '' THEN venue END AS venue, 'crossref' AS source
FROM library_items WHERE doi IS NOT NULL AND abstract IS NOT NULL AND venue IS NOT NULL AND publication_year IS NOT NULL""",
    "event_windows": "SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
