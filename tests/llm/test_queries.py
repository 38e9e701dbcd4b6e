import glob

import duckdb
import pytest

from shelfwise.llm import queries


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p5_found", "p5_records"])
def test_against_sql(spark, sf, name):
    frame = queries.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {path.rpartition('/')[2][:-8]} AS SELECT * FROM '{path}'")
    columns = sorted(frame.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, ([x for x in r] for r in frame.select(*columns).collect()))) == sorted(map(repr, (list(r) for r in want)))


@pytest.mark.parametrize(
    "name, columns",
    [
        ("p1_found", ["author_a", "author_b"]), ("p2_found", ["chunk_id", "boundary"]), ("p7_found", ["chunk_id", "noise"]), ("p8_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "passage_id"]), ("p10_found", ["doc_id", "kind", "found"]),
        ("p1_entities", ["author_id", "first_id"]), ("p5_truths", ["item_id", "field", "value", "probability", "kept"]), ("p5_source_quality", ["source", "sensitivity", "specificity"]), ("p7_repaired", ["chunk_id", "text"]), ("p10_redacted", ["doc_id", "text"]),
    ],
)
def test_columns_and_distinct_rows(spark, sf, name, columns):
    rows = queries.QUERIES[name](spark, sf)
    assert rows.columns == columns
    got = [tuple(map(str, r)) for r in rows.collect()]
    assert got and len(got) == len(set(got))
