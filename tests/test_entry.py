import sys

import duckdb
import pytest

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in (root / "shelfwise").rglob("*.py"):
        if "llm" not in path.relative_to(root / "shelfwise").parts:
            assert "shelfwise.llm" not in path.read_text() and "from .llm" not in path.read_text() and "from ..llm" not in path.read_text(), path
    assert "shelfwise" in sys.modules


@pytest.mark.parametrize("name", ["fts_items_bm25", "hybrid_search", "collection_tree_rollup", "dedup_decide_all", "metadata_layered_merge", "relation_inverse_closure", "p6_found"])
def test_against_sql(spark, sf, name):
    frame = entry.queries()[name](spark, sf)
    db = duckdb.connect()
    import glob

    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {path.rpartition('/')[2][:-8]} AS SELECT * FROM '{path}'")
    columns = sorted(frame.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    key = lambda r: repr([round(x, 9) if isinstance(x, float) else x for x in r])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry(spark):
    if not __import__("os").path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).columns == ["item_id", "rank", "score", "title", "publication_year"]
