"""Queries of the hierarchy operator, with SQL for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..session import cut, table


def p6_found(spark, sf_dir):
    """Every collection with its root, depth and path; loops told apart."""
    return H.hierarchy(table(spark, sf_dir, "collection_rows"))


def p6_descendants(spark, sf_dir):
    """Every collection with each collection below it, on and under loops as well, and whether the pair lies there."""
    rows = table(spark, sf_dir, "collection_rows")
    tree, _ = cut(H.hierarchy(rows), "tree")
    return H.descendants(tree).withColumn("looped", F.lit(False)).unionByName(H.loop_descendants(rows, tree).withColumn("looped", F.lit(True)))


QUERIES = {"p6_found": p6_found, "p6_descendants": p6_descendants}

_WALK = """
WITH RECURSIVE n AS (
  SELECT collection_id AS id, min(parent_id) AS parent FROM collection_rows GROUP BY 1
), l AS (
  SELECT n.id, p.id AS parent FROM n LEFT JOIN n p ON n.parent = p.id
), t AS (
  SELECT id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM l WHERE parent IS NULL
  UNION ALL
  SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || CAST(l.id AS VARCHAR) FROM t JOIN l ON l.parent = t.id WHERE l.id <> t.id
), u AS (
  SELECT * FROM l WHERE id NOT IN (SELECT id FROM t)
), r AS (
  SELECT id, parent AS anc FROM u
  UNION
  SELECT r.id, u.parent FROM r JOIN u ON r.anc = u.id
), loops AS (
  SELECT id AS anc FROM r WHERE id = anc
)
"""

SQL = {
    "p6_found": _WALK
    + """
SELECT id AS collection_id, root_id, CAST(depth AS INTEGER) AS depth, path FROM t
UNION ALL
SELECT r.id, min(r.anc), CAST(-1 AS INTEGER), '' FROM r JOIN loops USING (anc) GROUP BY r.id
""",
    "p6_descendants": _WALK
    + """
, d AS (
  SELECT id AS collection_id, id AS descendant_id, 0 AS distance FROM t
  UNION ALL
  SELECT d.collection_id, l.id, d.distance + 1 FROM d JOIN l ON l.parent = d.descendant_id
), w AS (
  SELECT id, parent AS anc, [id] AS seen, 1 AS distance FROM u WHERE parent <> id
  UNION ALL
  SELECT w.id, u.parent, list_append(w.seen, w.anc), w.distance + 1 FROM w JOIN u ON u.id = w.anc WHERE u.parent <> w.anc AND NOT list_contains(w.seen, u.parent)
)
SELECT collection_id, descendant_id, CAST(distance AS INTEGER) AS distance, FALSE AS looped FROM d WHERE distance > 0
UNION ALL
SELECT anc, id, CAST(distance AS INTEGER), TRUE FROM w
""",
}
