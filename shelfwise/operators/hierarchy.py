"""Parent-child rows to full hierarchies: root, depth, path, descendants and loops of every node.

Levels are reached from the roots by frontier joins. One join advances the frontier by ``STRIDE`` levels,
because the chains of up to ``STRIDE`` links below every node are prepared beforehand by doubling; a tree
of depth 120 then takes 8 joins in place of 120. Rows that no frontier reaches lie on or under a loop;
pointer jumping finds their loop in a logarithmic number of joins.

Defined results:

* exact repeats count once; of several parents of one id the smallest that is not null holds; rows whose
  id is null are left out;
* a row whose parent is null or is no row is a root;
* on or under a loop (a row that is its own parent is one) ``root_id`` is the smallest id on the loop,
  ``depth`` is -1 and ``path`` is empty;
* an empty table gives an empty result; columns other than the two named are ignored, so that their names
  cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut, drop

#: Levels that one frontier join advances; a power of two.
STRIDE = 16


def _links(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent): one row per id, parent null where the row is a root."""
    one = (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return one.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _chains(links: DataFrame) -> DataFrame:
    """(top, id, len, tail): chains of 1..STRIDE links from ``top`` down to ``id``; tail is the ids below top."""
    chains = links.where("parent is not null and parent <> id").select(
        F.col("parent").alias("top"), "id", F.lit(1).alias("len"), F.col("id").cast("string").alias("tail")
    )
    reach = 1
    while reach < STRIDE:
        upper = chains.where(F.col("len") == reach).select("top", F.col("id").alias("mid"), F.col("tail").alias("head"))
        lower = chains.select(F.col("top").alias("mid"), "id", "len", "tail")
        longer = upper.join(lower, "mid").select(
            "top", "id", (F.col("len") + reach).alias("len"), F.concat_ws("/", "head", "tail").alias("tail")
        )
        chains = chains.unionByName(longer)
        reach *= 2
    return chains


def _loops(lost: DataFrame, n: int) -> DataFrame:
    """(id, root_id) for rows on or under loops: jump 2**k links at a time until k covers every row."""
    spark = lost.sparkSession
    hops = lost.select("id", F.col("parent").alias("to"), F.col("id").alias("least"))
    paths: list[str] = []
    reach = 1
    while reach < n:
        ahead = hops.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("beyond"))
        hops, path = cut(
            hops.join(ahead, "to").select("id", F.col("next").alias("to"), F.least("least", "beyond").alias("least")),
            "loops",
        )
        drop(spark, *paths)
        paths = [path]
        reach *= 2
    # ``to`` now lies on the loop, and ``least`` of a loop's row covers the whole loop
    on = hops.select(F.col("id").alias("to"), F.col("least").alias("root_id"))
    return hops.select("id", "to").join(on, "to").select("id", "root_id")


def hierarchy(rows: DataFrame, id_col: str = "collection_id", parent_col: str = "parent_id") -> DataFrame:
    """(id_col, root_id, depth int, path) of every id; see the module's text for the defined cases."""
    spark = rows.sparkSession
    links, _ = cut(_links(rows, id_col, parent_col), "links")
    chains, chains_path = cut(_chains(links), "chains")
    roots = links.where("parent is null").select(
        "id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path")
    )
    done, frontier = [roots], roots
    while True:
        seen = Observation()
        step = frontier.join(chains, frontier.id == chains.top).select(
            chains.id,
            "root_id",
            (F.col("depth") + F.col("len")).alias("depth"),
            F.concat_ws("/", "path", "tail").alias("path"),
            (F.col("len") == STRIDE).alias("edge"),
        )
        step, _ = cut(step.observe(seen, F.count_if("edge").alias("edges"), F.count(F.lit(1)).alias("rows")), "level")
        if not seen.get["rows"]:
            break
        done.append(step.drop("edge"))
        if not seen.get["edges"]:
            break
        frontier = step.where("edge").drop("edge")
    drop(spark, chains_path)
    reached = done[0]
    for part in done[1:]:
        reached = reached.unionByName(part)
    lost, _ = cut(links.join(reached.select("id"), "id", "left_anti"), "lost")
    n = lost.count()
    if n:
        looped = _loops(lost, n).select(
            "id", "root_id", F.lit(-1).alias("depth"), F.lit("").alias("path")
        )
        reached = reached.unionByName(looped)
    return reached.select(F.col("id").alias(id_col), "root_id", F.col("depth").cast("int").alias("depth"), "path")


def descendants(tree: DataFrame, id_col: str = "collection_id") -> DataFrame:
    """(id_col, descendant_id, distance int) for every node and each node below it, from ``hierarchy``'s paths.

    The ancestors stand in each path, so that the pairs come without another join. Rows on or under a loop
    have no path and give no pairs here; ``loop_descendants`` gives theirs.
    """
    ids: Column = F.split("path", "/")
    return (
        tree.where("depth > 0")
        .select(F.col(id_col).alias("descendant_id"), "depth", F.posexplode(F.slice(ids, 1, F.col("depth"))).alias("pos", "anc"))
        .select(F.col("anc").cast("long").alias(id_col), "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
    )


def loop_descendants(rows: DataFrame, tree: DataFrame, id_col: str = "collection_id", parent_col: str = "parent_id") -> DataFrame:
    """(id_col, descendant_id, distance int) for rows on or under loops, up to the loop and once around it.

    ``tree`` is ``hierarchy`` of ``rows``. The distance is the first at which the walk upwards meets the ancestor; no
    row is its own descendant. A walk is doubled with every join, until none meets another ancestor.
    """
    spark = rows.sparkSession
    lost = tree.where("depth < 0").select(F.col(id_col).alias("id"))
    jumps, jumps_path = cut(_links(rows, id_col, parent_col).join(lost, "id").select("id", F.col("parent").alias("to")), "jumps")
    met = jumps.where("id <> to").select("id", F.col("to").alias("anc"), F.lit(1).alias("distance"))
    reach, n, paths = 1, met.count(), [jumps_path]
    while n:
        # what the row that is ``reach`` links above meets is met ``reach`` links later
        beyond = met.select(F.col("id").alias("to"), "anc", (F.col("distance") + reach).alias("distance"))
        further = jumps.join(beyond, "to").where("id <> anc").select("id", "anc", "distance")
        met, met_path = cut(met.unionByName(further).groupBy("id", "anc").agg(F.min("distance").alias("distance")), "met")
        ahead = jumps.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumps, jumps_path = cut(jumps.join(ahead, "to").select("id", F.col("next").alias("to")), "jumps")
        drop(spark, *paths)
        paths = [met_path, jumps_path]
        reach *= 2
        last, n = n, met.count()
        if n == last:
            break
    return met.select(F.col("anc").alias(id_col), F.col("id").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))
