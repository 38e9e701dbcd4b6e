from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfwise.operators.hierarchy import descendants, hierarchy

SCHEMA = "collection_id long, parent_id long"


def brute(rows):
    parents = {}
    for i, p in sorted(set(rows), key=lambda r: (r[1] is None, r[1] or 0), reverse=True):
        if i is not None:
            parents[i] = p if p is not None else parents.get(i)
    parents = {i: p if p in parents else None for i, p in parents.items()}
    out = set()
    for i in parents:
        walk, at = [i], i
        while parents[at] is not None and parents[at] not in walk:
            at = parents[at]
            walk.append(at)
        if parents[at] is None:
            out.add((i, at, len(walk) - 1, "/".join(map(str, reversed(walk)))))
        else:
            out.add((i, min(walk[walk.index(parents[at]) :]), -1, ""))
    return out


def run(spark, rows):
    return {tuple(r) for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_deep_chain_loops_and_orphans(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)]
    rows += [(100, 100), (101, 100), (102, 103), (103, 104), (104, 102), (105, 104), (106, 105), (200, 999), (201, 200)]
    rows += rows[:5] + [(None, 3)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, 5, "x"), (2, 1, 6, "y")], "collection_id long, parent_id long, depth long, path string")
    assert {tuple(r) for r in hierarchy(rows).collect()} == {(1, 1, 0, "1"), (2, 1, 1, "1/2")}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.none() | st.integers(0, 30)), max_size=25, unique_by=lambda r: r[0]))
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_descendants(spark):
    tree = hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4)], SCHEMA))
    assert {tuple(r) for r in descendants(tree).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_descendants_on_and_under_loops(spark, tmp_path):
    from shelfwise.plans.hierarchy_queries import p6_descendants

    parents = {1: None, 2: 1, 10: 10, 11: 10, 12: 11, 20: 21, 21: 22, 22: 20} | {30: 20} | {i: i - 1 for i in range(31, 42)}
    spark.createDataFrame([*parents.items(), (12, 11)], SCHEMA).write.parquet(f"{tmp_path}/collection_rows.parquet")
    want = {(1, 2, 1, False)}
    for i in set(parents) - {1, 2}:
        walk = [i]
        while parents[walk[-1]] not in walk:
            walk.append(parents[walk[-1]])
        want |= {(a, i, d, True) for d, a in enumerate(walk) if d}
    got = [tuple(r) for r in p6_descendants(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
