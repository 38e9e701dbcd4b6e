import random

from shelfwise.llm import groups

SCHEMA = "subject_id long, relation string, object_id long, confidence double"


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(root)}


def test_random_chains_and_a_hub(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 400)]
    pairs += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)] + [(9, 9)]
    rng.shuffle(pairs)
    frame = spark.createDataFrame(pairs + pairs[:20], "a long, b long")
    assert {tuple(r) for r in groups.hash_to_min(frame).collect()} == brute(pairs)


def test_labels_nulls_and_self_links(spark):
    rows = [
        (1, " Preprint-Of ", 2, None),
        (3, "PUBLISHED AS", 2, 0.1),
        (4, "cites", 5, 1.0),
        (6, "translates", 6, 1.0),
        (None, "translates", 7, 1.0),
        (8, None, 9, 1.0),
        (1, " Preprint-Of ", 2, None),
    ]
    found = groups.version_groups(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_empty(spark):
    assert groups.version_groups(spark.createDataFrame([], SCHEMA)).collect() == []
