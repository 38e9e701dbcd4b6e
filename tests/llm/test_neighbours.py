import numpy as np

from shelfwise.llm import neighbours

SCHEMA = "item_id long, embedding array<float>, similarity string"


def brute(rows, k, least):
    own = {i: np.asarray(v, float) for i, v in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(own)
    unit = np.array([(own[i] / np.linalg.norm(own[i])).astype(np.float32) for i in ids], np.float64)
    sim = np.round(unit @ unit.T, 6)
    out = set()
    for a, i in enumerate(ids):
        best = sorted((-sim[a, b], j) for b, j in enumerate(ids) if b != a)[:k]
        out |= {(min(i, j), max(i, j)) for s, j in best if -s >= least}
    return out


def make():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)]  # a crowd of copies
    rows += [(2000, None), (2001, [1.0] * 15), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (None, [1.0] * 16)]
    return rows + rows[:10]


def test_against_brute_force(spark):
    rows = make()
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for block in (64, 4096):
        for k in (3, 10):
            got = {tuple(r) for r in neighbours.similar_pairs(frame, k=k, dim=16, block=block).collect()}
            assert got == brute([r for r in rows if r[0] is not None], k, 0.7)


def test_empty_and_unusable(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, [], "x")], SCHEMA)
    assert neighbours.similar_pairs(frame).collect() == []
    assert neighbours.similar_pairs(frame.limit(0)).collect() == []


def test_crowds_of_unusable_vectors(spark):
    """Copies of a vector that may not take part have no neighbours, however many; usable copies beside them keep theirs."""
    bad = [[0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("-inf")] + [1.0] * 15]
    rows = [(100 * n + i, v) for n, v in enumerate(bad) for i in range(14)] + [(900 + i, [1.0] * 16) for i in range(14)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {tuple(r) for r in neighbours.similar_pairs(frame, dim=16).collect()}
    assert got == brute(rows, 10, 0.7)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(50, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, scale, norm, left = neighbours.quantise(unit)
    near = (q.astype(int) @ q.T.astype(int)) * scale[:, None] * scale
    assert (np.abs(near - unit @ unit.T) <= np.multiply.outer(norm, left) + left[:, None] + 1e-6).all()
