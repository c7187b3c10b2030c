import math

import numpy as np
import pytest

from scanloom.llm import ego_join


def brute(rows, least):
    """n_links and component by comparing all rows."""
    def good(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [i for i, r in enumerate(rows) if good(r)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in ok}
    top = {i: rows[i][0] for i in ok}
    while True:
        new = {i: min([top[i], *(top[j] for j in near[i])]) for i in ok}
        if new == top:
            break
        top = new
    return sorted(((r[0], len(near.get(i, [])), top.get(i, r[0]), r[0] is not None and top.get(i, r[0]) == r[0]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("least", [0.98, 0.7])
def test_equals_brute_force_with_odd_rows(spark, least):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    rows = [(1000 - i, (centres[i % 12] + rng.standard_normal(8) * 0.08 * (i % 4)).astype(np.float32).tolist(), i % 3) for i in range(700)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(60)]
    rows += [(3000, [2 * x for x in rows[5][1]], rows[5][2]), (3001, rows[5][1], None), (3002, None, 1), (3003, [], 1), (3004, [0.0] * 8, 1), (3005, [1.0, None] * 4, 1), (3006, [float("nan")] * 8, 1), (3007, [float("inf")] * 8, 1)]
    rows += [(None, rows[0][1], rows[0][2]), (3008, [1.0, 2.0], 0), (3009, [1.0, 2.0], 0), (3010, [-0.0, 2.0], 0), (3011, [0.0, 2.0], 0), (3012, [1e30, 1.0], 7), (3013, [1e-30, 0.0], 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, links int")
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert sorted(map(tuple, ego_join.near_vectors(df, least).collect()), key=repr) == brute(as_float, least)


def test_empty_and_all_unusable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ego_join.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = ego_join.near_vectors(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)]


def test_recursion_skips_only_distant_intervals():
    rng = np.random.default_rng(0)
    u = ego_join.unit(rng.standard_normal((300, 6)))
    p = u[:, :3]
    order = np.lexsort(np.floor(p / 0.2).T[::-1])
    u, p = u[order], p[order]
    hits = ego_join.joined_intervals(u[:150], u[150:], p[:150], p[150:], math.sqrt(2 - 2 * 0.95), 0.95, leaf=4)
    assert (hits == (u[:150] @ u[150:].T >= 0.95)).all() and hits.any()
