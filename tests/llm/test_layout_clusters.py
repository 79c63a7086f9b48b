"""Exact linkage of layout places against brute force."""

import numpy as np
import pytest

from weblore.llm import gaussian_mixture as gm
from weblore.llm import layout_clusters as lc


def brute(ids, place, v):
    n = len(ids)
    adj = (place[:, None] == place[None, :]) & ~(np.abs(v[:, None, :] - v[None, :, :]) > 12).any(2)
    label = {}
    for i in np.argsort(ids):
        if i in label:
            continue
        stack, label[i] = [i], ids[i]
        while stack:
            q = stack.pop()
            for r in np.flatnonzero(adj[q]):
                if r not in label:
                    label[r] = ids[i]
                    stack.append(r)
    return {(int(ids[i]), int(label[i])) for i in range(n)}


def rows(spark, n, seed, spread, nulls):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n * 3)[:n]
    place = rng.integers(0, 3, n)
    v = np.round(rng.normal(0, spread, (n, 8)) * 4) / 4
    v[rng.random((n, 8)) < nulls] = np.nan
    data = [(int(i), int(p), 0, *(None if np.isnan(x) else float(x) for x in r), 1.0) for i, p, r in zip(ids, place, v)]
    df = spark.createDataFrame(data, "pair_id long, place_a long, place_b long, " + ", ".join(f"v{k} double" for k in range(8)) + ", origin_distance double")
    return df, brute(ids, place, v)


@pytest.mark.parametrize("seed,spread,nulls", [(1, 12, 0.0), (2, 9, 0.1), (3, 20, 0.3), (4, 60, 0.5)])
def test_clusters_equal_brute_force(spark, seed, spread, nulls):
    df, expected = rows(spark, 240, seed, spread, nulls)
    assert {tuple(r) for r in lc.clusters(None, df).collect()} == expected


def test_chunked_cells_give_the_same(spark, monkeypatch):
    df, expected = rows(spark, 300, 5, 10, 0.05)
    original = lc.units
    monkeypatch.setattr(lc, "units", lambda r: original(r, cell_rows=40))
    assert {tuple(r) for r in lc.clusters(None, df).collect()} == expected


def test_nulls_and_empty(spark):
    schema = (
        "pair_id long, template string, pred_candidates array<struct<node:string,text:string,features:struct<distances:struct<horizontal:struct<left_left:double,left_right:double,"
        "right_left:double,right_right:double>,vertical:struct<up_up:double,up_down:double,down_up:double,down_down:double>,min_distance:double,origin_distance:double>>,score:double>>"
    )
    one = lambda text, x, far: ("n", text, (((x, x, x, x), (1.0, 1.0, 1.0, 1.0), 0.0, far),), 0.0)
    data = [
        (1, "t", [one("Year:", 5.0, 2.0), one("other", 500.0, 9.0)]),
        (2, "t", [one("YEAR", 16.0, 1.0)]),
        (2, "t", [one("YEAR", 16.0, 1.0)]),
        (3, "t", [("n", "year", None, 0.0)]),
        (4, "t", None),
        (5, "u", [one("year", 5.0, None)]),
        (6, None, [one(None, 5.0, 1.0)]),
    ]
    df = spark.createDataFrame(data, schema)
    assert {tuple(r) for r in lc.linked_pairs(df).collect()} == {(1, 2)}
    assert lc.linked_pairs(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_alike_rows_share_a_block(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (1500, 1)) * 60 + rng.normal(0, 9, (1500, 8)) + rng.integers(0, 3, (1500, 1)) * 900
    v[rng.random((1500, 8)) < 0.05] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(x) else float(x) for x in r)) for i, r in enumerate(v)], "pair_id long, " + ", ".join(f"v{k} double" for k in range(8)))
    model = gm.fit(df)
    assert len(model.weights) > 1
    inside = model.members(v, lc.REACH)
    a, b = np.nonzero(np.triu(~(np.abs(v[:, None] - v[None]) > lc.REACH).any(2), 1))
    assert len(a) > 1000 and (inside[a] & inside[b]).any(1).all()
    assert not inside.all()


def test_sweep_of_interleaved_rows():
    rng = np.random.default_rng(9)
    n = 4000
    v = np.column_stack([rng.normal(0, 4, (n, 4)), rng.normal(0, 3, (n, 4)) + 40 * rng.integers(0, 2, (n, 1))])
    order = np.argsort(v[:, 0])
    ids = rng.permutation(n)
    root = lc._local(np.zeros(n, np.int64), ids[order], v[order])
    assert {(int(i), int(r)) for i, r in zip(ids[order], root)} == brute(ids, np.zeros(n), v)
