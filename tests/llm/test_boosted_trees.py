"""Trees fit in tasks on all rows of a table."""

import numpy as np
import pytest

from weblore.llm import boosted_trees


@pytest.mark.parametrize("on_driver", [0, 10**6])
def test_rows_in_tasks_give_the_model_of_all_rows(spark, monkeypatch, on_driver):
    monkeypatch.setattr(boosted_trees, "DRIVER_ROWS", on_driver)
    monkeypatch.setattr(boosted_trees, "CARRY", 2)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random(900), rng.integers(0, 3, 900), np.ones(900), rng.normal(size=900).round(1)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(int)
    rows = [(n, codes, [v.tolist() for v in vals]) for at in (0, 100, 350) for n, codes, vals in boosted_trees.packed(x[at : {0: 100, 100: 350}.get(at)], y[at : {0: 100, 100: 350}.get(at)])]
    got = boosted_trees.fit_slices(spark.createDataFrame(rows, boosted_trees.SLICES).repartition(3), rounds=5)
    want = boosted_trees.fit(x, y.astype(float), rounds=5)
    assert got.base == pytest.approx(want.base) and np.array_equal(got.features, want.features) and np.array_equal(got.thresholds, want.thresholds)
    assert np.allclose(got.leaves, want.leaves, atol=1e-6) and ((got.logits(x) > 0) == y).mean() > 0.9


def test_one_class_and_no_rows(spark):
    one = [(n, codes, [v.tolist() for v in vals]) for n, codes, vals in boosted_trees.packed(np.eye(3), np.ones(3))]
    assert len(boosted_trees.fit_slices(spark.createDataFrame(one, boosted_trees.SLICES)).leaves) == 0
    assert boosted_trees.fit_slices(spark.createDataFrame([], boosted_trees.SLICES)).logits(np.zeros((2, 2))).tolist() == [0, 0]


def test_all_trees_grow_in_a_few_jobs(spark, monkeypatch):
    """In tasks that wait for each other, some of them without rows; without such tasks each level is a job, with the same model."""
    monkeypatch.setattr(boosted_trees, "DRIVER_ROWS", 0)
    monkeypatch.setattr(boosted_trees, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random(500), rng.integers(0, 4, 500), rng.normal(size=500).round(1)])
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 1)).astype(int)
    rows = [(n, codes, [v.tolist() for v in vals]) for part in (slice(0, 200), slice(200, 500)) for n, codes, vals in boosted_trees.packed(x[part], y[part])]
    slices, models = spark.createDataFrame(rows, boosted_trees.SLICES).repartition(4), []
    for group, rounds in (("together", 30), ("each level", 5), ("five together", 5)):
        spark.sparkContext.setJobGroup(group, "")
        with monkeypatch.context() as patch:
            if group == "each level":
                patch.setattr(boosted_trees, "_slots", lambda _: 0)
            models.append(boosted_trees.fit_slices(slices, rounds=rounds))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert group == "each level" or jobs < 30
    want = boosted_trees.fit(x, y.astype(float), rounds=30)
    assert np.array_equal(models[0].features, want.features) and np.allclose(models[0].logits(x), want.logits(x), atol=1e-6)
    assert np.array_equal(models[1].logits(x), models[2].logits(x))


def test_a_lost_task_starts_the_stage_again(spark, monkeypatch, tmp_path):
    """The first task and another one end once, in the second tree."""
    monkeypatch.setattr(boosted_trees, "DRIVER_ROWS", 0)
    monkeypatch.setattr(boosted_trees, "BLOCK_ROWS", 20)
    x = np.random.default_rng(5).random((90, 3))
    y = (x[:, 0] > x[:, 1]).astype(int)
    rows = [(n, codes, [v.tolist() for v in vals]) for at in (0, 30, 60) for n, codes, vals in boosted_trees.packed(x[at : at + 30], y[at : at + 30])]
    slices, grow, marks = spark.createDataFrame(rows, boosted_trees.SLICES).repartition(3), boosted_trees._grow, str(tmp_path)
    want = boosted_trees.fit_slices(slices, rounds=3)

    def losing(sums, *settings, **more):
        def own(trees, *at):
            import os

            from pyspark import BarrierTaskContext

            mark = os.path.join(marks, str(BarrierTaskContext.get().partitionId()))
            if len(trees) == 1 and mark[-1] in "01" and not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(1)
            return sums(trees, *at)

        return grow(own, *settings, **more)

    monkeypatch.setattr(boosted_trees, "_grow", losing)
    got = boosted_trees.fit_slices(slices, rounds=3)
    assert {p.name for p in tmp_path.iterdir()} == {"0", "1"} and np.array_equal(got.logits(x), want.logits(x))


def test_values_at_a_threshold_go_left():
    model = boosted_trees.BoostedTrees(0.5, np.array([[0, 1, 0]]), np.array([[1.0, np.inf, 2.0]]), np.array([[1.0, 2.0, 3.0, 4.0]]))
    assert model.logits(np.array([[1.0, 9.0], [1.5, 9.0], [2.0, 9.0], [2.5, 9.0]])).tolist() == [1.5, 3.5, 3.5, 4.5]
