import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector

from tradewind.operators import kmeans
from tradewind.plans import themes


def matrix(seed, rows=300, places=4):
    random = np.random.default_rng(seed)
    return random.normal(size=(rows, places)) + 6 * random.integers(0, 3, size=(rows, 1))


def frame(spark, values):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(values)]
    return spark.createDataFrame(rows, "review_id int, v array<double>").repartition(5).select("review_id", array_to_vector("v").alias("vector"))


def test_passes_do_not_grow_with_the_number_of_fits(spark, monkeypatch):
    df, passes, whole = frame(spark, matrix(1)), [], kmeans.tallies
    monkeypatch.setattr(kmeans, "tallies", lambda *a, **b: passes.append(1) or whole(*a, **b))
    models = themes.fit_each_k(df, range(3, 9), restarts=4)
    assert set(models) == set(range(3, 9))
    assert len(passes) <= kmeans.MAX_STEPS + kmeans.ROUNDS + 2


def test_sums_of_rows_by_hand(spark, monkeypatch):
    monkeypatch.setattr("tradewind.operators.kmeans.BLOCK_ROWS", 7)
    values = matrix(2)
    groups = [values[:3], values[10:15], values[20:21]]
    points = frame(spark, values).select(themes.vector_to_array("vector"))
    for centres, tally in zip(groups, kmeans.tallies(points, groups)):
        distances = ((values[:, None] - centres) ** 2).sum(axis=2)
        best = distances.argmin(axis=1)
        for c in range(len(centres)):
            assert tally.rows[c] == (best == c).sum()
            assert np.allclose(tally.sums[c], values[best == c].sum(axis=0))
            assert np.isclose(tally.costs[c], distances[best == c, c].sum())


def test_fits_are_settled_and_cost_no_more_than_spark_ml(spark):
    values = matrix(3)
    df = frame(spark, values)
    for k, model in themes.fit_each_k(df, [2, 3], restarts=4).items():
        distances = ((values[:, None] - model.centres) ** 2).sum(axis=2)
        best = distances.argmin(axis=1)
        assert np.isclose(model.cost, distances.min(axis=1).sum())
        assert [r["cluster_id"] for r in themes.assign_clusters(df, model).orderBy("review_id").collect()] == best.tolist()
        assert np.allclose(model.centres, [values[best == c].mean(axis=0) for c in range(k)], atol=1e-3)
        theirs = min(KMeans(k=k, featuresCol="vector", seed=s).fit(df).summary.trainingCost for s in range(4))
        assert model.cost <= theirs * 1.01


@pytest.mark.parametrize("k", [2, 5])
def test_silhouettes_are_those_of_spark_ml(spark, k):
    df = frame(spark, np.concatenate([matrix(4), [[90.0] * 4]]))  # one row far off, alone
    model = themes.fit_clusters(df, k, restarts=2)
    points = df.select(themes.vector_to_array("vector"))
    evaluator = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster_id")
    expected = evaluator.evaluate(themes.assign_clusters(df, model))
    # Centres no row is nearest to take no part.
    empty = kmeans.ClusterModel(np.concatenate([model.centres, [[-500.0] * 4]]), model.cost)
    one = kmeans.ClusterModel(model.centres[:1], 0.0)
    assert kmeans.mean_squared_silhouettes(points, [model, empty, one]) == pytest.approx([expected, expected, -1.0])


def test_fewer_distinct_rows_than_clusters(spark):
    df = frame(spark, np.repeat(np.arange(4.0).reshape(2, 2), 10, axis=0))
    model = themes.fit_clusters(df, 5, restarts=3)
    assert sorted(map(tuple, model.centres)) == [(0, 1), (2, 3)] and model.cost == pytest.approx(0)
    with pytest.raises(ValueError):
        themes.fit_clusters(df.limit(0), 3)
