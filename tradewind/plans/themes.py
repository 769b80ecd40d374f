"""Review themes: embed unprocessed review texts, cluster them, name the clusters, store the result.

Only bounded values reach the driver: counts, scores, cluster centres, the two projection axes
and the fixed-size silhouette sample. Fitted models are also tables (`centres_table`,
`axes_table`), so that what they say can be joined with the rows and checked in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, PCAModel, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.operators import top_per_group, upsert
from tradewind.operators.kmeans import ClusterModel, fit_all, mean_squared_silhouettes
from tradewind.operators.silhouette import LARGEST_SET, as_array, mean_silhouette
from tradewind.plans.staging import MIN_TEXT_LENGTH
from tradewind.schemas import CLUSTER_KEY, CLUSTER_SCHEMA, CLUSTER_UPDATES
from tradewind.session import discard, materialize, side_by_side

# Batch size, seed, restarts, sample size, k range.
ENCODER_BATCH = 64
SEED = 42
RESTARTS = 10
SILHOUETTE_SAMPLE = 300
K_MIN, K_MAX, ROWS_PER_K = 3, 15, 20
SAMPLE_TEXTS = 10

LABEL_TERMS, SUMMARY_TERMS = 3, 10
MIN_TERM_LENGTH = 3
HASH_FEATURES = 512
COST_TOLERANCE = 1e-9
FITS_AT_ONCE = 8
NOT_A_LETTER = r"[^\p{L}]+"

Encoder = Callable[[list[str]], np.ndarray]


# -- backlog -----------------------------------------------------------------------------


def _with_text(stg_reviews: DataFrame) -> DataFrame:
    return stg_reviews.filter(F.length("review_text") > MIN_TEXT_LENGTH)


def backlog_counts(stg_reviews: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: total, processed and unprocessed reviews."""
    done = clusters.select("review_id", F.lit(True).alias("done"))
    joined = _with_text(stg_reviews).select("review_id").join(done, "review_id", "left")
    return joined.agg(
        F.count("review_id").alias("total"),
        F.count_if(F.col("done")).alias("processed"),
        (F.count("review_id") - F.count_if(F.col("done"))).alias("unprocessed"),
    )


def next_batch(stg_reviews: DataFrame, clusters: DataFrame, limit: int | None = None) -> DataFrame:
    """Reviews without a cluster row: all of them, or with `limit` the oldest."""
    waiting = (
        _with_text(stg_reviews)
        .select("review_id", "order_id", "review_score", "review_text", "review_creation_date")
        .join(clusters.select("review_id"), "review_id", "left_anti")
    )
    if limit is None:
        return waiting
    return waiting.orderBy(*_fetch_order()).limit(limit)


def _fetch_order() -> list[Column]:
    return [F.col("review_creation_date").asc_nulls_last(), F.col("review_id").asc_nulls_last()]


# -- vectors -----------------------------------------------------------------------------


def embed_texts(
    df: DataFrame,
    text: str = "review_text",
    output: str = "vector",
    features: int = HASH_FEATURES,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Adds an L2-normalised vector of each whole text.

    Default: hashed TF-IDF from Spark ML. `make_encoder` plugs in a model instead: it is called
    once per task and returns a function from a list of texts to a matrix, which then gets
    `ENCODER_BATCH` texts at a time.
    """
    if make_encoder is not None:
        encoded = _encode(df, text, make_encoder)
        return Normalizer(inputCol="__dense", outputCol=output).transform(encoded).drop("__dense")
    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="__words", outputCol="__counts", numFeatures=features),
            IDF(inputCol="__counts", outputCol="__weights"),
            Normalizer(inputCol="__weights", outputCol=output),
        ]
    )
    return stages.fit(df).transform(df).drop("__words", "__counts", "__weights")


def _encode(df: DataFrame, text: str, make_encoder: Callable[[], Encoder]) -> DataFrame:
    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            rows: list = []
            for start in range(0, len(texts), ENCODER_BATCH):
                rows.extend(np.asarray(encoder(texts.iloc[start : start + ENCODER_BATCH].tolist()), dtype=float))
            yield pd.Series(rows, index=texts.index)

    return df.withColumn("__dense", array_to_vector(encode(text)))


def fit_axes(df: DataFrame, vector: str = "vector") -> PCAModel:
    """The two leading principal axes of the vectors."""
    return PCA(k=2, inputCol=vector, outputCol="__plane").fit(df.select(vector))


def axes_table(spark: SparkSession, model: PCAModel) -> DataFrame:
    """(axis, place, weight): the axes by vector place, two rows per dimension."""
    weights = model.pc.toArray()
    rows = [(axis + 1, place, float(w)) for place, pair in enumerate(weights) for axis, w in enumerate(pair)]
    return spark.createDataFrame(rows, "axis int, place int, weight double")


def project_2d(
    df: DataFrame, vector: str = "vector", x: str = "tsne_x", y: str = "tsne_y", axes: PCAModel | None = None
) -> DataFrame:
    """Adds the two leading principal components, as plot coordinates (0, 0 for a single row)."""
    if axes is None and len(df.select(vector).take(2)) < 2:
        return df.withColumns({x: F.lit(0.0), y: F.lit(0.0)})
    plane = vector_to_array("__plane")
    return (axes or fit_axes(df, vector)).transform(df).withColumns({x: plane[0], y: plane[1]}).drop("__plane")


# -- clusters ----------------------------------------------------------------------------


def k_values(low: int = K_MIN, high: int = K_MAX) -> range:
    """Cluster counts to try, whatever the number of rows."""
    return range(low, high + 1)


def k_values_by_rows(rows: int) -> range:
    """Fewer cluster counts for small batches: one more per `ROWS_PER_K` rows, between the usual bounds."""
    return k_values(K_MIN, min(K_MAX, max(K_MIN, rows // ROWS_PER_K)))


def fit_each_k(
    df: DataFrame, candidates: Iterable[int], vector: str = "vector", seed: int = SEED, restarts: int = RESTARTS
) -> dict[int, ClusterModel]:
    """For every k, k-means from `restarts` starting points and the model with the lowest cost.

    All fits of all k move on together, a pass over the vectors per step. There are fewer than `k`
    clusters when there are fewer distinct vectors.
    """
    with _kept(df, vector) as points:
        return _best_of_each_k(points, candidates, seed, restarts)


@contextmanager
def _kept(df: DataFrame, vector: str) -> Iterator[DataFrame]:
    """The vectors alone, as arrays, kept for passes over them."""
    points = df.select(as_array(df, vector).alias("vector")).persist()
    try:
        yield points
    finally:
        points.unpersist()


def _best_of_each_k(points: DataFrame, candidates: Iterable[int], seed: int, restarts: int) -> dict[int, ClusterModel]:
    wanted = sorted(set(candidates))
    fits = fit_all(points, wanted, restarts, seed)
    best = {}
    for k in wanted:
        found = [fits[k, i] for i in range(restarts)]
        lowest = min(model.cost for model in found)
        # Sums over partitions vary in the last digits; the earliest start wins such ties.
        best[k] = next(model for model in found if model.cost <= lowest * (1 + COST_TOLERANCE))
    return best


def fit_clusters(
    df: DataFrame, k: int, vector: str = "vector", seed: int = SEED, restarts: int = RESTARTS
) -> ClusterModel:
    """k-means from `restarts` starting points; the model with the lowest cost."""
    return fit_each_k(df, [k], vector, seed, restarts)[k]


def centres_table(spark: SparkSession, model: ClusterModel) -> DataFrame:
    """(cluster_id, centre): one row per cluster."""
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster_id int, centre array<double>")


def with_distance(
    df: DataFrame, centres: DataFrame, vector: str = "vector", output: str = "distance"
) -> DataFrame:
    """Adds each row's distance to the centre of its cluster, computed in the JVM; `centres` has one row per cluster."""
    squares = F.zip_with(as_array(df, vector), F.col("centre"), lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda sum_, x: sum_ + x)
    return df.join(F.broadcast(centres), "cluster_id", "left").withColumn(output, F.sqrt(total)).drop("centre")


def assign_clusters(df: DataFrame, model: ClusterModel, vector: str = "vector") -> DataFrame:
    return model.assign(df, vector, "cluster_id")


def silhouette_sample(
    df: DataFrame, key: str, vector: str = "vector", size: int = SILHOUETTE_SAMPLE, seed: int = SEED
) -> DataFrame:
    """A fixed random sample: the `size` rows with the smallest digest of seed and key."""
    if size > LARGEST_SET:
        raise ValueError(f"the sample is broadcast; at most {LARGEST_SET} rows")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(drawn, key).limit(size).select(key, vector)


@dataclass(frozen=True)
class KChoice:
    k: int
    model: ClusterModel
    scores: dict[int, float]


def choose_k(
    df: DataFrame,
    candidates: Iterable[int],
    key: str,
    vector: str = "vector",
    measure: str = "all",
    seed: int = SEED,
    restarts: int = RESTARTS,
) -> KChoice:
    """The k with the highest silhouette (lowest k wins ties), with its fitted model.

    measure="sample" is the mean Euclidean silhouette of a fixed sample of rows, each judged
    against all rows; measure="all" is the squared-Euclidean silhouette of every row. Both
    are linear in the rows. `df` is read several times, so it should be a stored table.
    """
    with _kept(df, vector) as points:
        models = _best_of_each_k(points, candidates, seed, restarts)
        if measure == "sample":
            found = _silhouettes_of_sample(df.select(key, vector), models.values(), key, vector, seed)
        else:
            found = mean_squared_silhouettes(points, list(models.values()))
    scores = dict(zip(models, found))
    best = max(sorted(scores), key=scores.__getitem__)
    return KChoice(best, models[best], scores)


def _silhouettes_of_sample(
    points: DataFrame, models: Iterable[ClusterModel], key: str, vector: str, seed: int
) -> list[float]:
    sample = silhouette_sample(points, key, vector, seed=seed)

    def score(model: ClusterModel) -> Callable[[], float]:
        assigned, chosen = (assign_clusters(rows, model, vector) for rows in (points, sample))
        return lambda: mean_silhouette(assigned, chosen, key, vector, "cluster_id")

    return side_by_side(points.sparkSession, "silhouette", [score(m) for m in models], FITS_AT_ONCE)


# -- labels ------------------------------------------------------------------------------


def representative_texts(assigned: DataFrame, n: int = SAMPLE_TEXTS, order: str = "centre") -> DataFrame:
    """`n` texts per cluster: nearest to the centre by column `distance` (`with_distance`), or first in
    fetch order (order="fetch")."""
    keys = _fetch_order() if order == "fetch" else [F.col("distance").asc(), F.col("review_id").asc_nulls_last()]
    columns = ["cluster_id", "review_id", "review_text", "position"]
    return top_per_group(assigned, ["cluster_id"], keys, n, position="position").select(*columns)


def cluster_terms(
    assigned: DataFrame, text: str = "review_text", n: int = SUMMARY_TERMS, least_letters: int = MIN_TERM_LENGTH
) -> DataFrame:
    """The `n` most telling terms of at least `least_letters` letters per cluster: cluster_id, term, score, position.

    A term scores its count in the cluster times ln(1 + average words per cluster / its count
    over all clusters). Words are counted per cluster and term on the map side; what is
    shuffled afterwards has at most one row per cluster and distinct term.
    """
    words = assigned.select("cluster_id", F.explode(F.split(F.lower(text), NOT_A_LETTER)).alias("term"))
    counts = (
        words.filter(F.length("term") >= least_letters)
        .groupBy("cluster_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    counts = materialize(counts, "terms")  # used twice; texts are split into words once
    average = counts.agg(F.sum("tf") / F.count_distinct("cluster_id")).scalar()
    everywhere = F.sum("tf").over(Window.partitionBy("term"))  # at most k rows per term
    scored = counts.withColumn("score", F.col("tf") * F.log(1 + average / everywhere))
    best = [F.col("score").desc(), F.col("term").asc()]
    return top_per_group(scored, ["cluster_id"], best, n, position="position").drop("tf")


def label_clusters(
    assigned: DataFrame, text: str = "review_text", least_letters: int = MIN_TERM_LENGTH
) -> DataFrame:
    """cluster_id, cluster_label and cluster_summary made of the cluster's leading terms."""
    terms = F.transform(
        F.sort_array(F.collect_list(F.struct("position", "term"))), lambda entry: entry["term"]
    )
    return (
        cluster_terms(assigned, text, least_letters=least_letters)
        .groupBy("cluster_id")
        .agg(terms.alias("terms"))
        .select(
            "cluster_id",
            F.array_join(F.slice("terms", 1, LABEL_TERMS), " / ").alias("cluster_label"),
            F.array_join("terms", ", ").alias("cluster_summary"),
        )
    )


def attach_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """Label and summary by cluster_id; a cluster without a label gets NULL."""
    return assigned.join(labels, "cluster_id", "left")


# -- the whole run -----------------------------------------------------------------------


def write_back(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """Merge cluster rows by review_id; a match keeps its order_id."""
    return upsert(clusters, rows, CLUSTER_KEY, update_cols=CLUSTER_UPDATES)


@dataclass(frozen=True)
class ThemeRun:
    """Rows for the cluster table, the k chosen with the scores of all tried, and the representative texts."""

    rows: DataFrame
    k: int
    scores: dict[int, float]
    samples: DataFrame


def discover_themes(
    stg_reviews: DataFrame,
    clusters: DataFrame,
    limit: int | None = None,
    measure: str = "all",
    restarts: int = RESTARTS,
    candidates: Iterable[int] | Callable[[int], Iterable[int]] = k_values(),
    labels: DataFrame | None = None,
    make_labels: Callable[[DataFrame], DataFrame] | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    features: int = HASH_FEATURES,
    batch_id: str | None = None,
    sample_order: str = "centre",
) -> ThemeRun | None:
    """Cluster the next batch of unprocessed reviews; None when there is none.

    The rows have the layout of the cluster table and are meant for `write_back`. Cluster ids
    and labels are those of this batch; `batch_id` adds a column telling batches apart.
    `candidates` are the cluster counts to try, or a rule that makes them from the number of
    rows (`k_values_by_rows`). `labels` (cluster_id, cluster_label, cluster_summary) replaces the
    generated names; `make_labels` makes such a table from the representative texts.
    """
    # Fitting the term weights reads the batch once and applying them once more.
    batch = materialize(next_batch(stg_reviews, clusters, limit), "batch", "zstd")
    if batch.isEmpty():
        discard(batch)
        return None
    spark = batch.sparkSession
    vectors = materialize(embed_texts(batch, features=features, make_encoder=make_encoder), "vectors", "zstd")
    # Cluster ids go to the rows with the plot coordinates, all in one pass at the end.
    placed = project_2d(vectors)
    if callable(candidates):
        candidates = candidates(vectors.count())
    choice = choose_k(vectors, candidates, "review_id", measure=measure, restarts=restarts)
    near = with_distance(assign_clusters(placed, choice.model), centres_table(spark, choice.model))
    assigned = materialize(near.drop("vector"), "assigned", "zstd")
    discard(batch, vectors)
    samples = representative_texts(assigned, order=sample_order)
    if labels is None:
        # One row per cluster, and there are k of them.
        labels = F.broadcast(make_labels(samples) if make_labels else label_clusters(assigned))
    named = attach_labels(assigned, labels)
    rows = named.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CLUSTER_SCHEMA))
    if batch_id is not None:
        rows = rows.withColumn("batch_id", F.lit(batch_id))
    return ThemeRun(rows, choice.k, choice.scores, samples)
