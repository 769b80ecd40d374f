import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tests.compare import plan, scale_problem
from tradewind.operators import distance_sums, mean_silhouette, silhouette, silhouettes
from tradewind.plans import themes
from tradewind.schemas import CLUSTER_SCHEMA
from tradewind.sources import Lakehouse

REVIEWS = "review_id string, order_id string, review_score double, review_text string, review_creation_date timestamp"
TOPICS = {
    "delivery": "entrega atrasada demorou semanas chegar transporte",
    "quality": "produto excelente qualidade material perfeito bonito",
    "refund": "reembolso dinheiro devolver cancelar cobranca errada",
}


def reviews(spark, *texts):
    start = dt.datetime(2018, 1, 1)
    rows = [(f"r{i:03d}", f"o{i}", 5.0, text, start + dt.timedelta(hours=i)) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, REVIEWS)


def topic_reviews(spark, each=12):
    words = [text.split() for text in TOPICS.values()]
    texts = []
    for i in range(each):
        for group in words:
            texts.append(" ".join(group[i % len(group) :] + group[: i % len(group)]) + " sempre")
    return reviews(spark, *texts)


def no_clusters(spark):
    return spark.createDataFrame([], CLUSTER_SCHEMA)


def points(spark, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    df = spark.createDataFrame(rows, "review_id int, v array<double>")
    return df.select("review_id", array_to_vector("v").alias("vector"))


def blobs(seed=0, per=40):
    random = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]])
    return np.concatenate([c + random.normal(size=(per, 3)) for c in centres]), np.repeat(np.arange(4), per)


def test_backlog_and_batch(spark):
    stg = reviews(spark, "eleven char", "ten chars.", "another longer text", "third longer text", None)
    done = spark.createDataFrame([("r002",)], "review_id string")
    assert tuple(themes.backlog_counts(stg, done).first()) == (3, 1, 2)
    assert [r["review_id"] for r in themes.next_batch(stg, done, 1).collect()] == ["r000"]
    assert {r["review_id"] for r in themes.next_batch(stg, done, None).collect()} == {"r000", "r003"}


def test_embedding_equals_tf_idf_by_hand(spark):
    texts = ["casa azul casa grande", "casa verde", "Outro texto, outro: TEXTO!", "12 34"]
    got = themes.embed_texts(reviews(spark, *texts), features=1 << 14).orderBy("review_id").collect()
    vectors = [r["vector"].toArray() for r in got]
    tokens = [["casa", "azul", "casa", "grande"], ["casa", "verde"], ["outro", "texto"] * 2, ["12", "34"]]
    df = Counter(t for words in tokens for t in set(words))
    for vector, words in zip(vectors, tokens, strict=True):
        weights = [n * math.log((len(texts) + 1) / (df[t] + 1)) for t, n in Counter(words).items()]
        norm = math.sqrt(sum(w * w for w in weights))
        assert np.allclose(sorted(vector[vector > 0]), sorted(w / norm for w in weights))


def test_empty_text_has_a_zero_vector(spark):
    got = themes.embed_texts(reviews(spark, "some words here", "...")).orderBy("review_id").collect()
    assert got[1]["vector"].toArray().sum() == 0


def test_pluggable_encoder_gets_whole_texts_in_batches(spark):
    def make_encoder():
        def encode(texts):
            assert len(texts) <= themes.ENCODER_BATCH
            return np.array([[len(t), 1.0, 0.0] for t in texts])

        return encode

    long_text = "x" * 50_000
    df = reviews(spark, *(["short text here"] * 200), long_text)
    got = themes.embed_texts(df, make_encoder=make_encoder).collect()
    by_id = {r["review_id"]: r["vector"].toArray() for r in got}
    assert len(by_id) == 201
    assert np.allclose(by_id["r200"][0] / by_id["r200"][1], 50_000)
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in by_id.values())


def test_projection_equals_pca_by_hand(spark):
    matrix, _ = blobs()
    got = themes.project_2d(points(spark, matrix)).orderBy("review_id").select("tsne_x", "tsne_y").collect()
    _, _, axes = np.linalg.svd(matrix - matrix.mean(axis=0))
    expected = matrix @ axes[:2].T
    assert np.allclose(np.abs(np.array(got)), np.abs(expected), atol=1e-6)


def test_projection_of_one_row(spark):
    row = themes.project_2d(points(spark, [[1, 2, 3]])).first()
    assert (row["tsne_x"], row["tsne_y"]) == (0.0, 0.0)


def test_axes_table_gives_the_coordinates(spark):
    matrix, _ = blobs(seed=2)
    df = points(spark, matrix)
    model = themes.fit_axes(df)
    weights = {(r["axis"], r["place"]): r["weight"] for r in themes.axes_table(spark, model).collect()}
    for row in themes.project_2d(df, axes=model).collect():
        for axis, value in ((1, row["tsne_x"]), (2, row["tsne_y"])):
            assert math.isclose(value, sum(x * weights[axis, i] for i, x in enumerate(row["vector"])), abs_tol=1e-9)


def test_k_values():
    assert list(themes.k_values()) == list(range(3, 16)) and list(themes.k_values(5, 6)) == [5, 6]
    assert list(themes.k_values_by_rows(10)) == [3]
    assert list(themes.k_values_by_rows(100)) == [3, 4, 5]
    assert list(themes.k_values_by_rows(10**6)) == list(range(3, 16))


def brute_silhouettes(vectors, labels):
    scores = []
    for i, v in enumerate(vectors):
        distance = np.linalg.norm(vectors - v, axis=1)
        same = labels == labels[i]
        if same.sum() == 1:
            scores.append(0.0)
            continue
        within = distance[same].sum() / (same.sum() - 1)
        nearest = min(distance[labels == other].mean() for other in set(labels) - {labels[i]})
        scores.append((nearest - within) / max(within, nearest) if max(within, nearest) > 0 else 0.0)
    return scores


def labelled(spark, vectors, labels):
    rows = [(i, int(c), [float(x) for x in v]) for i, (v, c) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "review_id int, cluster_id int, vector array<double>").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_silhouettes_of_a_sample_against_all_rows(spark, monkeypatch, seed):
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 7)
    random = np.random.default_rng(seed)
    vectors, labels = random.normal(size=(60, 5)), random.integers(0, 4, 60)
    labels[0] = 9  # a cluster of one
    vectors[5:9] = vectors[5]  # equal rows
    rows = labelled(spark, vectors, labels)
    expected = brute_silhouettes(vectors, labels)
    found = silhouettes(rows, rows.filter("review_id % 3 = 0"), "review_id", "vector", "cluster_id").collect()
    assert sorted(r["review_id"] for r in found) == list(range(0, 60, 3))
    for r in found:
        assert math.isclose(r["silhouette"], expected[r["review_id"]], abs_tol=1e-6)
        assert r["cluster_id"] == labels[r["review_id"]]
    mean = mean_silhouette(rows, rows, "review_id", "vector", "cluster_id")
    assert math.isclose(mean, float(np.mean(expected)), abs_tol=1e-6)


def test_silhouettes_at_the_edges(spark):
    one = labelled(spark, np.arange(6).reshape(3, 2), np.zeros(3))
    assert [r["silhouette"] for r in silhouettes(one, one, "review_id", "vector", "cluster_id").collect()] == [None] * 3
    assert mean_silhouette(one, one, "review_id", "vector", "cluster_id") == -1.0
    equal = labelled(spark, np.ones((4, 2)), [0, 0, 1, 1])
    assert mean_silhouette(equal, equal, "review_id", "vector", "cluster_id") == pytest.approx(0.0, abs=1e-6)
    none = one.limit(0)
    assert silhouettes(one, none, "review_id", "vector", "cluster_id").count() == 0
    assert silhouettes(none, none, "review_id", "vector", "cluster_id").count() == 0
    with pytest.raises(ValueError):
        distance_sums(one, np.zeros((silhouette.LARGEST_SET + 1, 2)), "vector", "cluster_id")


def test_distance_sums_move_one_row_per_point_cluster_and_task(spark):
    random = np.random.default_rng(1)
    rows = labelled(spark, random.normal(size=(500, 3)), np.where(np.arange(500) % 3 == 0, 1, 0))
    sums = distance_sums(rows, np.zeros((2, 3)), "vector", "cluster_id")
    assert {(r["point"], r["cluster"]): r["rows"] for r in sums.collect()} == {(p, c): (333, 167)[c] for p in (0, 1) for c in (0, 1)}
    assert scale_problem(sums) is None


@pytest.mark.parametrize("measure", ["sample", "all"])
def test_choose_k_finds_the_blobs(spark, measure):
    matrix, truth = blobs()
    df = points(spark, matrix)
    choice = themes.choose_k(df, range(3, 7), "review_id", measure=measure, restarts=3)
    assert choice.k == 4 and set(choice.scores) == {3, 4, 5, 6}
    got = {r["review_id"]: r["cluster_id"] for r in themes.assign_clusters(df, choice.model).collect()}
    assert len({(got[i], t) for i, t in enumerate(truth)}) == 4  # equal up to renaming


def test_sample_is_fixed_and_bounded(spark):
    df = points(spark, np.arange(1000).reshape(-1, 1))
    first = {r[0] for r in themes.silhouette_sample(df, "review_id").collect()}
    again = {r[0] for r in themes.silhouette_sample(df.repartition(7), "review_id").collect()}
    assert len(first) == themes.SILHOUETTE_SAMPLE and first == again
    with pytest.raises(ValueError):
        themes.silhouette_sample(df, "review_id", size=10**6)


def test_restarts_never_cost_more(spark):
    matrix, _ = blobs(seed=3)
    df = points(spark, matrix)
    one = themes.fit_clusters(df, 6, restarts=1).summary.trainingCost
    best = themes.fit_clusters(df, 6, restarts=5).summary.trainingCost
    assert best <= one * (1 + themes.COST_TOLERANCE)  # sums over partitions vary in the last digits


def test_representative_texts(spark):
    df = points(spark, [[0, 0], [1, 0], [5, 0], [0, 100], [0, 101]])
    model = themes.fit_clusters(df, 2, restarts=2)
    near = themes.with_distance(themes.assign_clusters(df, model), themes.centres_table(spark, model))
    assigned = near.withColumns(
        {
            "review_text": F.concat(F.lit("text "), F.col("review_id").cast("string")),
            "review_creation_date": F.make_dt_interval(days=-F.col("review_id")) + F.lit("2018-01-01").cast("timestamp"),
        }
    )
    centre = model.clusterCenters()
    nearest = themes.representative_texts(assigned, n=1).collect()
    for row in assigned.collect():
        assert math.isclose(row["distance"], np.linalg.norm(row["vector"].toArray() - centre[row["cluster_id"]]), abs_tol=1e-9)
    for row in nearest:
        own = [r for r in assigned.collect() if r["cluster_id"] == row["cluster_id"]]
        best = min(own, key=lambda r: np.linalg.norm(r["vector"].toArray() - centre[r["cluster_id"]]))
        assert row["review_id"] == best["review_id"]
    first = {r["cluster_id"]: r["review_id"] for r in themes.representative_texts(assigned, n=1, order="fetch").collect()}
    assert set(first.values()) == {2, 4}  # the oldest of each cluster


def test_labels(spark):
    texts = [(0, "entrega entrega atrasada do a"), (0, "Entrega ruim"), (1, "produto bom, bom!"), (1, "entrega boa")]
    assigned = spark.createDataFrame(texts, "cluster_id int, review_text string")
    terms = {(r["cluster_id"], r["term"]): (r["score"], r["position"]) for r in themes.cluster_terms(assigned).collect()}
    counts = Counter(
        (c, w) for c, t in texts for w in t.lower().replace(",", " ").replace("!", " ").split() if len(w) >= 3
    )
    average = counts.total() / 2
    total = Counter()
    for (_, word), n in counts.items():
        total[word] += n
    assert set(terms) == set(counts)
    for key, (score, _) in terms.items():
        assert math.isclose(score, counts[key] * math.log(1 + average / total[key[1]]))
    assert terms[(0, "entrega")][1] == 1 and terms[(1, "bom")][1] == 1

    named = {r["cluster_id"]: r for r in themes.label_clusters(assigned).collect()}
    assert named[0]["cluster_label"].startswith("entrega / ")
    assert not named[0]["cluster_label"].endswith(" / ")
    assert named[0]["cluster_summary"].startswith(named[0]["cluster_label"].replace(" / ", ", "))


def test_discover_themes(spark):
    stg = topic_reviews(spark)
    run = themes.discover_themes(stg, no_clusters(spark), restarts=3, candidates=themes.k_values_by_rows)
    assert run.k == 3 and set(run.scores) == {3}
    samples = run.samples.collect()
    assert {(r["cluster_id"], r["position"]) for r in samples} == {(c, p) for c in range(3) for p in range(1, 11)}
    rows = run.rows.collect()
    assert [f.name for f in run.rows.schema] == [f.name for f in CLUSTER_SCHEMA]
    assert [f.dataType for f in run.rows.schema] == [f.dataType for f in CLUSTER_SCHEMA]
    assert len(rows) == 36 and len({(r["cluster_id"], r["cluster_label"]) for r in rows}) == 3
    topic = {r["review_id"]: int(r["review_id"][1:]) % 3 for r in rows}
    assert len({(topic[r["review_id"]], r["cluster_id"]) for r in rows}) == 3
    assert all(math.isfinite(r["tsne_x"]) for r in rows)

    clusters = themes.write_back(no_clusters(spark), run.rows)
    assert themes.discover_themes(stg, clusters) is None


def test_batches_and_given_labels(spark):
    stg = topic_reviews(spark)
    given = spark.createDataFrame(
        [(i, f"name {i}", "summary") for i in range(3)], "cluster_id int, cluster_label string, cluster_summary string"
    )
    first = themes.discover_themes(stg, no_clusters(spark), limit=20, candidates=[3], restarts=1, labels=given, batch_id="b1")
    stored = themes.write_back(no_clusters(spark), first.rows)
    assert stored.columns[-1] == "batch_id"
    assert {r["cluster_label"] for r in stored.collect()} == {"name 0", "name 1", "name 2"}
    second = themes.discover_themes(stg, stored, limit=20, candidates=[3], restarts=1)
    assert second.rows.count() == 16
    assert second.rows.join(stored, "review_id").count() == 0


def test_labels_made_from_the_representative_texts(spark):
    stg = topic_reviews(spark)

    def make_labels(samples):
        return samples.filter("position = 1").selectExpr(
            "cluster_id", "concat('named after ', review_id) cluster_label", "review_text cluster_summary"
        )

    run = themes.discover_themes(
        stg, no_clusters(spark), candidates=[3], restarts=2, make_labels=make_labels, sample_order="fetch"
    )
    rows = run.rows.collect()
    # In fetch order the first review of a cluster names it.
    first = {}
    for r in sorted(rows, key=lambda r: r["review_id"]):
        first.setdefault(r["cluster_id"], r["review_id"])
    assert {(r["cluster_id"], r["cluster_label"]) for r in rows} == {(c, f"named after {i}") for c, i in first.items()}


def test_short_terms_on_request(spark):
    assigned = spark.createDataFrame([(0, "eu eu eu nao"), (1, "sim e nao")], "cluster_id int, review_text string")
    assert {r["term"] for r in themes.cluster_terms(assigned).collect()} == {"nao", "sim"}
    assert {r["term"] for r in themes.cluster_terms(assigned, least_letters=1).collect()} == {"eu", "nao", "sim", "e"}


def test_one_review(spark):
    run = themes.discover_themes(reviews(spark, "a single long review"), no_clusters(spark), restarts=1)
    assert run.k == 3 and run.rows.count() == 1


def test_write_back_keeps_the_order_id(spark):
    row = ("r", "o", 1, "l", "s", 0.0, 0.0)
    old = spark.createDataFrame([row], CLUSTER_SCHEMA)
    new = spark.createDataFrame([("r", "other", 2, "L", "S", 1.0, 1.0), ("q", "p", 0, "", "", 0.0, 0.0)], CLUSTER_SCHEMA)
    got = {r["review_id"]: tuple(r) for r in themes.write_back(old, new).collect()}
    assert got["r"] == ("r", "o", 2, "L", "S", 1.0, 1.0) and got["q"][1] == "p"


def test_same_seed_same_clusters(spark):
    df = points(spark, blobs(seed=5)[0])
    first, second = (themes.assign_clusters(df, themes.fit_clusters(df, 4, restarts=2)).collect() for _ in range(2))
    assert [r["cluster_id"] for r in first] == [r["cluster_id"] for r in second]


def test_vectors_survive_storage(spark):
    df = themes.embed_texts(topic_reviews(spark, each=2))
    stored = themes.materialize(df, "test-vectors")
    left, right = (d.select("review_id", vector_to_array("vector").alias("v")).orderBy("review_id").collect() for d in (df, stored))
    assert left == right


def test_the_first_batch_is_not_moved_to_look_for_clusters(spark, tmp_path):
    """There are none yet, so texts must not be shuffled for the join with them."""
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    reviews = spark.range(0, 100, 1, 4).select(
        *(F.col("id").cast("string").alias(c) for c in ("review_id", "order_id", "review_score", "review_creation_date")),
        F.lit("long enough a text").alias("review_text"),
    )
    batch = themes.next_batch(reviews, lake.read_or_empty("mart", "review_clusters", CLUSTER_SCHEMA))
    assert batch.count() == 100 and "Exchange" not in plan(batch)
