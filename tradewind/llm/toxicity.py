"""Toxicity scores: logistic regression over hashed n-grams and skip-grams, fitted with FTRL-proximal.

Features are the distinct words, word stems (the first 4, 5 and 6 bytes of longer words), word pairs
and pairs with one or two words between them of a text, hashed into 2**18 places. FTRL keeps a learning rate per place, and its L1 term leaves most weights at
zero, so what is broadcast for scoring is bounded by the number of places, not by the data. The fit
sees at most `max_rows` labelled rows, those with the smallest hash of the id; scoring covers
whole texts of all rows, in the tasks.

Defined results: a NULL or empty text has no features and scores the intercept; rows whose label or
id is NULL are not learnt from; an id labelled more than once counts with its largest label; repeated rows are
scored each; with nothing to learn from every score is 0.5; an empty table gives no rows. Neither
id, source nor any other column enters the score. A column of the input that clashes with a result
column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.bytetext import Hashes, chunks, mix, words
from tradewind.llm.common import fold_of, keeps_input_names

PLACES_BITS = 18
SKIPS = (1, 2, 3)
STEMS = (4, 5, 6)
MAX_ROWS = 10_000
THRESHOLD = 0.7

# Letters, digits and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 4


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of every word, then of every stem and of every pair at each distance."""
    starts, ends, row = words(data, offsets, WORD)
    hashes = Hashes(data)
    hashed = hashes.of(starts, ends)
    shift = np.uint64(64 - PLACES_BITS)
    yield row, (hashed >> shift).astype(np.int32)
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        stems = mix(hashes.of(starts[longer], starts[longer] + size) + np.uint64(size))
        yield row[longer], (stems >> shift).astype(np.int32)
    for gap in SKIPS:
        if len(row) > gap:
            same = row[:-gap] == row[gap:]
            pair = mix(hashed[:-gap] * np.uint64(3) + hashed[gap:] + np.uint64(gap))
            yield row[:-gap][same], (pair[same] >> shift).astype(np.int32)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct places of each labelled text, as packed 32-bit integers."""
    for batch in batches:
        for first, last, data, offsets in chunks(batch.column("text")):
            rows, places = zip(*_features(data, offsets))
            row, place = np.concatenate(rows).astype(np.int64), np.concatenate(places)
            keys = np.unique((row << 32) | place)
            row = keys >> 32
            cuts = np.searchsorted(row, np.arange(last - first + 1))
            packed = (keys & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("order").slice(first, last - first),
                    batch.column("label").slice(first, last - first),
                    pa.array([packed[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ],
                names=["order", "label", "places"],
            )


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, settings: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Weights and intercept after `epochs` passes over the rows in the order given."""
    z = np.zeros((1 << PLACES_BITS) + 1)
    n = np.zeros_like(z)

    def weights(at):
        za = z[at]
        w = -(za - np.sign(za) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        w[np.abs(za) <= settings.l1] = 0.0
        return w

    bias = np.array([1 << PLACES_BITS])
    for _ in range(settings.epochs):
        for places, label in zip(rows, labels):
            at = np.concatenate([places, bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - step * w
            n[at] += g * g
    every = np.arange(len(z))
    all_weights = weights(every)
    return all_weights[:-1], float(all_weights[-1])


def train(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
    max_rows: int = MAX_ROWS, settings: Ftrl = Ftrl(),
) -> tuple[np.ndarray, float]:
    """Fit on at most `max_rows` rows, in one task; only the weights that are not zero come back."""
    order = F.xxhash64(labelled[id_col], F.lit(7))
    sample = labelled.select(
        order.alias("order"),
        labelled[label_col].cast("double").alias("label"),
        labelled[text_col].alias("text"),
    ).filter("label IS NOT NULL")
    # The chosen rows by id first, so that the sort moves no texts.
    chosen = sample.select("order").orderBy("order").limit(max_rows).distinct()
    places = sample.join(chosen, "order", "left_semi").mapInArrow(_places, "order long, label double, places binary")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "places"], kind="stable")
        w, bias = fit_ftrl([np.frombuffer(p, np.int32) for p in rows["places"]], rows["label"].to_numpy(), settings)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": np.append(at, -1), "weight": np.append(w[at], bias)})

    found = places.groupBy().applyInPandas(fit, "place long, weight double").toPandas()
    weights = np.zeros(1 << PLACES_BITS, np.float64)
    inside = found[found["place"] >= 0]
    weights[inside["place"].to_numpy()] = inside["weight"].to_numpy()
    return weights, float(found.loc[found["place"] < 0, "weight"].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """`docs` without the text, with the probability of the label in `name`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs[c] for c in docs.columns if c not in (text_col, name)]
    plain = docs.select(*kept, docs[text_col].alias("__text"))
    fields = [f for f in plain.schema.fields if f.name != "__text"]

    def run(batches):
        weights, bias = sent.value
        used = weights != 0
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for first, last, data, offsets in chunks(batch.column("__text")):
                found = [np.zeros(0, np.int64)]
                for row, place in _features(data, offsets):
                    hit = used[place]
                    found.append((row[hit].astype(np.int64) << 32) | place[hit])
                keys = np.unique(np.concatenate(found))
                total[first:last] += np.bincount(keys >> 32, weights[keys & 0xFFFFFFFF], minlength=last - first)
            value = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=[*[f.name for f in fields], name])

    return plain.mapInArrow(run, type(plain.schema)([*fields]).add(name, "double"))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Texts with their label (the largest, where an id has several)."""
    marks = labels.groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    return docs.join(marks, docs[id_col] == marks["id"]).select(marks["id"], docs["text"].alias("text"), marks["label"])


def held_out(doc_id):
    return fold_of(doc_id, 3) == 1


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every row; ids of the held-out fold are not learnt from."""
    marked = labelled_rows(docs, labels, id_col)
    model = train(marked.filter(~held_out(F.col("id"))), "id", max_rows=max_rows)
    scored = score(docs.select(docs[id_col].alias("id"), docs["text"].alias("text")), model)
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


@keeps_input_names
def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    model = train(labelled_rows(docs, labels, id_col).filter(~held_out(F.col("id"))), "id", max_rows=max_rows)
    columns = docs.columns
    scored = score(docs.withColumn("__copy", docs["text"]), model, text_col="__copy", name="__score")
    return scored.filter(F.col("__score") < THRESHOLD).select(*columns)
