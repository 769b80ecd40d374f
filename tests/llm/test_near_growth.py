"""Pairs compared for one group of near copies grow with its size, not with its square."""

import random

import pytest

from tradewind.llm import near_dedup


def group(spark, n):
    draw = random.Random(n)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(draw.randrange(1, 7)):
            words[draw.randrange(300)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("n", [100, 400])
def test_pairs_grow_with_the_group(spark, monkeypatch, n):
    made = []

    def noted(df, label):
        out = real(df, label)
        if label in ("pairs", "across"):
            made.append((label, out.count()))
        return out

    real = near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", noted)
    found = near_dedup.near_duplicates(group(spark, n)).collect()
    assert {r["component_id"] for r in found} == {0}
    assert all(count <= n + 1 for label, count in made if label == "pairs"), made
    assert sum(count for label, count in made if label == "across") <= n, made
