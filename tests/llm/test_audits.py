"""Byte-pair codes, source divergence and filter interactions against brute force, and their odd inputs."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tradewind.llm import bpe, catalog, divergence, filters

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
OWN = bpe.Vocabulary(open(VOCABULARY, "rb").read())


def own_ids(text):
    return np.frombuffer(b"".join(OWN.encode(text)), np.int32).tolist()


YOUNG = "".join(chr(c) for c in (0x558, 0xA7CE, 0x1E6C0, 0x323B0) if unicodedata.category(chr(c)) == "Cn")
HARD_TEXTS = [
    "",
    " ",
    "  two  spaces \n\n\t and more　\x85\x1c end  ",
    "it's we'll THEY'RE 'tis x'd 12,345.67 ²³ ½",
    "<|endoftext|>a<|endoftext|> <|endoftext|>  <|endoftext",
    "naïve Ünïcödé 漢字かな 😀👩‍👩‍👧 \U0001d518 مرحبا हिन्दी ไทย",
    "a" + YOUNG + " b" + YOUNG + "1 ",
    "a" * 5_000,
    "ab" * 70_000,
    "word " * 30_000 + "\n" * 70_000 + "end",
    ("x" * 70_000 + "  ") * 2,
    "\u0000\u0001�﻿",
]


@pytest.mark.parametrize("number", range(len(HARD_TEXTS)))
def test_hard_texts_encode_as_the_library(number):
    text = HARD_TEXTS[number]
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own_ids(text) == wanted
    assert OWN.decode(wanted) == LIBRARY.decode(wanted, skip_special_tokens=False)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library(text):
    assert own_ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=12))
def test_any_ids_decode_as_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_every_document_round_trips(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    coded = bpe.encode(docs, VOCABULARY)
    assert coded.columns == ["doc_id", "ids"]
    decoded = bpe.decode(coded, VOCABULARY).collect()
    assert {r["doc_id"]: r["ids"] for r in decoded} == {
        k: LIBRARY.encode(t, add_special_tokens=False).ids for k, t in texts.items()
    }
    assert {r["doc_id"]: r["text"] for r in decoded} == texts


def test_bpe_of_odd_rows(spark):
    schema = "doc_id long, text string, ids string"
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", None), (2, "", "y"), (3, "word " * 20_000, "z")]
    coded = bpe.encode(spark.createDataFrame(rows, schema), VOCABULARY)
    found = {(r["doc_id"], tuple(r["ids"])): r for r in bpe.decode(coded, VOCABULARY).collect()}
    assert sorted(r["text"] for r in found.values()) == ["", "", "a b", "word " * 20_000]
    assert coded.count() == 5
    assert bpe.encode(spark.createDataFrame([], schema), VOCABULARY).count() == 0
    nothing = spark.createDataFrame([(1, None, "old"), (2, [77, -5, 999_999], None)], "k int, ids array<int>, text string")
    assert {r["k"]: r["text"] for r in bpe.decode(nothing, VOCABULARY).collect()} == {1: "", 2: OWN.decode([77])}


def test_batches_end_within_a_partition(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_IDS", 3)
    rows = [(i, "some words of text " * (i % 4)) for i in range(50)]
    df = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), VOCABULARY)
    assert {r["doc_id"]: len(r["ids"]) for r in df.collect()} == {
        i: len(LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in rows
    }


def divergence_by_force(rows, least, top):
    """{(lang, source, part): [(item, value) in order]} straight from the definition."""
    rows = [tuple(x or "" for x in row) for row in rows]
    groups = {(lang, source) for lang, source, _ in rows}
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in documents[lang].items() if n >= least) for lang, _ in groups}

    def shares(lang, parts):
        n = {t: sum(counts[lang, s][t] for s in parts) for t in kept[lang]}
        below = sum(n.values()) + 2 * len(n)
        return {t: 1 + 10**9 * (n[t] + 2) // below for t in n}

    out = {}
    for lang, source in groups:
        others = sorted(s for g, s in groups if g == lang and s != source)
        mine, whole = shares(lang, [source]), shares(lang, {s for g, s in groups if g == lang})
        found = []
        for other in others:
            theirs = shares(lang, [other])
            found.append((other, sum((mine[t] - theirs[t]) ** 2 // (mine[t] + theirs[t]) for t in mine)))
        out[lang, source, "pair"] = found
        out[lang, source, "term"] = [
            (t, (mine[t] - whole[t]) ** 2 // (mine[t] + whole[t])) for t in mine if counts[lang, source][t] and mine[t] > whole[t]
        ]
    ordered = {k: sorted(v, key=lambda x: (-x[1], x[0].encode())) for k, v in out.items()}
    return {k: v[:top] if k[2] == "term" else v for k, v in ordered.items() if v}


def divergence_found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r["lang"], r["source"], r["part"]].append((r["item"], r["value"]))
        assert r["rank"] == len(out[r["lang"], r["source"], r["part"]])
    return dict(out)


SCHEMA = "lang string, source string, text string, term string, path string, rank long"


def audited(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", None, 1) for r in rows], SCHEMA)
    return divergence_found(divergence.divergence_audit(table, **options))


def test_divergence_of_odd_rows(spark):
    rows = [
        (None, None, None),
        (None, "a", "Éa ÉA éA x1y"),
        (None, "a", "Éa ÉA éA x1y"),
        ("", "b", "x y é"),
        ("en", None, "the the cat"),
        ("en", "s", "the " * 20_000 + "cat"),
        ("en", "t", None),
        ("en", "u", "12 34"),
        ("fr", "s", "seul"),
        ("fr", "t", "autre"),
        ("de", "s", "allein"),
    ]
    for least in (1, 2, 50):
        assert audited(spark, rows, least_documents=least) == divergence_by_force(rows, least, 10), least
    assert audited(spark, []) == {}


def test_divergence_of_random_rows_in_small_batches(spark, monkeypatch):
    # Four sources that share many paths; batches, held terms and pairs end often.
    monkeypatch.setattr(divergence, "HELD_TERMS", 7)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 5)
    monkeypatch.setattr(divergence, "SECTION_BYTES", 16)
    draw = random.Random(3)
    words = [a + b for a in "abcdefg" for b in ("", "x", "ö", "Q")]
    rows = [
        (draw.choice(["en", "de"]), draw.choice("stuv"), " ".join(draw.choice(words) for _ in range(draw.randrange(25))))
        for _ in range(150)
    ]
    assert audited(spark, rows, least_documents=3, top_terms=4) == divergence_by_force(rows, 3, 4)


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, v = 9 * 10**15 + 7, 9 * 10**17 + 1, 10**6
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    found = row.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert found == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_tree_shares_paths():
    import pyarrow as pa

    node = [{"source": s, "n": 1, "p": 10, "p0": 4} for s in "abc"]
    rows = [("en", node[:2], 5), ("en", node, 7), ("en", node[:1] + node[2:], 1)]
    schema = pa.schema(
        [("lang", pa.string()), ("path", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64()), ("p", pa.int64()), ("p0", pa.int64())]))), ("times", pa.int64())]
    )
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "path", "times"), r)) for r in rows], schema)
    change = 0 - 36 // 14 - 36 // 14
    found = {(r["first"], r["second"]): r["correction"] for b in divergence._walk_tree(iter([batch])) for r in b.to_pylist()}
    assert found == {("a", "b"): 12 * change, ("a", "c"): 8 * change, ("b", "c"): 7 * change}


def fails(text, doc_id, least_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search("[#$%&*|]", text) is not None,
        "E": doc_id is not None and least_id is not None and doc_id > least_id,
    }


def audit_by_force(docs, labels):
    """Every order applied to every document, one step after the other."""
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    marked = [(p or "", k, fails(t or "", k, first.get(t or ""))) for k, t, p in docs]
    out = {}
    for part in {p for p, _, _ in marked}:
        mine = [(k, f) for p, k, f in marked if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = list(mine), []
            for step, letter in enumerate(order, 1):
                here = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                redundant = sum(f[letter] for _, f in gone)
                gone += here
                unique = sum(f[letter] and sum(f.values()) == 1 for _, f in mine)
                out[part, order, step] = [
                    len(left), len(here), redundant, unique, sum(k in good for k, _ in here), sum(k in toxic for k, _ in here)
                ]
        for letter in "ABCDE":
            places = [(part, o, o.index(letter) + 1) for o in map("".join, itertools.permutations("ABCDE"))]
            total = sum(out[x][1] for x in places)
            for x in places:
                out[x].append(total)
    return out


def audit_found(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(found) == len(rows)
    return found


def test_filter_audit_of_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, None, None), (2, "", "en"), (None, "", "en"), (None, "", "en"), (2, "", "en"),
        (3, long_text, "en"), (3, long_text, "en"), (7, long_text, ""), (9, long_text, "fr"), (None, long_text, "fr"),
        (4, "same " * 300, "fr"), (5, "ABC def", "fr"), (6, long_text + " 5 %", "en"), (8, "SAME " * 30_000, "xx"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (7, 1, 1), (None, 1, 1), (5, None, 1), (9, 1, None)]
    table = spark.createDataFrame([(*d, "x", 5, 1) for d in docs], "doc_id long, text string, lang string, mask string, n int, toxic int")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_found(filters.interaction_audit(table, told)) == audit_by_force(docs, labels)
    assert audit_found(filters.interaction_audit(table, told.limit(0))) == audit_by_force(docs, [])
    assert filters.interaction_audit(table.limit(0), told).count() == 0


def test_filter_audit_of_many_copies(spark):
    docs = [(i, "one text " * (1 + (i % 10 == 0)), "en" if i % 3 else "de") for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 400, 3)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_found(filters.interaction_audit(table, told)) == audit_by_force(docs, labels)


def test_recursion_is_not_stopped_by_many_parts(spark):
    # More parts than the engine's default limit of a million recursion rows allows.
    cells = spark.range(3200).selectExpr("cast(id as string) part", "5 mask", "2L n", "1L good", "0L toxic")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    found = filters.prefix_metrics(cells)
    assert found.count() == 3200 * 325
    assert found.filter("step = 1 AND letter = 'A'").agg({"removed": "sum"}).first()[0] == 6400
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit


def test_queries_equal_their_contract_columns(spark):
    wanted = {
        "op11_source_divergence": {"lang", "source", "part", "item", "value", "rank"},
        "op12_bpe_round_trip": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op13_filter_interactions": {
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
        },
    }
    for name, columns in wanted.items():
        assert set(catalog.queries()[name](spark, SF_DIR).columns) == columns
