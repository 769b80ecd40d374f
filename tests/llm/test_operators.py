"""Each operator against a brute-force version on the smallest documents, and its odd inputs."""

import hashlib
import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind import session
from tradewind.llm import catalog, decontaminate, licenses, mixing, near_dedup, neighbours, ppm, private_data, repeats, secrets, toxicity

SF_DIR = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, source string, row string, n long, found string, score double"
ODD_ROWS = [
    (1, None, None, "x", 1, "y", 0.1),
    (2, "", "a", None, None, None, None),
    (None, "one two three four five", "a", "x", 2, "y", 0.2),
    (3, "one two three four five", "a", "x", 2, "y", 0.2),
    (3, "one two three four five", "a", "x", 2, "y", 0.2),
    (4, "word " * 20_000, "b", "x", 2, "y", 0.2),
    (5, 'password = "abcdefgh1234" mail a.b@c.example.org MIT License é 10.0.0.1', None, "x", 2, "y", 0.2),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()
    return {r["doc_id"]: (r["text"] or "", r["source"]) for r in rows}


def answers(spark, name):
    return {r["doc_id"]: r for r in catalog.queries()[name](spark, SF_DIR).collect()}


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def digest(spans, kinds):
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return hashlib.sha256(joined.encode()).hexdigest()


def test_mix(spark, texts):
    found = answers(spark, "op1_mix_sources")
    assert found.keys() == texts.keys()
    per_source = defaultdict(lambda: [0, 0, 0, 0.0])
    for doc, (text, source) in texts.items():
        r, size = found[doc], len(plain_words(text))
        assert r["size"] == size and r["taken"] in (0, size, 2 * size)
        s = per_source[source]
        s[0], s[1], s[2], s[3] = s[0] + size, s[1] + r["taken"], max(s[2], size), r["target"]
        assert r["source_size"] >= size
    sizes = {s: v[0] for s, v in per_source.items()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, free = {}, dict(weights)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(target.values())
        over = [s for s in free if rest * free[s] / sum(free.values()) > 2 * sizes[s]]
        if not over:
            target |= {s: rest * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del free[s]
    for s, (_, taken, largest, given) in per_source.items():
        assert given == pytest.approx(target[s])
        assert abs(taken - given) <= largest / 2 + 1e-6
    assert answers(spark, "op1_mix_sources") == found


def test_settle_keeps_words_and_expectation():
    sizes, rates = np.array([5.0, 3, 3, 2, 1, 1]), np.full(6, 0.4)
    rng, total = np.random.default_rng(1), np.zeros(6)
    for _ in range(4000):
        p = mixing.settle(sizes, rates, rng.random(6), False)
        assert (p * sizes).sum() == pytest.approx(6.0) and ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - 0.4).max() < 0.04


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def private(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        spans += [(m.start(), 1, m.end())] * all(int(p) <= 255 for p in m[0].split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        spans += [(m.start(), 2, m.end())] * (12 <= len(digits) <= 19 and _luhn(digits))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        spans += [(m.start(), 3, m.end())] * (9 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return spans


def test_private_data(spark, texts):
    found = answers(spark, "op2_private_data")
    for doc, (text, _) in texts.items():
        assert found[doc]["base_sha256"] == digest(private(text), private_data.KINDS)


def test_private_patterns_on_odd_strings(spark):
    rows = ["a@b.c_d@e.f", "1.2.3.4.5", "999.1.1.1 01.02.003.4", "4111 1111 1111 1111", "4111  1111-1111-1111 1111", "+1 (555) 123-4567.", "1 2 " * 9000, "é x..y@z.de", "a@b", "+" * 50]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in private_data.private_spans(docs).collect():
        assert r["base_sha256"] == digest(private(rows[r["doc_id"]]), private_data.KINDS), rows[r["doc_id"]]


def _apart(i, n=6):
    """Words no other row has, so that rows are no near copies."""
    return " ".join(f"row{i}word{k}" for k in range(n))


def test_revealing_terms_are_removed(spark):
    rows = [(i, f"{_apart(i)} plain words here") for i in range(60)]
    rows += [(100 + i, f"call {_apart(100 + i)} Zanzibor at a.b@c.org") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in private_data.sanitise(docs).collect()}
    assert "<email>" in out[100] and "Zanzibor" not in out[100] and out[0] == rows[0][1]


def test_revealing_terms_anywhere_in_the_corpus(spark):
    rows = [(i, f"{_apart(i)} plain words here") for i in range(90)]
    rows += [(100 + i, f"{_apart(i + 100)} Zanzibor {_apart(i + 200)} a.b@c.org") for i in range(3)]
    rows += [(200, "back to ZANZIBOR, not Zanziborian"), (300, "x" * 79 + " plain a.b@c.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in private_data.sanitise(docs).collect()}
    assert out[100] == f"{_apart(100)}  {_apart(200)} <email>"
    assert out[200] == "back to , not Zanziborian" and out[300] == "x" * 79 + " plain <email>" and out[0] == rows[0][1]


@pytest.mark.parametrize("copy", ["{0}", "{0} end"])
def test_copies_reveal_nothing(spark, copy):
    rows = [(i, f"{_apart(i)} plain words here") for i in range(60)]
    text = f"{_apart(100, 300)} a.b@c.org"
    rows += [(100, text), (101, copy.format(text)), (102, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in private_data.private_spans(docs).collect()}
    assert found[100]["n_email"] == 1 and all(r["n_term"] == 0 for r in found.values())


def _terms_by_hand(texts, classes, share, bits, least):
    """Revealing terms, counted class by class."""
    terms, entities = defaultdict(set), defaultdict(set)
    for doc, text in texts.items():
        spans = private(text)
        for a, kind, b in spans:
            entities[kind, text[a:b]].add(classes[doc])
        for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
            if not any(a < m.end() and m.start() < b for a, _, b in spans):
                terms[m[0].lower()].add(classes[doc])
    total, found = len(set(classes.values())), set()
    for term, held in terms.items():
        for docs in entities.values():
            both = len(held & docs)
            if len(docs) >= least and both >= least and both / len(held) >= share:
                if math.log2(both / len(held) * total / len(docs)) >= bits:
                    found.add(term)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_terms_against_counting_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"name{i}" for i in range(12)] + ["é", "李明"]
    texts = {}
    for i in range(240):
        said = [_apart(i, 5), *rng.choice(names, 2)]
        if rng.random() < 0.4:
            who = int(rng.integers(6))
            said += [f"user{who}@mail.example.org", names[who * 2], names[-1] if who == 5 else "x"]
        texts[i] = " ".join(rng.permutation(said))
    texts |= {300 + i: texts[i] for i in range(0, 40, 3)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    split = docs.withColumn("w", F.split("text", " "))
    classes = {r[0]: r[1] for r in split.select("doc_id", private_data._copy_class(F.col("w"), F.col("text"))).collect()}
    options = {"share": 0.3, "bits": 1.0, "least": 2}
    expected = _terms_by_hand(texts, classes, **options)
    assert expected
    for r in private_data.private_spans(docs, **options).collect():
        text = texts[r["doc_id"]]
        spans = [s.split(":") for s in r["spans"].split(",") if s.startswith("term")]
        patterns = private(text)
        wanted = [
            m.span()
            for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            if m[0].lower() in expected and not any(a < m.end() and m.start() < b for a, _, b in patterns)
        ]
        assert [(int(a), int(b)) for _, a, b in spans] == wanted


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(list)
    for r in sorted(catalog.queries()["op3_nearest_neighbours"](spark, SF_DIR).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    queries = ids[ids % 50 == 0]
    assert sorted(found) == sorted(queries.tolist())
    hits = 0
    for q in queries:
        near = x @ x[ids == q][0]
        near[ids == q] = -9
        best = ids[np.lexsort((ids, -near))[:5]].tolist()
        assert all(s == pytest.approx(near[ids == v][0]) for v, s in found[q]) and len(found[q]) == 5
        hits += len(set(best) & {v for v, _ in found[q]})
    assert hits >= 0.9 * 5 * len(queries)


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0]), (7, [1.0, 0.1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(vectors, F.col("id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 50), (0, 3, 7), (50, 1, 0), (50, 2, 1), (50, 3, 7)]
    assert neighbours.nearest(vectors.limit(0), F.col("id") % 50 == 0).collect() == []


def labelled(text):
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secrets(spark, texts):
    found = answers(spark, "op4_secret_scan")
    for doc, (text, _) in texts.items():
        assert found[doc]["base_sha256"] == digest(labelled(text), secrets.KINDS)


def test_copied_examples_stay_and_live_values_go(spark):
    rows = [(i, "see token=EXAMPLE0000example", f"owner{i}") for i in range(4)]
    rows += [(9, "my password: hunter2hunter2 and Zx81kQ04vB7nMp2sLw93 here", "owner9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert out[0] == rows[0][1] and out[9] == "my password: <secret> and <secret> here"
    spans = {r["doc_id"]: r for r in secrets.secret_spans(docs).collect()}
    assert spans[9]["spans"] == "assign:3:27,live:32:52" and spans[0]["n_copied"] == 1


@pytest.mark.parametrize("repositories", [24, 25])
def test_one_owners_value_in_many_repositories(spark, repositories):
    rows = [(i, f"note {i} token=Zx81kQ04vB7nMp2sLw93", "one") for i in range(repositories)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r["n_live"], r["n_copied"]) for r in found} == {(1, 0) if repositories < 25 else (0, 1)}


def test_live_tokens_with_few_digits(spark):
    tokens = ["Zx8kQwvBnMpRsLwTyUiO", "wJalrXUtnFEMIbK7MDENGbPxRfiCYzEXAMPLEKEY", "QwErTyUiOpAsDfGhJkLz"]
    docs = spark.createDataFrame([(i, f"see {t} here", f"o{i}") for i, t in enumerate(tokens)], "doc_id long, text string, source string")
    assert {r["text"] for r in secrets.redact(docs).collect()} == {"see <secret> here"}
    assert [r["n_live"] for r in secrets.secret_spans(docs).collect()] == [1, 1, 1]
    plain = spark.createDataFrame([(1, "Donaudampfschifffahrtsgesellschaft HELLO_WORLD_AND_ALL_THE_REST", "a")], "doc_id long, text string, source string")
    assert secrets.secret_spans(plain).first()["n_live"] == 0


def test_ppm(spark, texts):
    found = answers(spark, "op5_ppm_scores")
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: [*plain_words(low(t)), "\0"] for d, (t, _) in texts.items()}
    count, tries = Counter(), [defaultdict(Counter) for _ in range(4)]
    for d, (t, _) in texts.items():
        if not held[d]:
            count.update(tokens[d])
            s = b"\xfe" * 3 + low(t).encode() + b"\xff"
            for j in range(3, len(s)):
                for k in range(4):
                    tries[k][s[j - k : j]][s[j]] += 1
    whole = sum(count.values())

    def log_p(context, byte):
        excluded, score = set(), 0.0
        for k in (3, 2, 1, 0):
            offered = tries[k].get(context[3 - k :], {})
            if offered:
                left = {b: n for b, n in offered.items() if b not in excluded}
                if left:
                    of = sum(left.values()) + len(left)
                    if byte in left:
                        return score + math.log10(left[byte] / of)
                    score += math.log10(len(left) / of)
                excluded = set(offered)
        return score - math.log10(256 - len(excluded))

    for n, (d, (t, _)) in enumerate(texts.items()):
        r = found[d]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d], len(tokens[d]), whole)
        assert r["n_known"] == sum(count[w] > 0 for w in tokens[d])
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (whole + len(count) + 1)) for w in tokens[d]))
        if n < 25:
            s = b"\xfe" * 3 + low(t).encode() + b"\xff"
            assert r["score"] == pytest.approx(sum(log_p(s[j - 3 : j], s[j]) for j in range(3, len(s))))


def test_licenses(spark, texts):
    found = answers(spark, "op6_license_scan")
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for doc, (text, _) in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        r, at = found[doc], [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in places}))


def test_licence_labels(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. General Public License"), (2, "apache said: license")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert found[1]["labels"] == "apache,apache-2.0,gpl" and found[1]["base_labels"] == "apache,gpl"
    assert found[2]["labels"] == "" and found[2]["score"] == 0


def test_licence_labels_without_the_word_licensed(spark):
    rows = [
        "Released under the Apache License, Version 2.0", "Distributed under CC BY 4.0", "under the BSD 3-Clause",
        "under a Creative Commons Attribution", "by 4 cc 0", "4 0 under the BSD clause 3",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = [r["labels"] for r in licenses.license_scan(docs).orderBy("doc_id").collect()]
    assert found == ["apache,apache-2.0", "cc-by", "bsd", "creative-commons", "", ""]


def test_licence_bodies(spark):
    mit = (
        'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation '
        'files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"
    )
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    apache = "you may not use this file except in compliance with the License.\n# You may obtain a copy at\n#   http://www.apache.org/licenses/LICENSE-2.0"
    rows = [
        "x " * 3 + mit, "Own words. " + bsd + " these hold", "SPDX-License-Identifier: Apache-2.0", "under the MIT licence", "Apache License v2.0",
        "Permission is hereby granted, free of charge, to park here.", "binary forms in use and source redistribution",
        apache, "spdx identifier license mit", "either version 3 of the license plate",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = [r["labels"] for r in licenses.license_scan(docs).orderBy("doc_id").collect()]
    assert found == ["mit-text", "bsd", "apache-2.0", "mit", "apache,apache-2.0", "", "", "", "", ""]


def _labels_by_hand(words, templates):
    """Labels of all templates that stand anywhere with their key whole and enough of their words in place."""
    found = set()
    for t in templates:
        text, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(text)) if text[i : i + len(key)] == key)
        for i in range(len(words) - len(key) + 1):
            if words[i : i + len(key)] == key:
                same = sum(0 <= i - at + k < len(words) and words[i - at + k] == w for k, w in enumerate(text))
                if same / len(text) >= licenses.LEAST_SHARE:
                    found.add(t.label)
    return ",".join(sorted(found))


def test_licence_labels_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(150):
        words = " ".join(t.text for t in (licenses.TEMPLATES[k] for k in rng.integers(0, len(licenses.TEMPLATES), 2))).split()
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = "other"
        rows.append(" ".join(words[int(rng.integers(0, 4)) :]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in licenses.license_scan(docs).collect():
        assert r["labels"] == _labels_by_hand(rows[r["doc_id"]].split(), licenses.TEMPLATES), rows[r["doc_id"]]


def near_groups(texts, width):
    sets = {}
    for d, t in texts.items():
        words = plain_words(low(t))
        sets[d] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low_id, high_id = sorted((root(a), root(b)))
                parent[high_id] = low_id
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_duplicates(spark, texts):
    expected = near_groups({d: t for d, (t, _) in texts.items()}, 4)
    for doc, r in answers(spark, "op7_near_duplicates").items():
        assert (r["n_shingles"], r["component_id"]) == expected[doc] and r["kept"] == (doc == r["component_id"])


def test_near_duplicates_in_one_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for d in range(120):
        words = list(base[: 160 if d % 2 else 400])
        for at in rng.integers(0, len(words), rng.integers(0, 14)):
            words[at] = f"x{rng.integers(1000)}"
        texts[d] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = near_groups(texts, 4)
    for r in near_dedup.near_duplicates(docs).collect():
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(docs, width=4).collect()}
    assert kept == {d for d, (_, c) in expected.items() if d == c}


def test_repeats(spark, texts):
    found, length = answers(spark, "op8_repeated_passages"), 200
    raw = {d: t.encode() for d, (t, _) in texts.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    for d, b in raw.items():
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered[:-1]])
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        r = found[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(covered.sum()), runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeats_around_one_common_core(spark, monkeypatch):
    """Many different passages around one core are halved until each bucket is bounded."""
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    core, length = letters(150), 200
    ends = [letters(int(n)) for n in rng.integers(0, 60, 12)]
    raw = [(letters(90) + ends[i % 12] + core + ends[i * 7 % 11] + letters(90)).encode() for i in range(120)]
    docs = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(raw)], "doc_id long, text string")
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    expected = {}
    for d, b in enumerate(raw):
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        expected[d] = int(covered.sum())
    assert any(expected.values())
    halve = repeats._repeats_within
    monkeypatch.setattr(repeats, "_repeats_within", lambda unsure, n: halve(unsure, n, core_bytes=2000))
    found = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_counts(docs).collect()}
    assert found == expected


def test_repeats_sort_a_sign_for_each_core(spark, monkeypatch):
    """Only the bytes beside a core are sorted with it, also where flanks agree and cores do not."""
    rng = np.random.default_rng(31)
    letters = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    cores, flanks, length = [letters(134) for _ in range(4)], [letters(70) for _ in range(5)], 200
    cores += [c[:66] + "\u00e9" + c[67:] for c in cores]
    raw = [(letters(i % 40) + flanks[i % 5] + cores[i % 8] + flanks[i // 8 % 5][: 40 + i % 30] + letters(30)).encode() for i in range(90)]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    expected = {}
    for d, b in enumerate(raw):
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = True
        expected[d] = int(covered.sum())
    assert 0 < sum(expected.values()) < sum(map(len, raw))
    sorted_bytes, write = [], repeats.materialize

    def watched(df, label):
        written = write(df, label)
        if label == "kinds":
            sorted_bytes.append(written.agg({"bytes": "max"}).first()[0])
        return written

    monkeypatch.setattr(repeats, "materialize", watched)
    docs = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(raw)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_counts(docs).collect()}
    assert found == expected
    assert max(sorted_bytes) <= length - repeats.GRAM + repeats.SIGN_BYTES


def test_repeats_remove_what_was_read(spark, tmp_path, monkeypatch):
    """Tables go once the next is written, also those of cores halved again."""
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    core, ends = letters(150), [letters(int(n)) for n in rng.integers(0, 60, 12)]
    raw = [letters(90) + ends[i % 12] + core + ends[i * 7 % 11] + letters(90) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*raw, raw[0]])], "doc_id long, text string")
    expected = sorted(repeats.repeat_counts(docs).collect())
    standing = lambda: Counter(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    rounds, halve, write = [], repeats._repeats_within, repeats.materialize

    def watched(df, label):
        if label == "kinds":
            rounds.append(standing())
        return write(df, label)

    monkeypatch.setattr(repeats, "materialize", watched)
    monkeypatch.setattr(repeats, "_repeats_within", lambda unsure, n: halve(unsure, n, core_bytes=300))
    monkeypatch.setattr(session, "new_shared_path", lambda _, label: f"file:{tmp_path}/{label}-{uuid.uuid4().hex}")
    found = repeats.repeat_counts(docs)
    assert len(rounds) > 1
    for before, now in enumerate(rounds):
        assert now == Counter(["rows", "texts", "pieces", "classes", "wanted", "cells"] + ["parts"] * before)
    assert standing() == Counter(["rows", "answers"] + ["parts"] * len(rounds))
    assert sorted(found.collect()) == sorted(found.collect()) == expected


def test_signs_keep_cores_apart():
    cores = np.array([[5, 1], [5, 1], [5, 2], [-7, 1]] + [[k, 9] for k in range(300)])
    pieces = repeats.signed(cores, [3] * len(cores), [b"abcdef"] * len(cores))
    assert all(len(p) == 6 + repeats.SIGN_BYTES and p.count(255) == 1 for p in pieces)
    found = [bool(f.any()) for f in repeats.repeated_starts(pieces, 5 + repeats.SIGN_BYTES)]
    assert found == [True, True] + [False] * 302


def test_suffix_order():
    rng = np.random.default_rng(5)
    for _ in range(30):
        pieces = [bytes(rng.integers(97, 100, rng.integers(0, 40)).astype(np.uint8)) for _ in range(6)]
        suffixes = [p[i:] for p in pieces for i in range(len(p))]
        assert [suffixes[i] for i in repeats.lyndon_groups(pieces)] == sorted(suffixes)


def test_leaks(spark):
    items = [(1, "Anna buys 3 apples for 12 dollars and gives Anna's brother Paul 3 apples; how many are left?"), (2, None), (3, "two plus two is four"), (None, "x y z"), (4, "!!!")]
    docs = [
        (10, "Intro. Maria buys 5 apples for 20 euros and gives Maria's brother Karl 5 apples; how many are left? End"),
        (11, "Intro. Maria buys 5 apples for 20 euros and gives Maria's brother Karl 7 apples; how many are left? End"),
        (12, None), (13, ""), (14, "well two plus two is four indeed"), (15, "clean text"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontaminate.leaks(d, b).collect()} == {(10, 1, False), (14, 3, True)}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()} == {11, 12, 13, 15}
    assert decontaminate.leaks(d, b.limit(0)).collect() == []


def test_leaks_with_shifted_words(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(18)) for _ in range(3))
    items = [(1, f"so {a} 900 {b}"), (2, f"so {c} 5 km"), (3, "Anna Maria buys 3"), (4, " ".join(str(n) for n in range(100, 130)))]
    docs = [
        (10, f"Well, so {a} 1,250 {b}."),
        (11, f"Well, so {a} more 900 {b}."),
        (12, f"Well, so {a}. " + "other words in between " * 40 + f"{b}."),
        (13, f"So {c} 3.5km"),
        (14, "they say Anna Maria buys 3"),
        (15, "of 1 2 3 4 5 6 7 8 no"),
        (16, f"So {a[:70]} {b[:70]}"),
    ]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["verbatim"]) for r in decontaminate.leaks(d, i).collect()}
    assert found == {(10, 1): (31, 31, False), (11, 1): (31, 24, True), (13, 2): (14, 14, False), (14, 3): (1, 1, True)}


def test_template_tokens():
    def tokens(text):
        data = np.frombuffer(text.encode(), np.uint8)
        shown, own, _, _ = decontaminate.template(data, np.array([0, len(data)]))
        return shown.tolist(), own.tolist()

    for one, other in [("so 3.5 x", "so 1,250,000 x"), ("so 5km x", "so 5 km x"), ("so 3.5kg x", "so 7 kg x"), ("so Anna Maria x", "so Karl x")]:
        assert tokens(one)[0] == tokens(other)[0]
    assert tokens("so 5km x") == tokens("so 5 km x") and tokens("so Anna Maria x") == tokens("so Anna-Maria x")
    assert len(tokens("so 3, 4. 5 x")[0]) == 5 and len(tokens("so Anna, Maria x")[0]) == 4


def test_alignments_count_together():
    a, b = [(p, []) for p in range(12)], [(p, []) for p in range(19, 31)]
    assert decontaminate.matched([(0, a), (1, b)], 38, 31) == (24, True)
    assert decontaminate.matched([(0, a), (90, b)], 38, 31) == (12, True)
    # Values that map to two values do not count together, and a place counts for one position.
    assert decontaminate.matched([(0, [(p, [(3, 5)]) for p in range(12)]), (1, [(p, [(3, 7)]) for p in range(19, 31)])], 38, 31) == (12, False)
    assert decontaminate.matched([(-p, [(p, [])]) for p in range(20)], 38, 31) == (1, True)


def _all_common_windows(hits, windows, whole, coverage):
    pairs = hits.join(windows, ["width", "hash"])
    return pairs.select("id", "item", (F.col("position") - F.col("item_position")).alias("shift"), "item_position", "slots", "item_slots")


@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_all_common_windows(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"w{rng.integers(60)}x" for _ in range(int(rng.integers(4, 14)))) for _ in range(12)]
    item = lambda: " ".join(rng.choice(passages, int(rng.integers(1, 4))))
    items = spark.createDataFrame([(i, item()) for i in range(40)], "item_id long, text string")
    said = lambda: " and ".join(rng.choice(passages, int(rng.integers(1, 5))))
    docs = spark.createDataFrame([(i, said()) for i in range(80)] + [(None, passages[0])], "doc_id long, text string")
    found = sorted(map(str, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "_aligned", _all_common_windows)
    assert found and found == sorted(map(str, decontaminate.leaks(docs, items).collect()))


def test_a_passage_of_many_items_and_documents_is_not_multiplied(spark, monkeypatch):
    passage = "these ten words are the same in every single question asked"
    items = [(i, f"{passage} " + " ".join(f"tail{i}of{k}" for k in range(30))) for i in range(30)]
    docs = [(i, f"note {i} {passage}") for i in range(50)] + [(99, items[7][1])]
    seen, aligned = [], decontaminate._aligned
    monkeypatch.setattr(decontaminate, "_aligned", lambda *a: seen.append(aligned(*a)) or seen[0])
    found = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(99, 7)]
    assert {(r["id"], r["item"]) for r in seen[0].select("id", "item").collect()} == {(99, 7)}


def test_verbatim_leaks(spark, texts):
    items = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in catalog.queries()["op9_decontaminate"](spark, SF_DIR).collect()}
    whole = {d: " ".join(re.findall(r"[^\W_]+", t.lower())) for d, (t, _) in texts.items()}
    assert found >= {(d, i) for d, t in whole.items() for i, w in items.items() if f" {' '.join(w)} " in f" {t} "}


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        words = [f"w{rng.integers(300)}" for _ in range(60)]
        if i % 3 == 0:
            words[rng.integers(60)] = ("horrid", "vile")[i % 2]
            words[rng.integers(60)] = "rotten"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.toxic_scores(docs, labels).collect()}
    held = [(scored[i]["predicted"], y) for i, _, y in rows if scored[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    untaught = toxicity.toxic_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in untaught] == [0.5]


ON_DOCUMENTS = {
    "mix": mixing.mix,
    "mix_documents": mixing.mix_documents,
    "private": private_data.private_spans,
    "sanitise": private_data.sanitise,
    "secrets": secrets.secret_spans,
    "redact": secrets.redact,
    "ppm": lambda d: ppm.scores(d, d["doc_id"] % 2 == 0),
    "licenses": licenses.license_scan,
    "near": near_dedup.near_duplicates,
    "drop_near": near_dedup.drop_near_duplicates,
    "repeats": repeats.repeat_counts,
    "toxic": lambda d: toxicity.toxic_scores(d, d.select("doc_id", F.lit(0).alias("toxic"))),
    "drop_toxic": lambda d: toxicity.drop_toxic(d, d.select("doc_id", F.lit(0).alias("toxic"))),
    "drop_leaks": lambda d: decontaminate.drop_leaks(d, d.select(F.col("doc_id").alias("item_id"), F.lit("some other question").alias("text"))),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_odd_documents(spark, name):
    docs = spark.createDataFrame(ODD_ROWS, ODD)
    out = ON_DOCUMENTS[name](docs).collect()
    fewer = {"mix_documents": len(out), "drop_near": 6}.get(name, len(ODD_ROWS))
    assert len(out) == fewer
    assert ON_DOCUMENTS[name](docs.limit(0)).collect() == []
