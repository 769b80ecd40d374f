"""Personal data by patterns, and words that give a protected entity away by co-occurrence.

Patterns find email addresses, IP addresses, card numbers and phone numbers; each different value is a
protected entity. The words of its documents that lie in no pattern are candidate terms. Over the whole corpus,
documents that hold a term are counted, and documents that hold it and an entity: where the share of the entity among
the term's documents, P(entity | term), reaches `share` and its information log2(P(entity | term) / P(entity))
reaches `bits`, the term reveals the entity and becomes a span of the kind `term` wherever it stands in the
corpus. `sanitise` generalises patterns to their kind and removes the terms.

Copies are no evidence: documents count by copy class, the smallest hash of their five-word shingles (of
shorter texts, the hash of the text). Equal texts always share it, texts of similarity s with probability s. A class
holds what any of its documents holds; all probabilities are shares of classes.

A term and an entity meet only where the counts of either allow both bounds: an entity has at least `least` classes
and at most 2**-bits of all, a term at most 1 / share times the entity's. Terms, and entities, that stand in the
same classes are compared once, so a long document does not pair all its words with all its entities. The rest of the
corpus is counted only for terms that would pass if they stood nowhere else. No pair that passes is lost.

Only DataFrame functions are used. Positions come from the lengths of the matches and of the text
between them. Patterns are rewritten with possessive groups, which match the same but need no stack and no
second try on long runs.

Defined results: NULL and empty texts have no spans; repeated rows are scanned each and count as one document;
an empty table gives no rows. Further columns are ignored by `private_spans` and kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import PLAIN_WORD_PATTERN, keeps_input_names
from tradewind.session import materialize

KINDS = ("email", "ip", "card", "phone", "term")
SHARE = 0.5
BITS = 4.0
LEAST_CLASSES = 2
SHINGLE_WORDS = 5
BROADCAST_TERMS = 100_000
BROADCAST_TERM_BYTES = 16 << 20

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What a text must hold for a match that passes the checks; cheap, and no match is lost.
_POSSIBLE = (r"@[A-Za-z0-9-]++\.", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]")
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: Column, value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, small)
        .when(kind == 2, F.when(n.between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def _located(texts: DataFrame, keys: list[str], text: str, pattern: Column) -> DataFrame:
    """(keys, start, end, value) of every match of `pattern` in `text`; `keys` identify a row."""
    pairs = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("value"))
    pieces = texts.select(*keys, F.posexplode(pairs).alias("at", "p")).select(
        *keys, "at", F.length("p.gap").alias("gap"), F.col("p.value").alias("value")
    )
    so_far = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("value"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(so_far)
    return pieces.select(*keys, "value", end.cast("int").alias("end"), size.alias("size")).filter("value IS NOT NULL").select(
        *keys, (F.col("end") - F.col("size")).alias("start"), "end", "value"
    )


def _patterns(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of the base kinds."""
    found = None
    for kind, (pattern, possible) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE), _POSSIBLE)):
        some = rows.filter(F.col("text").rlike(possible))
        spans = _located(some, ["row"], "text", F.lit(pattern)).withColumn("kind", F.lit(kind))
        found = spans if found is None else found.unionByName(spans)
    return found.filter(_passes(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value")


def _words(text) -> Column:
    """The different words of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def _copy_class(words: Column, text: Column) -> Column:
    """Smallest hash of the five-word shingles of a text, given with its words."""
    shingles = F.transform(
        F.sequence(F.lit(1), F.size(words) - (SHINGLE_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE_WORDS))
    )
    return F.when(F.size(words) >= SHINGLE_WORDS, F.array_min(shingles)).otherwise(F.xxhash64(F.coalesce(text, F.lit(""))))


def _few(terms: DataFrame) -> DataFrame:
    """`terms` for a join, broadcast if their number and bytes are within the bounds."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(terms) if size["n"] <= BROADCAST_TERMS and size["bytes"] <= BROADCAST_TERM_BYTES else terms


def _class_sets(held: DataFrame, key: str, name: str, count: str) -> DataFrame:
    """(key, name, count): the number of the key's classes and, alike for keys of the same classes, their set."""
    return held.groupBy(key).agg(
        F.count(F.lit(1)).alias(count),
        F.struct(F.bit_xor(F.xxhash64("class")).alias("a"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("b")).alias(name),
    )


def _terms(texts: DataFrame, base: DataFrame, share: float, bits: float, least: int) -> DataFrame:
    """(row, kind, start, end) of the terms that give an entity away. `texts` has (row, class, text)."""
    total = texts.select("class").distinct().count()
    own = base.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    apart = ~F.exists("own", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    spanned = texts.join(own.select("row"), "row", "left_semi")
    words = materialize(
        _located(spanned, ["row", "class"], "text", F.lit(_TERM))
        .join(own, "row")
        .filter(apart)
        .select("row", "class", F.lower("value").alias("term"), "start", "end"),
        "words",
    )

    entity = F.xxhash64("kind", "value").alias("entity")
    holders = materialize(base.select("row", entity).distinct().join(texts.select("row", "class"), "row").select("class", "entity").distinct(), "holders")
    # A little more than 2**-bits, as the bound itself is compared below.
    most = total / 2.0**bits * (1 + 1e-9)
    entities = _class_sets(holders, "entity", "entities", "documents").filter((F.col("documents") >= least) & (F.col("documents") <= most))
    holders = materialize(holders.join(entities, "entity").select("class", "entities", "documents").distinct(), "entities")
    candidates = materialize(
        words.select("class", "term").distinct().join(holders.select("class").distinct(), "class", "left_semi"), "candidates"
    )
    sets = materialize(_class_sets(candidates, "term", "terms", "n").filter(F.col("n") >= least), "sets")
    counted = materialize(candidates.join(sets, "term").select("class", "terms", "n").distinct(), "counted")

    # `among` documents hold the term; those counted so far are the fewest it can be.
    def passes(among: str) -> Column:
        given = F.col("together") / F.col(among)
        return (given >= share) & (F.log2(given * total / F.col("documents")) >= bits)

    likely = (
        counted.alias("c")
        .join(holders.alias("h"), (F.col("c.class") == F.col("h.class")) & (F.col("c.n") * share <= F.col("h.documents")))
        .groupBy("entities", "documents", "terms", "n")
        .agg(F.count(F.lit(1)).alias("together"))
        .filter((F.col("together") >= least) & passes("n"))
    )
    likely = materialize(likely.join(sets.select("terms", "term"), "terms").select("term", "together", "documents").distinct(), "likely")
    wanted = _few(materialize(likely.select("term").distinct(), "wanted"))
    # All rows that hold such a term; in those with a pattern it must stand outside.
    stand = texts.select("row", "class", F.explode(_words("text")).alias("term")).join(wanted, "term")
    stand = materialize(stand.join(own.select("row"), "row", "left_anti").select("row", "class", "term"), "stand")
    held = stand.select("class", "term").unionByName(words.join(wanted, "term").select("class", "term")).distinct()
    held = held.groupBy("term").agg(F.count(F.lit(1)).alias("held"))
    revealing = _few(materialize(likely.join(held, "term").filter(passes("held")).select("term").distinct(), "revealing"))
    others = stand.join(revealing, "term").select("row").distinct()
    elsewhere = _located(texts.join(others, "row", "left_semi"), ["row"], "text", F.lit(_TERM)).select(
        "row", F.lower("value").alias("term"), "start", "end"
    )
    places = words.select("row", "term", "start", "end").unionByName(elsewhere)
    return places.join(revealing, "term").select("row", F.lit(4).alias("kind"), "start", "end")


def _found(
    docs: DataFrame, columns: list[Column], text_col: str, text: str, share: float, bits: float, least: int
) -> tuple[DataFrame, DataFrame]:
    """The rows numbered and written, and (__row, __found): the sorted spans (start, kind, end) of each that has some.

    `text` is the name of the text among `columns`.
    """
    likely = F.coalesce(docs[text_col].rlike("|".join(f"(?:{p})" for p in _POSSIBLE)), F.lit(False))
    split = F.regexp_extract_all(F.coalesce(docs[text_col], F.lit("")), F.lit(PLAIN_WORD_PATTERN), F.lit(0))
    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), *columns, likely.alias("__likely"), split.alias("__words"))
    numbered = numbered.withColumn("__class", _copy_class(F.col("__words"), F.col(text))).drop("__words")
    rows = materialize(numbered, "rows")
    texts = rows.select(F.col("__row").alias("row"), F.col("__class").alias("class"), F.col(text).alias("text"), "__likely")
    base = materialize(_patterns(texts.filter("__likely").select("row", "text")), "base")
    spans = base.select("row", "kind", "start", "end").unionByName(_terms(texts.drop("__likely"), base, share, bits, least))
    found = F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("__found")
    return rows, spans.groupBy(F.col("row").alias("__row")).agg(found)


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def private_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = SHARE,
    bits: float = BITS,
    least: int = LEAST_CLASSES,
) -> DataFrame:
    """One row per document: counts per kind, base spans hashed, and all spans with the revealing terms."""
    rows, found = _found(docs, [docs[id_col].alias("id"), docs[text_col].alias("text")], text_col, "text", share, bits, least)
    spans = F.coalesce("__found", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return rows.select("__row", "id").join(found, "__row", "left").select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] < 4)).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        count(4).alias("n_term"),
    )


@keeps_input_names
def sanitise(
    docs: DataFrame, text_col: str = "text", share: float = SHARE, bits: float = BITS, least: int = LEAST_CLASSES
) -> DataFrame:
    """`docs` with every pattern span generalised to `<kind>` and every revealing term removed."""
    names = docs.columns
    rows, found = _found(docs, [docs[c].alias(c) for c in names], text_col, text_col, share, bits, least)
    text = F.col(text_col)
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS[:4]], F.lit(""))
    cut = F.aggregate(
        "__found",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["done"],
                    F.when(s["start"] >= acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise(F.lit("")),
                    F.element_at(kinds, s["kind"] + 1),
                ).alias("done"),
                s["end"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    changed = F.when(F.col("__found").isNull(), text).otherwise(cut)
    return rows.join(found, "__row", "left").select(*[changed.alias(c) if c == text_col else F.col(c) for c in names])
