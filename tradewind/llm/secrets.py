"""Secret scans with corpus-wide ownership frequency.

Patterns find labelled secrets (`assign`), access keys (`access`) and hexadecimal strings (`hex`);
long mixed tokens (digits and letters, or a capital right behind a small letter) outside of these are
candidates without a label. Every candidate value is hashed,
and for every hash the distinct owners and the documents (each its own repository) are counted over
the whole corpus. A value that several owners hold, or that very many repositories of few owners hold,
is a widely copied example; one with fewer of both looks live. Live tokens without a label become spans of the kind `live`; labelled
spans are always reported, and `redact` takes only live values out of the texts.

Scanning stays in the rows' own tasks; only hashes are shuffled, counted per owner first, so that a
value all documents repeat is one row per task and owner.

Defined results: NULL and empty texts have no spans; a NULL owner is one owner of its own; repeated
rows are scanned each and count as documents; an empty table gives no rows. Columns of the
input that clash with result columns are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.bytetext import chunks, words
from tradewind.llm.common import keeps_input_names
from tradewind.session import materialize

KINDS = ("assign", "access", "hex", "live")
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 25
TOKEN_BYTES = 20
TOKEN_ENTROPY = 3.0

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LABELS = re.compile(rb"password|passwd|secret|token|api_?key", re.IGNORECASE)

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
_DIGIT, _CAPITAL, _SMALL = np.zeros((3, 256), bool)
_DIGIT[48:58] = _CAPITAL[65:91] = _SMALL[97:123] = True

_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("value_start", T.IntegerType()),
            T.StructField("value_end", T.IntegerType()),
            T.StructField("hash", T.LongType()),
        ]
    )
)
_FOUND_ARROW = pa.list_(
    pa.struct(
        [
            ("start", pa.int32()),
            ("kind", pa.int32()),
            ("end", pa.int32()),
            ("value_start", pa.int32()),
            ("value_end", pa.int32()),
            ("hash", pa.int64()),
        ]
    )
)


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def labelled_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of all labelled secrets."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for kind, pattern, least in ((1, ACCESS, 16), (2, HEX, 32)):
        if kind == 2 or "AKIA" in text:
            found += [(m.start(), kind, m.end(), *m.span()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(found)


def _candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple]:
    """Labelled spans and the tokens (in code points) outside of them, with the hash of each value."""
    found = labelled_spans(text)
    outside = []
    for start, end in tokens:
        if _entropy(text[start:end]) >= TOKEN_ENTROPY and not any(s < end and start < e for s, _, e, _, _ in found):
            outside.append((start, 3, end, start, end))
    return [
        (*span, int.from_bytes(hashlib.sha256(text[span[3] : span[4]].encode()).digest()[:8], "big", signed=True))
        for span in sorted(found + outside)
    ]


def _suspects(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Rows that can hold a candidate, with the byte ranges of their long mixed tokens."""
    rows: dict[int, list[tuple[int, int]]] = {}
    starts, ends, row = words(data, offsets, _HEX_BYTE)
    for r in row[ends - starts >= 32].tolist():
        rows.setdefault(r, [])
    raw = data.tobytes()
    for pattern in (_LABELS, re.compile(rb"AKIA")):
        for m in pattern.finditer(raw):
            rows.setdefault(int(np.searchsorted(offsets, m.start(), "right")) - 1, [])
    starts, ends, row = words(data, offsets, _TOKEN_BYTE)
    long = np.flatnonzero(ends - starts >= TOKEN_BYTES)
    starts, ends, row = starts[long], ends[long], row[long]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_SMALL[data] | _CAPITAL[data])])
    inner = np.concatenate([[0, 0], np.cumsum(_SMALL[data[:-1]] & _CAPITAL[data[1:]])])
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts]) | (inner[ends] > inner[starts + 1])
    for k in np.flatnonzero(mixed).tolist():
        r = int(row[k])
        rows.setdefault(r, []).append((int(starts[k] - offsets[r]), int(ends[k] - offsets[r])))
    return rows


def scan(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row with `found`, the candidates of its whole text."""
    plain = docs.select(*[docs[c].alias(c) for c in keep if c != "__found"], docs[text_col].alias("__text"))
    fields = [f for f in plain.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for first, _, data, offsets in chunks(texts):
                for r, tokens in _suspects(data, offsets).items():
                    text = texts[first + r].as_py()
                    raw = text.encode()
                    tokens = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in tokens]
                    found[first + r] = _candidates(text, tokens)
            names = ("start", "kind", "end", "value_start", "value_end", "hash")
            column = pa.array([[dict(zip(names, c)) for c in row] for row in found], _FOUND_ARROW)
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, column], names=[*[f.name for f in fields], "__found"])

    return plain.mapInArrow(run, T.StructType([*fields, T.StructField("__found", _FOUND)]))


def ownership(scanned: DataFrame, owner: str) -> DataFrame:
    """(hash, owners, repositories) of every candidate value in the corpus."""
    held = scanned.select(
        F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"),
        F.explode(F.array_distinct(F.transform("__found", lambda c: c["hash"]))).alias("hash"),
    )
    per_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")
    )


def judge(
    scanned: DataFrame, owner: str, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES
) -> tuple[DataFrame, DataFrame]:
    """`scanned` written with a `__row` number, and per row with candidates its judged spans.

    The second has (__row, judged), an array of (start, kind, end, value_start, value_end, live).
    """
    rows = materialize(scanned.withColumn("__row", F.monotonically_increasing_id()), "scanned")
    held = rows.filter(F.size("__found") > 0).select("__row", owner, "__found")
    single = held.select("__row", F.explode("__found").alias("c")).select("__row", "c", F.col("c.hash").alias("hash"))
    judged = (
        single.join(ownership(held, owner), "hash")
        .select(
            "__row",
            F.struct(
                *[F.col(f"c.{n}").alias(n) for n in ("start", "kind", "end", "value_start", "value_end")],
                ((F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)).alias("live"),
            ).alias("span"),
        )
        .groupBy("__row")
        .agg(F.sort_array(F.collect_list("span")).alias("judged"))
    )
    return rows, judged


def _joined(spans):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document: counts per kind, all labelled spans hashed, and all spans with the live tokens."""
    keyed = docs.select(docs[id_col].alias("id"), docs[owner_col].alias("owner"), docs[text_col].alias("text"))
    rows, judged = judge(scan(keyed, "text", ["id", "owner"]), "owner")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value_start:int,value_end:int,live:boolean>>")
    spans = F.coalesce(F.col("judged"), none)
    base = F.filter(spans, lambda s: s["kind"] < 3)
    shown = F.filter(spans, lambda s: (s["kind"] < 3) | s["live"])
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return rows.select("__row", "id").join(judged, "__row", "left").select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(shown).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


@keeps_input_names
def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", mark: str = "<secret>") -> DataFrame:
    """`docs` with every value that looks live replaced by `mark`; widely copied examples stay."""
    columns = docs.columns
    rows, judged = judge(scan(docs, text_col, columns), owner_col)
    live = judged.select("__row", F.filter("judged", lambda s: s["live"]).alias("__live")).filter(F.size("__live") > 0)
    # Cut front to back; `at` is the end of what has been copied, overlapping values are cut once.
    text = F.col(text_col)
    begun = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    ordered = F.array_sort(F.transform("__live", lambda s: F.struct(s["value_start"].alias("a"), s["value_end"].alias("b"))))
    cut = F.aggregate(
        ordered,
        begun,
        lambda acc, s: F.when(s["b"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["done"],
                    F.when(
                        s["a"] >= acc["at"],
                        F.concat(F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit(mark)),
                    ).otherwise(F.lit("")),
                ).alias("done"),
                s["b"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    changed = F.when(F.col("__live").isNull(), text).otherwise(cut)
    suspects = rows.filter(F.size("__found") > 0).join(live, "__row", "left")
    # Most rows have no candidate and are not shuffled.
    clean = rows.filter(F.size("__found") == 0).select(*columns)
    return clean.unionByName(suspects.select(*[changed.alias(c) if c == text_col else F.col(c) for c in columns]))
