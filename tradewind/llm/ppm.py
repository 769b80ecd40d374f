"""Language-model scores by prediction by partial matching, with word counts as the base line.

The model is a trie of byte contexts of up to three bytes, counted over the training documents. A byte not
seen after the longest context is reached through escapes (method C: one escape per different
byte), and bytes that the longer context offers are excluded from the shorter one's counts. The trie stays
a set of tables: counts per four bytes are summed by shuffle, shorter contexts are sums of these, and a
few joins give the log probability of every four bytes that occur anywhere.

Neither the trie nor the vocabulary has a bound, so neither is broadcast. Documents are dealt into blocks of
about `BLOCK_BYTES`; each block asks once for its different words and four-byte strings, and gets one answer for
each, so what is shuffled is far less than a row per token. Documents travel compressed.

Defined results: a NULL text is empty; an empty text has one token, its end; without training
documents every byte has probability 1/256 and no token is known; repeated rows are scored and learnt
each; a NULL id counts as training; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.bytetext import Hashes, chunks, words
from tradewind.session import materialize

BLOCK_BYTES = 24 << 20
ALPHABET = 256
_WORD, _GRAM = 0, 1
# Bytes that never occur in UTF-8: before the text, and after it.
_BEFORE, _AFTER = 0xFE, 0xFF
_END_WORD = -1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIRECT_PAIRS = 2048


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte keys of every byte and end with its three bytes before; first key of every text."""
    sizes = np.diff(offsets)
    n = len(sizes)
    stream = np.full(len(data) + 4 * n, _BEFORE, np.uint8)
    row = np.repeat(np.arange(n), sizes)
    stream[np.arange(len(data)) + 4 * row + 3] = _LOWER[data]
    ends = offsets[1:] + 4 * np.arange(n) + 3
    stream[ends] = _AFTER
    wide = stream.astype(np.uint32)
    key = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    coded = stream[3:] != _BEFORE
    return key[coded], offsets[:-1] + np.arange(n)


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Sum counted keys of several parts."""
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    numbers = np.concatenate([c for _, c in parts])
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, numbers, minlength=len(found)).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block in a batch as one compressed payload."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        blocks, first = np.unique(block[order], return_index=True)
        plain = batch.select(["id", "train", "text"])
        for b, rows in zip(blocks.tolist(), np.split(order, first[1:])):
            part, sink = plain.take(pa.array(rows)), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                writer.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"]
            )


def _unpacked(table: pa.Table) -> Iterator[tuple[pa.Table, int, int, np.ndarray, np.ndarray]]:
    for payload in table.column("payload"):
        part = pa.ipc.open_stream(payload.as_buffer()).read_all()
        for first, last, data, offsets in chunks(part.column("text")):
            yield part, first, last, data, offsets


def _word_hashes(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = words(data, offsets)
    hashed = Hashes(data).of(starts, ends).view(np.int64)
    hashed[hashed == _END_WORD] = 0
    return hashed, row


def _ask(block: pa.Table) -> pa.Table:
    """(block, kind, key, n): the different words and four-byte strings of a block, counted in training texts."""
    seen: dict[int, list] = {_WORD: [], _GRAM: []}
    for part, first, last, data, offsets in _unpacked(block):
        train = np.asarray(part.column("train").combine_chunks())[first:last]
        hashed, row = _word_hashes(data, offsets)
        keys, begins = grams(data, offsets)
        per_key = np.repeat(train, np.diff(np.append(begins, len(keys))))
        ends = np.full(last - first, _END_WORD)
        for kind, found, learnt in (
            (_WORD, np.append(hashed, ends), np.append(train[row], train)),
            (_GRAM, keys.astype(np.int64), per_key),
        ):
            seen[kind].append(_counts(found[learnt]))
            others = np.unique(found[~learnt])
            seen[kind].append((others, np.zeros(len(others), np.int64)))
    number = block.column("block")[0].as_py()
    tables = []
    for kind, parts in seen.items():
        keys, n = _merged(parts, np.int64)
        tables.append(
            pa.table(
                {
                    "block": pa.array(np.full(len(keys), number, np.int32)),
                    "kind": pa.array(np.full(len(keys), kind, np.int32)),
                    "key": pa.array(keys),
                    "n": pa.array(n),
                }
            )
        )
    return pa.concat_tables(tables)


def _answer(train_tokens: int, vocabulary: int):
    """Scores of a block's documents from the answers to what it asked."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        kind = replies.column("kind").to_numpy()
        key, value = replies.column("key").to_numpy(), replies.column("value").to_numpy()
        order = np.argsort(key[kind == _WORD])
        shared_key, shared_count = key[kind == _WORD][order], value[kind == _WORD][order].astype(np.int64)
        look_up = _gram_table(key[kind == _GRAM], value[kind == _GRAM])
        # Words that no other block has are answered by the block's own counts.
        local = []
        if block.num_rows:
            for part, first, last, data, offsets in _unpacked(block):
                train = np.asarray(part.column("train").combine_chunks())[first:last]
                hashed, row = _word_hashes(data, offsets)
                local.append(_counts(np.append(hashed[train[row]], np.full(int(train.sum()), _END_WORD))))
        word_key, word_count = _merged(local, np.int64)
        if len(shared_key):
            at = np.minimum(np.searchsorted(word_key, shared_key), max(len(word_key) - 1, 0))
            own = word_key[at] == shared_key if len(word_key) else np.zeros(len(shared_key), bool)
            word_count[at[own]] = shared_count[own]
            word_key, word_count = np.append(word_key, shared_key[~own]), np.append(word_count, shared_count[~own])
            order = np.argsort(word_key)
            word_key, word_count = word_key[order], word_count[order]
        tables = [pa.table({name: pa.array([], t) for name, t in _RESULT})]
        below = np.log10(train_tokens + vocabulary + 1)

        def counted(found):
            if not len(word_key):
                return np.zeros(len(found), np.int64)
            at = np.minimum(np.searchsorted(word_key, found), len(word_key) - 1)
            return np.where(word_key[at] == found, word_count[at], 0)

        for part, first, last, data, offsets in _unpacked(block) if block.num_rows else ():
            n = last - first
            hashed, row = _word_hashes(data, offsets)
            c, c_end = counted(hashed), counted(np.array([_END_WORD]))[0]
            keys, begins = grams(data, offsets)
            base = np.bincount(row, np.log10(c + 1.0), minlength=n) + np.log10(c_end + 1.0)
            tokens = np.bincount(row, minlength=n) + 1
            tables.append(
                pa.table(
                    {
                        "id": part.column("id").slice(first, n).cast(pa.int64()),
                        "train": part.column("train").slice(first, n),
                        "n_tokens": pa.array(tokens.astype(np.int64)),
                        "n_known": pa.array((np.bincount(row[c > 0], minlength=n) + int(c_end > 0)).astype(np.int64)),
                        "base_score": pa.array(base - tokens * below),
                        "score": pa.array(np.add.reduceat(look_up(keys), begins)),
                    }
                )
            )
        return pa.concat_tables(tables).combine_chunks()

    return run


_RESULT = (
    ("id", pa.int64()),
    ("train", pa.bool_()),
    ("n_tokens", pa.int64()),
    ("n_known", pa.int64()),
    ("base_score", pa.float64()),
    ("score", pa.float64()),
)


def _gram_table(key: np.ndarray, value: np.ndarray):
    """Log probabilities by four-byte key; a table over pairs of byte pairs where these are few."""
    order = np.argsort(key)
    key, value = key[order].astype(np.uint32), value[order]
    pairs = np.unique(np.concatenate([key >> np.uint32(16), key & np.uint32(0xFFFF)]))
    if len(pairs) > _DIRECT_PAIRS:
        return lambda asked: value[np.searchsorted(key, asked)]
    place = np.zeros(65536, np.int64)
    place[pairs] = np.arange(len(pairs))
    table = np.zeros(len(pairs) ** 2)
    table[place[key >> np.uint32(16)] * len(pairs) + place[key & np.uint32(0xFFFF)]] = value
    return lambda asked: table[place[asked >> np.uint32(16)] * len(pairs) + place[asked & np.uint32(0xFFFF)]]


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each four-byte key's last byte after the other three.

    `counts` has (key, n) with n = 0 for keys that only other texts have.
    """
    mask = {3: 0xFFFFFFFF, 2: 0xFFFFFF, 1: 0xFFFF, 0: 0xFF}
    seen = {3: counts.filter("n > 0").select("key", "n")}
    for order in (2, 1, 0):
        longer = seen[order + 1]
        shorter = longer.groupBy(F.col("key").bitwiseAND(F.lit(mask[order])).alias("key")).agg(F.sum("n").alias("n"))
        seen[order] = materialize(shorter, "contexts")
    asked = counts.select("key", F.col("n").alias("n3"))
    for order in (3, 2, 1):
        # What the shorter context counts for the bytes this one offers.
        shorter = seen[order - 1].select(F.col("key").alias("short"), F.col("n").alias("n_short"))
        nodes = (
            seen[order]
            .withColumn("short", F.col("key").bitwiseAND(F.lit(mask[order - 1])))
            .join(shorter, "short")
            .groupBy(F.shiftright("key", 8).alias(f"node{order}"))
            .agg(F.sum("n").alias(f"held{order}"), F.count(F.lit(1)).alias(f"kinds{order}"), F.sum("n_short").alias(f"lent{order}"))
        )
        asked = asked.withColumn(f"node{order}", F.shiftright(F.col("key").bitwiseAND(F.lit(mask[order])), 8))
        asked = asked.join(nodes, f"node{order}", "left")
        asked = asked.withColumn(f"gram{order - 1}", F.col("key").bitwiseAND(F.lit(mask[order - 1])))
        grams_below = seen[order - 1].select(F.col("key").alias(f"gram{order - 1}"), F.col("n").alias(f"n{order - 1}"))
        asked = asked.join(grams_below, f"gram{order - 1}", "left")
    total, kinds = seen[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    asked = asked.withColumn("held0", F.lit(total)).withColumn("kinds0", F.lit(kinds))

    def at(order: int) -> Column:
        if order < 0:
            return -F.log10(F.greatest(F.lit(ALPHABET) - F.col("kinds0"), F.lit(1)).cast("double"))
        zero = F.lit(0)
        held, kinds_here = F.coalesce(f"held{order}", zero), F.coalesce(f"kinds{order}", zero)
        if order < 3:
            held, kinds_here = held - F.coalesce(f"lent{order + 1}", zero), kinds_here - F.coalesce(f"kinds{order + 1}", zero)
        whole, n = (held + kinds_here).cast("double"), F.coalesce(f"n{order}", zero)
        # A context never seen, or with nothing left to offer, is passed without cost.
        return (
            F.when(whole <= 0, at(order - 1))
            .when(n > 0, F.log10(n / whole))
            .otherwise(F.log10(kinds_here / whole) + at(order - 1))
        )

    return asked.select("key", at(3).alias("value"))


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; `train` is a condition on `docs`."""
    text = docs[text_col]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = docs.select(
        F.pmod(F.xxhash64(docs[id_col], text), F.lit(blocks)).cast("int").alias("block"),
        docs[id_col].cast("long").alias("id"),
        F.coalesce(train, F.lit(True)).alias("train"),
        text.alias("text"),
    ).mapInArrow(_pack, "block int, payload binary")
    asked = materialize(
        dealt.groupBy("block").applyInArrow(_ask, "block int, kind int, key long, n long"), "asked"
    )
    train_tokens = asked.filter(F.col("kind") == _WORD).agg(F.sum("n")).first()[0] or 0

    of_key = Window.partitionBy("key")
    known = asked.filter(F.col("kind") == _WORD).select(
        "block",
        "key",
        F.sum("n").over(of_key).alias("total"),
        F.count(F.lit(1)).over(of_key).alias("blocks"),
        F.min("block").over(of_key).alias("first"),
    )
    # The vocabulary's size is counted in passing: each key at its first block.
    known = materialize(
        known.filter((F.col("blocks") > 1) | (F.col("total") > 0)).select(
            "block", "key", "total", "blocks", ((F.col("first") == F.col("block")) & (F.col("total") > 0)).alias("counts")
        ).withColumn("key", F.when(F.col("blocks") > 1, F.col("key"))),
        "known",
    )
    vocabulary = known.filter("counts").count()
    word_replies = known.filter("blocks > 1").select("block", F.lit(_WORD).alias("kind"), "key", F.col("total").cast("double").alias("value"))

    asked_grams = asked.filter(F.col("kind") == _GRAM)
    counts = materialize(asked_grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    model = materialize(log_probabilities(counts), "model")
    gram_replies = asked_grams.select("block", "kind", "key").join(model, "key").select("block", "kind", "key", "value")
    replies = word_replies.unionByName(gram_replies)
    result = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    answered = (
        dealt.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(_answer(int(train_tokens), int(vocabulary)), result)
    )
    return answered.withColumn("train_tokens", F.lit(train_tokens).cast("long")).withColumnRenamed("id", id_col)
