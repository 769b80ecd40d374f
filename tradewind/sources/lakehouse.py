"""Tables of the bronze, silver, gold and mart layers, kept as Parquet folders.

Every full write goes to a new numbered folder below the table, and the table's schema is put
next to the data once all of it is there. Readers take the newest folder with a schema, so a
job can rewrite the table it reads from, a job that dies half-way leaves the old table in
place, and no read has to open files to find out the columns.

Tables without a natural partition can be dealt into buckets by a hash of their key. The bucket is a
partition column readers do not see; a merge reads and rewrites only the buckets its rows fall
into. The number of buckets is fixed when a version is written and kept in its schema.

Rows that arrive as files are compared with a table by their keys alone: what is known of a file
decides whether its rows go in, stay out or are looked at one by one, so rows are not moved for it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.operators.upsert import matching, require_unique, unseen, upsert
from tradewind.session import discard, materialize

_BATCH = "ingest_batch"
_BUCKET = "key_bucket"
KEY_BUCKETS = 16
_SCHEMA = "_schema.json"
_SOURCE = "__source"
# Tables are written once and kept, so they are packed tighter than Spark's default.
_COMPRESSION = "zstd"
# About how many bytes of text one byte of a packed file holds.
_PACKED = {".gz": 4, ".bz2": 4, ".zst": 4, ".deflate": 4}


def _fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`; missing ones are NULL."""
    return df.select(
        *(
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


def _fits(df: DataFrame, existing: DataFrame) -> bool:
    """Whether the rows can be stored under the table's schema as they are.

    New columns and wider or narrower numbers need a rewrite under a common schema; any other
    change of type is an error.
    """
    stored = {f.name: f.dataType for f in existing.schema}
    fits = True
    for f in df.schema:
        if f.name not in stored:
            fits = False
        elif f.dataType != stored[f.name]:
            numbers = isinstance(f.dataType, T.NumericType) and isinstance(stored[f.name], T.NumericType)
            if not numbers and not isinstance(stored[f.name], T.NullType):
                raise TypeError(f"column {f.name} is {stored[f.name].simpleString()}, not {f.dataType.simpleString()}")
            fits = False
    return fits


def in_partitions(partitions: Sequence[Row]) -> Column:
    """Literal conditions, so that only the files of these partitions are read."""
    inside = F.lit(False)
    for row in partitions:
        here = F.lit(True)
        for name, value in row.asDict().items():
            here = here & F.col(name).eqNullSafe(F.lit(value))
        inside = inside | here
    return inside


def _agree(groups: DataFrame) -> Column:
    match = F.lit(True)
    for name in groups.columns:
        match = match & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return match


def _dealt(df: DataFrame, keys: Sequence[str], number: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(*keys), F.lit(number)).cast("int")
    return df.withColumn(_BUCKET, bucket).withMetadata(_BUCKET, {"keys": list(keys), "buckets": number})


class Lakehouse:
    def __init__(self, spark: SparkSession, root: str, key_buckets: int = KEY_BUCKETS):
        """`key_buckets`: into how many buckets tables are dealt that are written with `bucket_by`."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.key_buckets = key_buckets
        self.row_counts: dict[str, int] = {}

    # -- paths ---------------------------------------------------------------------------

    def _path(self, layer: str, table: str) -> str:
        return f"{self.root}/{layer}/{table}"

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _versions(self, layer: str, table: str) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        fs, path = self._fs(self._path(layer, table))
        if not fs.exists(path):
            return []
        numbers = []
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(self._fs(f"{path.toString()}/{name}/{_SCHEMA}")[1]):
                numbers.append(int(name[1:]))
        return sorted(numbers)

    def _version_path(self, layer: str, table: str, number: int) -> str:
        return f"{self._path(layer, table)}/v{number:08d}"

    def location(self, layer: str, table: str) -> str:
        versions = self._versions(layer, table)
        if not versions:
            raise FileNotFoundError(f"no table {layer}.{table} under {self.root}")
        return self._version_path(layer, table, versions[-1])

    # -- reads ---------------------------------------------------------------------------

    def exists(self, layer: str, table: str) -> bool:
        return bool(self._versions(layer, table))

    def read(self, layer: str, table: str) -> DataFrame:
        return self._scan(layer, table).drop(_BATCH, _BUCKET)

    def read_groups(self, layer: str, table: str, groups: DataFrame) -> DataFrame:
        """Rows that agree with a row of `groups`; NULLs are equal. Of a bucketed table only their buckets are read."""
        existing = self._scan(layer, table)
        numbers = self._buckets_of(layer, table, existing, groups)
        if numbers is not None:
            existing = existing.filter(F.col(_BUCKET).isin(numbers))
        return existing.drop(_BUCKET).alias("l").join(groups.distinct().alias("r"), _agree(groups), "left_semi")

    def _scan(self, layer: str, table: str) -> DataFrame:
        location = self.location(layer, table)
        return self.spark.read.schema(self._load_schema(location)).parquet(location)

    def _bucketing(self, layer: str, table: str) -> tuple[list[str], int] | None:
        """Key and number of a table's buckets. Spark drops a partition column's metadata, the stored schema keeps it."""
        fields = {f.name: f for f in self._load_schema(self.location(layer, table))}
        if _BUCKET not in fields:
            return None
        return fields[_BUCKET].metadata["keys"], fields[_BUCKET].metadata["buckets"]

    def _load_schema(self, location: str) -> T.StructType:
        fs, path = self._fs(f"{location}/{_SCHEMA}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return T.StructType.fromJson(json.loads(text))

    def _save_schema(self, location: str, schema: T.StructType) -> None:
        fs, path = self._fs(f"{location}/{_SCHEMA}")
        stream = fs.create(path, True)
        stream.write(schema.json().encode("utf-8"))
        stream.close()

    def read_or_empty(self, layer: str, table: str, schema: T.StructType) -> DataFrame:
        if self.exists(layer, table):
            return self.read(layer, table)
        # The limit tells the optimiser that there are no rows, so that joins with them move nothing.
        return self.spark.createDataFrame([], schema).limit(0)

    def read_since(self, layer: str, table: str, batch: int) -> DataFrame:
        """Rows of all batches after `batch`, with their batch number; others are pruned as partitions."""
        return self._scan(layer, table).filter(F.col(_BATCH) > batch).drop(_BUCKET)

    def last_batch(self, layer: str, table: str) -> int:
        """Newest batch whose rows, carried over by `read_since`, a derived table holds; 0 if none."""
        if not self.exists(layer, table):
            return 0
        return self._scan(layer, table).agg(F.coalesce(F.max(_BATCH), F.lit(0))).first()[0]

    def refresh(self, layer: str, table: str) -> None:
        """Forget cached file listings, for tables another application writes to."""
        if self.exists(layer, table):
            self.spark.catalog.refreshByPath(self.location(layer, table))

    def input_bytes(self, path: str) -> int:
        """Size of a file, folder or glob, from file metadata alone; packed text counts as about what it unpacks to."""
        fs, hadoop_path = self._fs(path)
        size = 0
        for found in fs.globStatus(hadoop_path) or []:
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                status = files.next()
                name, ending = status.getPath().getName(), ""
                if "." in name:
                    ending = name[name.rindex("."):]
                size += status.getLen() * _PACKED.get(ending, 1)
        return size

    # -- writes --------------------------------------------------------------------------

    def _write(
        self, df: DataFrame, path: str, mode: str, partition_by: Sequence[str], gather: bool = True, **options: str
    ) -> int:
        """One pass over `df`: the row count is observed while writing."""
        seen = Observation()
        if gather and partition_by and _BATCH not in partition_by:
            df = df.hint("rebalance", *partition_by)  # a few files per partition, not one per task
        # Observed last: of no rows, adaptive execution drops what stands below the exchange.
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode(mode).options(**options).partitionBy(*partition_by).parquet(path, compression=_COMPRESSION)
        return seen.get["rows"]

    def replace(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        bucket_by: Sequence[str] = (),
        gather: bool = True,
    ) -> DataFrame:
        """Write the whole table as a new version; the one before it stays for running readers.

        Rows are moved once, so that a partition gets a few files and not one per task. `gather=False` spares
        that for rows read, without a shuffle in between, from a table with the same partitions.
        """
        if bucket_by:
            df = _dealt(df, bucket_by, self.key_buckets)
            partition_by = [*partition_by, _BUCKET]
        versions = self._versions(layer, table)
        number = (versions[-1] if versions else 0) + 1
        path = self._version_path(layer, table, number)
        self.row_counts[f"{layer}.{table}"] = self._write(df, path, "overwrite", partition_by, gather)
        self._save_schema(path, df.schema)
        for old in versions[:-1]:
            fs, old_path = self._fs(self._version_path(layer, table, old))
            fs.delete(old_path, True)
        return self.read(layer, table)

    def append(self, layer: str, table: str, df: DataFrame) -> int:
        """Add rows as a batch of their own, without touching any file; returns the batch number."""
        if not self.exists(layer, table):
            self.replace(layer, table, df.withColumn(_BATCH, F.lit(1)), [_BATCH])
            return 1
        location = self.location(layer, table)
        batch = 1 + max(self._batches(location), default=0)
        df, existing = df.withColumn(_BATCH, F.lit(batch)), self._scan(layer, table)
        if _fits(df, existing):
            self.row_counts[f"{layer}.{table}"] = self._add(layer, table, df, [_BATCH])
        else:
            self.replace(layer, table, existing.unionByName(df, allowMissingColumns=True), [_BATCH])
        return batch

    def _batches(self, location: str) -> list[int]:
        fs, path = self._fs(location)
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{_BATCH}=")]

    def insert_new(
        self, layer: str, table: str, incoming: DataFrame, keys: Sequence[str], from_files: bool = False
    ) -> int:
        """Insert-only merge as a pure append; returns the batch that holds the added rows.

        A key with a NULL names no row, so such rows are new unless the table holds an equal one.
        `from_files` states that `incoming` is a plain scan of files: all keys are compared, but whole
        rows are moved only from files that hold both known and new keys, or keys with a NULL.
        """
        if self.exists(layer, table):
            existing = self.read(layer, table)
            nameless = F.lit(False)
            for key in keys:
                nameless = nameless | F.col(key).isNull()
            fresh = None
            if from_files:
                fresh, incoming = self._by_file(existing, incoming, keys, nameless)
            if incoming is not None:
                shared = [c for c in incoming.columns if c in existing.columns]
                named = unseen(existing, incoming.filter(~nameless), keys)
                incoming = named.unionByName(
                    unseen(existing.filter(nameless), incoming.filter(nameless), shared, null_safe=True)
                )
                fresh = incoming if fresh is None else fresh.unionByName(incoming)
            incoming = fresh
        return self.append(layer, table, incoming)

    def _by_file(
        self, existing: DataFrame, incoming: DataFrame, keys: Sequence[str], nameless: Column
    ) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of files without a known key, and rows of files that have to be looked at row by row.

        Rows of files whose keys are all known are in neither. None stands for no file.
        """
        source = F.xxhash64("_metadata.file_path")
        held = existing.select(*keys).distinct().withColumn("__held", F.lit(True))
        known, unnamed = F.col("known"), F.col("unnamed")
        files = (
            incoming.select(*keys, nameless.alias("__nameless"), source.alias(_SOURCE))
            .join(held, list(keys), "left")
            .groupBy(_SOURCE)
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.count("__held").alias("known"),
                F.count_if("__nameless").alias("unnamed"),
            )
            .filter((known < F.col("rows")) | (unnamed > 0))
            .select(_SOURCE, ((known == 0) & (unnamed == 0)).alias("whole"))
            .collect()  # one row per file reaches the driver
        )
        whole = [row[_SOURCE] for row in files if row["whole"]]
        mixed = [row[_SOURCE] for row in files if not row["whole"]]
        if not whole and not mixed:
            return incoming.limit(0), None
        return tuple(incoming.filter(source.isin(part)) if part else None for part in (whole, mixed))

    def merge(
        self,
        layer: str,
        table: str,
        incoming: DataFrame,
        keys: Sequence[str],
        update_cols: Sequence[str] | None = None,
        null_safe: bool = False,
        partition_by: Sequence[str] = (),
        unique: bool = False,
        bucket_by: Sequence[str] = (),
    ) -> DataFrame:
        """Upsert `incoming`, creating the table when absent (with `bucket_by`, some of `keys`, in buckets).

        `unique=True` states that `incoming` is grouped or de-duplicated by the key already, or
        that its rows replace whole groups of rows with the same key.

        If no key matches, the rows are appended. Otherwise, with `partition_by` or buckets, the
        partitions or buckets `incoming` has rows of are rewritten; without either the table is
        written as a new version. Each is a single commit.
        """
        if not unique:
            require_unique(incoming, keys)
        if not self.exists(layer, table):
            return self.replace(layer, table, incoming, partition_by, bucket_by)
        # Read several times below, and possibly computed from the table itself.
        incoming = materialize(incoming, table, _COMPRESSION)
        if not incoming.isEmpty():
            existing, written = self._scan(layer, table), None
            if _fits(incoming, existing):
                if partition_by:
                    written = self._merge_partitions(
                        layer, table, existing, incoming, keys, update_cols, null_safe, partition_by
                    )
                elif _BUCKET in existing.columns:
                    written = self._merge_buckets(layer, table, existing, incoming, keys, update_cols, null_safe)
                elif matching(existing, incoming, keys, null_safe).isEmpty():
                    written = self._add(layer, table, incoming)
            if written is None:
                bucketing = self._bucketing(layer, table)
                bucket_by = bucketing[0] if bucketing else bucket_by
                merged = upsert(existing.drop(_BUCKET), incoming, keys, update_cols, null_safe)
                self.replace(layer, table, merged, partition_by, bucket_by)
            else:
                self.row_counts[f"{layer}.{table}"] = written
        discard(incoming)
        return self.read(layer, table)

    def _merge_buckets(self, layer, table, existing, incoming, keys, update_cols, null_safe) -> int:
        """Rewrite the buckets `incoming` has rows of, or append where no key matches; how many rows were written."""
        dealt = _dealt(incoming, *self._bucketing(layer, table))
        # At most one number per bucket reaches the driver; as literals they prune the scans.
        numbers = [row[0] for row in dealt.select(_BUCKET).distinct().collect()]
        inside = existing.filter(F.col(_BUCKET).isin(numbers))
        if matching(inside, dealt, keys, null_safe).isEmpty():
            return self._add(layer, table, dealt, [_BUCKET])
        return self._swap(layer, table, upsert(inside, dealt, keys, update_cols, null_safe), [_BUCKET])

    def _buckets_of(self, layer: str, table: str, existing: DataFrame, groups: DataFrame) -> list[int] | None:
        """Numbers of the buckets that can hold rows of `groups`; None if groups do not name whole keys."""
        bucketing = self._bucketing(layer, table)
        if bucketing is None or not set(bucketing[0]) <= set(groups.columns):
            return None
        # Hashes depend on the type.
        typed = groups.select(*(F.col(k).cast(existing.schema[k].dataType).alias(k) for k in bucketing[0]))
        return [row[0] for row in _dealt(typed, *bucketing).select(_BUCKET).distinct().collect()]

    def _add(self, layer: str, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """Add rows without touching any file; how many they are."""
        location = self.location(layer, table)
        written = self._write(_fit(df, self._load_schema(location)), location, "append", partition_by)
        self.spark.catalog.refreshByPath(location)
        return written

    def _merge_partitions(
        self, layer, table, existing, incoming, keys, update_cols, null_safe, partition_by
    ) -> int | None:
        """Rewrite the partitions of `incoming` in one commit, or append where no key matches.

        How many rows were written; None, with nothing written, when a matched row would change
        partition.
        """
        held = list(dict.fromkeys([*keys, *partition_by]))
        old, new = existing.select(*held).alias("old"), incoming.select(*held).distinct().alias("new")
        match = F.lit(True)
        for key in keys:
            pair = F.col(f"old.{key}"), F.col(f"new.{key}")
            match = match & (pair[0].eqNullSafe(pair[1]) if null_safe else pair[0] == pair[1])
        moved = F.lit(False)
        for name in partition_by:
            moved = moved | ~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
        matched, any_moved = old.join(new, match).agg(F.count(F.lit(1)), F.bool_or(moved)).first()
        if any_moved:
            return None
        if not matched:
            return self._add(layer, table, incoming, partition_by)
        # One row per partition reaches the driver.
        inside = in_partitions(incoming.select(*partition_by).distinct().collect())
        return self._swap(layer, table, upsert(existing.filter(inside), incoming, keys, update_cols, null_safe), partition_by)

    def _swap(self, layer: str, table: str, df: DataFrame, partition_by: Sequence[str]) -> int:
        """Put `df` in place of the partitions it has rows of, in one commit."""
        location = self.location(layer, table)
        fitted = _fit(df, self._load_schema(location))
        written = self._write(fitted, location, "overwrite", partition_by, partitionOverwriteMode="dynamic")
        self.spark.catalog.refreshByPath(location)
        return written

    def replace_groups(
        self, layer: str, table: str, groups: DataFrame, fresh: DataFrame, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """Put `fresh` in place of the rows that agree with a row of `groups`; NULLs are equal.

        With `partition_by`, or in buckets of columns that `groups` has, only partitions or buckets
        with such rows, old or fresh, are rewritten, in one commit; a partition left without
        rows makes the table be written as a new version.
        """
        existing, bucketing = self._scan(layer, table), self._bucketing(layer, table)
        fresh = materialize(_dealt(fresh, *bucketing) if bucketing else fresh, table, _COMPRESSION)
        groups, match = materialize(groups.distinct(), "groups", _COMPRESSION), _agree(groups)

        def kept(rows: DataFrame, how: str) -> DataFrame:
            return rows.alias("l").join(groups.alias("r"), match, how)

        def written() -> int | None:
            if not _fits(fresh, existing):
                return None
            columns, inside = list(partition_by), existing
            numbers = self._buckets_of(layer, table, existing, groups)
            if not columns and numbers is not None:
                columns, inside = [_BUCKET], existing.filter(F.col(_BUCKET).isin(numbers))
            if not columns:
                return None
            # One row per partition reaches the driver.
            gone = kept(inside, "left_semi").select(*columns)
            partitions = gone.unionByName(fresh.select(*columns)).distinct().collect()
            if not partitions:
                return 0
            inside = existing.filter(in_partitions(partitions))
            rows = kept(inside, "left_anti").unionByName(fresh, allowMissingColumns=True)
            if rows.select(*columns).distinct().count() < len(partitions):
                return None
            return self._swap(layer, table, rows, columns)

        count = written()
        if count is None:
            rows = kept(existing, "left_anti").unionByName(fresh, allowMissingColumns=True).drop(_BUCKET)
            self.replace(layer, table, rows, partition_by, bucketing[0] if bucketing else ())
        elif count:
            self.row_counts[f"{layer}.{table}"] = count
        discard(fresh, groups)
        return self.read(layer, table)
