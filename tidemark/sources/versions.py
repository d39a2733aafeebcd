"""Tables with versions: upserts add delta files, reads merge them, compaction folds them.

Layout under a table's root: ``_log/<version>.json``, one file per commit with the whole list of live
files, and ``data/commit=<id>/bucket=<n>/*.parquet``. A version is the state after a commit; a
read opens one log file. Nothing that a kept version lists is changed or moved, so readers go on
while others write. Rows are dealt to buckets by a hash of the first key column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ranks import best_rows
from tidemark.schemas import TABLES, empty, schema_of
from tidemark.sources.store import PanelStore, latest_rows, scan

GONE, COMMIT, BUCKET, SEQUENCE = "_gone", "commit", "bucket", "_sequence"


class Conflict(RuntimeError):
    """Another writer has committed what this commit builds on."""


class VersionedTable:
    """One table, keyed by ``key`` (an empty key: rows are only ever added).

    ``buckets`` counts for a new table only. A later commit wins per key; inside a delivery ``order`` decides.
    Writers need no lock: a commit is a rename that fails where its version already exists, and is then tried on top of the newer one. The file
    system's rename must refuse an existing target, as HDFS does.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = 16) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), list(key), buckets

    # -- the log ------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _files(self):
        path = self._path()
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        log = self._path("_log")
        if not self._files.exists(log):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def latest(self) -> int:
        """The newest version; 0 is the table before its first commit."""
        return (self.versions() or [0])[-1]

    def _state(self, version: int) -> dict:
        """schema, bucket count, tokens of deliveries, and for each bucket its (commit, sequence), oldest first."""
        if version == 0:
            return {"schema": None, "buckets": self.buckets, "key": self.key, "live": {}, "tokens": {}}
        lines = self.spark.read.text(self._path("_log", f"{version:020d}.json").toString(), wholetext=True).collect()
        return json.loads(lines[0].value)

    def _publish(self, version: int, state: dict) -> bool:
        """Write a log file unless that version exists; whether this writer was the one."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        staged = self._path("_log", f".{uuid.uuid4().hex}.tmp")
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._path("_log", f"{version:020d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwrite
        try:
            context.rename(staged, target, none)
            return True
        except Exception as error:
            self._files.delete(staged, False)
            if self._files.exists(target):
                return False
            raise error

    # -- writing ------------------------------------------------------------

    def upsert(self, df: DataFrame, order: Column | None = None, token: str | None = None, expect: int | None = None) -> int:
        """Add a delivery; only its own rows are written. Returns the version after it.

        ``token`` names the delivery: one that was committed before is not committed again, and the version of then is returned.
        With ``expect`` the commit raises ``Conflict`` if a version after that one has touched any bucket it touches.
        """
        rows = latest_rows([df], self.key, order) if self.key else df
        return self._deliver(rows.withColumn(GONE, F.lit(False)), df.schema, token, expect)

    def delete(self, keys: DataFrame, token: str | None = None, expect: int | None = None) -> int:
        """Remove the rows with the given keys: they are written as marks that reads leave out."""
        schema = self.schema()
        if schema is None or not self.key:
            raise ValueError("only rows of a keyed table that has rows can be removed")
        own = keys.select(*self.key).distinct()
        marks = own.select(*[(F.col(f.name) if f.name in self.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        return self._deliver(marks.withColumn(GONE, F.lit(True)), schema, token, expect)

    def _deliver(self, rows: DataFrame, schema: T.StructType, token: str | None, expect: int | None) -> int:
        base = self._state(self.latest())
        if token is not None and token in base["tokens"]:
            return base["tokens"][token]
        if base["schema"] is not None:
            stored = T.StructType.fromJson(base["schema"])
            if {(f.name, f.dataType) for f in stored.fields} != {(f.name, f.dataType) for f in schema.fields}:
                raise ValueError(f"columns {schema.simpleString()} are not those of the table, {stored.simpleString()}")
        commit, touched = self._write(rows, base["buckets"])
        while True:
            version = self.latest()
            state = self._state(version)
            if token is not None and token in state["tokens"]:  # the same delivery came in by another writer
                self._drop(commit)
                return state["tokens"][token]
            if state["buckets"] != base["buckets"]:
                self._drop(commit)
                raise Conflict("the table was created by another writer with other buckets")
            if expect is not None and any(s > expect for b in touched for _, s in state["live"].get(b, [])):
                self._drop(commit)
                raise Conflict(f"rows in the same buckets were committed after version {expect}")
            for b in touched:
                state["live"].setdefault(b, []).append([commit, version + 1])
            state["schema"] = state["schema"] or schema.jsonValue()
            state["key"] = self.key
            if token is not None:
                state["tokens"][token] = version + 1
            if self._publish(version + 1, state):
                return version + 1

    def _bucket_of(self, buckets: int) -> Column:
        """By the first key column; without a key a delivery has one bucket, in as many files as its size asks for."""
        return F.pmod(F.xxhash64(*(self.key[:1] or [F.lit(uuid.uuid4().hex)])), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, list[str]]:
        """Write files of a new commit: its id and the buckets it has."""
        commit = uuid.uuid4().hex
        folder = self._path("data", f"{COMMIT}={commit}")
        placed = rows.withColumn(BUCKET, self._bucket_of(buckets)).hint("rebalance", F.col(BUCKET))
        if self.key:
            placed = placed.sortWithinPartitions(BUCKET, *self.key)
        placed.write.option("compression", "zstd").partitionBy(BUCKET).parquet(folder.toString())
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return commit, sorted((n.split("=")[1] for n in names if n.startswith(f"{BUCKET}=")), key=int)

    def _drop(self, commit: str) -> None:
        self._files.delete(self._path("data", f"{COMMIT}={commit}"), True)

    # -- reading ------------------------------------------------------------

    def schema(self, version: int | None = None) -> T.StructType | None:
        held = self._state(self.latest() if version is None else version)["schema"]
        return None if held is None else T.StructType.fromJson(held)

    def read(self, version: int | None = None, symbols: list | None = None) -> DataFrame | None:
        """The rows as of a version (default: the newest); None before the first commit. ``symbols`` (of the first key column) prune buckets.

        Buckets with one delta are read as they are; in the others the newest commit of each key counts.
        """
        state = self._state(self._known(version))
        if state["schema"] is None:
            return None
        buckets = sorted(state["live"])
        if symbols is not None and self.key:
            kind = next(f.dataType for f in T.StructType.fromJson(state["schema"]).fields if f.name == self.key[0])
            wanted = self.spark.createDataFrame([(s,) for s in symbols], T.StructType([T.StructField(self.key[0], kind)]))
            own = {str(r.b) for r in wanted.select(self._bucket_of(state["buckets"]).alias("b")).distinct().collect()}
            buckets = [b for b in buckets if b in own]
        rows = self._merged(state, buckets)
        return rows if symbols is None or not self.key else rows.where(F.col(self.key[0]).isin(list(symbols)))

    def _known(self, version: int | None) -> int:
        if version is None:
            return self.latest()
        if version not in self.versions():
            raise ValueError(f"version {version} of {self.root} is not there")
        return version

    def _merged(self, state: dict, buckets: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        plain = [(b, *state["live"][b][0]) for b in buckets if len(state["live"][b]) == 1 or not self.key]
        if not self.key:
            plain = [(b, c, s) for b in buckets for c, s in state["live"][b]]
        several = [(b, c, s) for b in buckets if len(state["live"][b]) > 1 and self.key for c, s in state["live"][b]]
        out = self._scan(schema, plain).where(f"not {GONE}").select(*schema.fieldNames())
        if several:
            out = out.union(best_rows(self._scan(schema, several), self.key, [F.col(SEQUENCE).desc()], 1, "_first").where(
                f"not {GONE}").select(*schema.fieldNames()))
        return out

    def _scan(self, schema: T.StructType, files: list[tuple[str, str, int]]) -> DataFrame:
        """The rows of (bucket, commit, sequence) folders with their sequence."""
        full = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField(COMMIT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        if not files:
            return self.spark.createDataFrame([], T.StructType([*full.fields, T.StructField(SEQUENCE, T.LongType())]))
        paths = [self._path("data", f"{COMMIT}={c}", f"{BUCKET}={b}").toString() for b, c, _ in files]
        rows = self.spark.read.schema(full).option("basePath", self._path("data").toString()).parquet(*paths)
        # a folded bucket takes the place of what it holds, so a commit's sequence can differ from bucket to bucket
        sequences = self.spark.createDataFrame([(c, int(b), s) for b, c, s in files], f"{COMMIT} string, {BUCKET} int, {SEQUENCE} long")
        return rows.join(F.broadcast(sequences), [COMMIT, BUCKET])  # a row per live folder

    # -- upkeep -------------------------------------------------------------

    def compact(self, least: int = 2) -> int:
        """Fold each bucket with ``least`` or more deltas into one; other buckets keep their files.

        Deltas committed meanwhile stay on top. Raises ``Conflict`` if another job has folded the same buckets.
        """
        version = self.latest()
        state = self._state(version)
        chosen = {b: live for b, live in state["live"].items() if self.key and len(live) >= max(least, 2)}
        if not chosen:
            return version
        commit, written = self._write(self._merged(state, sorted(chosen)).withColumn(GONE, F.lit(False)), state["buckets"])
        while True:
            version = self.latest()
            state = self._state(version)
            for b, live in chosen.items():
                if state["live"].get(b, [])[:len(live)] != live:
                    self._drop(commit)
                    raise Conflict(f"bucket {b} was folded by another job")
                folded = [[commit, live[-1][1]]] if b in written else []  # all rows of a bucket may have gone
                state["live"][b] = folded + state["live"][b][len(live):]
                if not state["live"][b]:
                    del state["live"][b]
            if self._publish(version + 1, state):
                return version + 1

    def vacuum(self, keep: int) -> None:
        """Remove the versions before the last ``keep`` and the commits that only they list (or that were never published).

        Not while a writer runs: what it has written but not published looks the same as what a lost one left.
        """
        versions = self.versions()
        kept = versions[-max(keep, 1):]
        live = {c for v in kept for entries in self._state(v)["live"].values() for c, _ in entries}
        for v in versions[:-max(keep, 1)]:
            self._files.delete(self._path("_log", f"{v:020d}.json"), False)
        data = self._path("data")
        if self._files.exists(data):
            for status in self._files.listStatus(data):
                name = status.getPath().getName()
                if name.startswith(f"{COMMIT}=") and name.split("=")[1] not in live:
                    self._files.delete(status.getPath(), True)


class VersionedStore(PanelStore):
    """A :class:`PanelStore` whose tables are versioned: a late row costs a delta file, not a year."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        super().__init__(spark, root)
        self.buckets = buckets

    def table(self, name: str, key: list[str] | None = None) -> VersionedTable:
        return self._table(["versioned", name], key or ["symbol", "date"])

    def _table(self, parts: list[str], key: list[str]) -> VersionedTable:
        return VersionedTable(self.spark, self._path(*parts), key, self.buckets)

    def write(self, table: str, df: DataFrame, order: Column | None = None, token: str | None = None) -> None:
        if "date" not in df.columns:
            raise ValueError(f"{table} has no date column")
        if not df.isEmpty():
            self.table(table).upsert(df, order, token)

    def write_reference(self, table: str, df: DataFrame, key: list[str], order: Column | None = None) -> None:
        if not df.isEmpty():
            self.table(table, key).upsert(df, order)

    def write_raw(self, provider: str, dataset: str, df: DataFrame) -> str:
        """Raw rows with a date are keyed by (symbol, date), others are only added."""
        raw = self._table(["raw", provider, dataset], ["symbol", "date"] if "date" in df.columns else [])
        raw.upsert(df)
        return raw.root

    def read_raw(self, provider: str, dataset: str) -> DataFrame | None:
        raw = self._table(["raw", provider, dataset], [])
        raw.key = raw._state(raw.latest())["key"] if raw.latest() else []
        return raw.read()

    def read(self, table: str, symbols=None, start=None, end=None, version: int | None = None) -> DataFrame:
        held = self.table(table)
        if held.latest():
            held.key = held._state(held.latest())["key"]
        rows = held.read(version, list(symbols)) if isinstance(symbols, (list, tuple)) and symbols else held.read(version)
        if rows is None:
            return empty(self.spark, table) if table in TABLES else self.spark.createDataFrame([], "symbol string")
        if table in TABLES:
            rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                 for f in schema_of(table).fields])
        return scan(rows, symbols, start, end)
