"""Versioned tables with an atomic publish, on any file system that Spark reaches.

Each table is a set of immutable parts. A publish writes new parts and then one manifest that names the current parts
of all tables; readers see all of a publish or nothing, and a batch id that a manifest
names already is not published twice. Manifests are numbered. Whoever creates the claim file of a number may write it, and a claim
older than PATIENCE_S is given up; on object stores without atomic creation let one process write (the queue below orders the threads of a process).

Layout: tables with a key are split into buckets by a hash of it, and the log into days as well, as partition folders; so a
reader that names vehicles or a time opens only their folders. A replacement may name buckets: the parts written for
them take the place of these buckets in older parts, and the rest of the table stays as it is, so a batch rewrites what it has touched.
The number of buckets may grow by multiples, as the fleet does (streaming.pipeline.grow); parts written before stay as they are.
A part of a table with days has fewer buckets where it is small, so its files don't shrink as the fleet grows: each bucket of it has as many folders as there are days.
Appended parts are merged in levels: MERGE parts of one level become one of the next, so a row is
rewritten a logarithmic number of times and a table has few parts. Parts that none of the last KEEP manifests names are removed.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import at
from .schemas import BUCKETED_BY, DATED_BY, SCHEMA_VERSION, TABLES

BUCKETS = 16
MERGE, KEEP = 8, 8
#: Bytes of a bucket, over all its days, below which a part of a table with days has fewer buckets (but BUCKETS at least, if the store has as many).
BUCKET_BYTES = 4 << 20
#: How long a writer waits for another one, and how old a claim of a number must be to count as given up.
PATIENCE_S = 60.0

_QUEUES: dict[str, threading.RLock] = {}
_QUEUES_LOCK = threading.Lock()


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Conflict(RuntimeError):
    """Another writer has published first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._listeners: list[Callable[[int, set[str]], None]] = []
        self._frames: tuple[int, dict[tuple, DataFrame]] = (-1, {})
        with _QUEUES_LOCK:
            self._queue = _QUEUES.setdefault(self.root, threading.RLock())
        with self._queue:
            if not self._manifests():
                self._write_manifest(0, {"schema_version": SCHEMA_VERSION, "buckets": buckets, "tables": {t: [] for t in TABLES}, "batches": {}})
                self.publish(replace={"meta": spark.createDataFrame([("schema_version", SCHEMA_VERSION)], TABLES["meta"])})
            elif self.manifest()["schema_version"] != SCHEMA_VERSION:
                raise ValueError(f"{root} has schema version {self.manifest()['schema_version']}, this is {SCHEMA_VERSION}")
        self.buckets = self.manifest()["buckets"]

    def in_session(self, spark: SparkSession) -> Store:
        """The same store, read by another session of the application; its publishes are told to the same listeners."""
        other = Store(spark, self.root, self.buckets)
        other._listeners = self._listeners
        return other

    # manifests
    def _manifests(self) -> list[int]:
        where = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _write_manifest(self, number: int, manifest: dict) -> None:
        final = self._path(f"{self.root}/_manifest/{number:012d}.json")
        claim = self._path(f"{self.root}/_manifest/.claim-{number:012d}")
        try:
            self._fs.create(claim, False).close()  # fails if it exists
        except Exception as e:
            if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > PATIENCE_S:
                self._fs.delete(claim, False)  # its writer is gone; a manifest is written in far less time, and never over another one
            raise Conflict(f"another writer is publishing {number}") from e
        try:
            if self._fs.exists(final):
                raise Conflict(f"another writer has published {number}")
            draft = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
            out = self._fs.create(draft)
            out.write(bytearray(json.dumps(manifest).encode()))
            out.close()
            if not self._fs.rename(draft, final):
                self._fs.delete(draft, False)
                raise Conflict(f"another writer has published {number}")
        finally:
            self._fs.delete(claim, False)

    def _read_manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{number:012d}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) | {"number": number}

    def manifest(self) -> dict:
        newest = self._read_manifest(self._manifests()[-1])
        self.buckets = newest["buckets"]
        return newest

    def forgotten(self, table: str, manifest: dict | None = None) -> datetime | None:
        """The moment before which rows of a table with days are gone, or None."""
        first = (manifest or self.manifest()).get("forgotten", {}).get(table)
        return datetime.fromisoformat(first) if first else None

    # reading
    def read(self, table: str, **narrow) -> DataFrame:
        return self.snapshot([table], **narrow)[table]

    def snapshot(self, tables: list[str] | None = None, buckets: Iterable[int] | None = None, since: datetime | None = None, until: datetime | None = None, days: list[date] | None = None) -> dict[str, DataFrame]:
        """Tables as of one manifest. buckets, since, until, days: only these buckets, and of tables with days only rows from since and before until, or of these days; other folders are not opened."""
        manifest = self.manifest()
        if self._frames[0] != manifest["number"]:
            self._frames = (manifest["number"], {})
        held = self._frames[1]  # folders of a part never change, so they are listed once a manifest
        some = None if buckets is None else frozenset(buckets)
        out = {}
        for t in tables or TABLES:
            key = (t, some, since, until, None if days is None else tuple(days))
            if key not in held:
                held[key] = self._frame(t, manifest["tables"][t], some, since, until, days)
            out[t] = held[key]
        return out

    def _frame(self, table: str, parts: list[dict], buckets: set[int] | None = None, since: datetime | None = None, until: datetime | None = None, days: list[date] | None = None) -> DataFrame:
        schema = TABLES[table]
        if table not in BUCKETED_BY:
            paths = [f"{self.root}/{table}/{p['path']}" for p in parts]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        out = None
        for first, of in sorted({(p.get("from", ""), p["of"]) for p in parts}):
            paths, wanted = [], None if buckets is None else {b % of for b in buckets}  # a bucket of fewer holds several of more
            for p in parts:
                if (p.get("from", ""), p["of"]) == (first, of):
                    some = [b for b in p["buckets"] if wanted is None or b in wanted]
                    whole = f"{self.root}/{table}/{p['path']}"
                    paths += [whole] if len(some) == p["written"] else [f"{whole}/bucket={b}" for b in some]
            if not paths:
                continue
            folders = "part string, bucket int" + (", day date" if table in DATED_BY else "")
            rows = self.spark.read.schema(f"{schema.simpleString()[7:-1].replace(':', ' ')}, {folders}").option("basePath", f"{self.root}/{table}").parquet(*paths)
            if wanted is not None and of != self.buckets and len({*buckets}) < self.buckets:
                rows = rows.filter(bucket_of(F.col(BUCKETED_BY[table]), self.buckets).isin(sorted(buckets)))
            if table in DATED_BY:
                for limit in (datetime.fromisoformat(first) if first else None, since):
                    if limit is not None:
                        rows = rows.filter((F.col("day") >= F.lit(limit.date())) & (F.col(DATED_BY[table]) >= at(limit)))
                if until is not None:
                    rows = rows.filter((F.col("day") <= F.lit(until.date())) & (F.col(DATED_BY[table]) < at(until)))
                if days is not None:
                    rows = rows.filter(F.col("day").isin(days))
            rows = rows.select(*schema.names)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def buckets_of(self, rows: DataFrame, key: str = "vehicle_id") -> list[int]:
        """The buckets of some keys; as many rows as there are buckets at most."""
        return sorted(r["b"] for r in rows.select(bucket_of(F.col(key), self.buckets).alias("b")).distinct().collect())

    def widened(self, table: str, buckets: Iterable[int]) -> list[int]:
        """Some buckets with those that share a folder with them in a part of fewer buckets; only together can they be replaced."""
        least = min((p["of"] for p in self.manifest()["tables"][table]), default=self.buckets)
        some = {b % least for b in buckets}
        return [b for b in range(self.buckets) if b % least in some]

    # frames that a publish is made of
    def work(self, df: DataFrame) -> tuple[str, DataFrame]:
        """Write df beside the tables, and read it again; (path, frame)."""
        path = f"{self.root}/_work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def drop_work(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # writing
    def _write(self, table: str, df: DataFrame, number: int, level: int = 0) -> dict:
        path = f"part={number}-{uuid.uuid4().hex[:8]}"
        rows = df.select(*[df[f.name].cast(f.dataType) for f in TABLES[table]])
        if table not in BUCKETED_BY:
            rows.write.parquet(f"{self.root}/{table}/{path}")
            return {"path": path, "level": level}
        folders, of = ["bucket"], self._split(rows) if table in DATED_BY else self.buckets
        rows = rows.withColumn("bucket", bucket_of(F.col(BUCKETED_BY[table]), of))
        if table in DATED_BY:
            rows, folders = rows.withColumn("day", F.to_date(DATED_BY[table])), ["bucket", "day"]
        rows.hint("rebalance", *folders).write.partitionBy(*folders).parquet(f"{self.root}/{table}/{path}")  # one file a folder, more where one is large
        made = self._folders(table, path)
        return {"path": path, "level": level, "of": of, "buckets": made, "written": len(made)}

    def _split(self, rows: DataFrame) -> int:
        """Into how many buckets a part of a table with days is split: a divisor of the store's number, by the size that Spark expects (for frames that are read from files, theirs)."""
        size, of = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), self.buckets
        while of % 2 == 0 and of > BUCKETS and size < of * BUCKET_BYTES:
            of //= 2
        return of

    def _folders(self, table: str, path: str) -> list[int]:
        return sorted(int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._path(f"{self.root}/{table}/{path}")) if s.getPath().getName().startswith("bucket="))

    def publish(
        self,
        replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None,
        batch: tuple[str, int] | None = None,
        within: dict[str, Iterable[int]] | None = None,
        based_on: int | None = None,
        forget: dict[str, datetime] | None = None,
        buckets: int | None = None,
    ) -> bool:
        """Write tables whole or as further parts, then switch. False if batch (name, id) is published already.

        within: for a replaced table, the buckets that the frame stands for (of a table with days, from widened); all others stay as they are.
        based_on: the manifest from which the frames were made; if another was published since, nothing is, and Conflict is raised.
        buckets: split tables into so many buckets from now on, a multiple of what they are; tables that are replaced bucket by bucket must be replaced whole with it.
        forget: for tables with days, the moment before which rows are gone. Only the manifest changes; days that no kept manifest shows are removed later.
        """
        with self._queue:
            manifest = self.manifest()
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return False
            if based_on is not None and manifest["number"] != based_on:
                raise Conflict(f"made from {based_on}, but {manifest['number']} is current")
            number = manifest["number"] + 1
            self.buckets = buckets or manifest["buckets"]
            tables = {t: [dict(p) for p in parts] for t, parts in manifest["tables"].items()}
            frames = {("replace", t): df for t, df in (replace or {}).items()} | {("append", t): df for t, df in (append or {}).items()}
            with ThreadPoolExecutor(max(1, len(frames))) as pool:  # the jobs share the cluster
                written = dict(zip(frames, pool.map(lambda x: self._write(x[0][1], x[1], number), frames.items()), strict=True))
            for name in replace or {}:
                made = written["replace", name]
                held = set(range(self.buckets)) if within is None or name not in within else set(within[name])
                old = []
                if name in BUCKETED_BY:
                    old = [p | {"buckets": [b for b in p["buckets"] if b not in {h % p["of"] for h in held}]} for p in tables[name]]
                tables[name] = [p for p in [*old, made] if p.get("buckets", True)]
            for name in append or {}:
                made = written["append", name]
                tables[name] += [made] if made.get("buckets", True) else []
            for name, first in (forget or {}).items():
                for p in tables[name]:
                    p["from"] = max(p.get("from", ""), first.isoformat())
            for name in {*(append or {})}:
                tables[name] = self._merged(name, tables[name], number)
            forgotten = manifest.get("forgotten", {})
            forgotten |= {t: max(forgotten.get(t, ""), first.isoformat()) for t, first in (forget or {}).items()}
            batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
            self._write_manifest(number, {"schema_version": SCHEMA_VERSION, "buckets": self.buckets, "tables": tables, "batches": batches, "forgotten": forgotten})
            if number % KEEP == 0:
                self.vacuum(KEEP)
        for listener in list(self._listeners):
            listener(number, {*(replace or {}), *(append or {}), *(forget or {})})
        return True

    def transact(self, build: Callable[[dict[str, DataFrame]], dict], tables: list[str] | None = None) -> None:
        """Publish what build makes of a snapshot (arguments of publish); again from a new snapshot if another writer was first."""
        until = time.monotonic() + PATIENCE_S
        while True:
            with self._queue:
                based_on = self.manifest()["number"]
                try:
                    self.publish(**build(self.snapshot(tables)), based_on=based_on)
                    return
                except Conflict:
                    if time.monotonic() > until:
                        raise
            time.sleep(0.2)

    def _merged(self, table: str, parts: list[dict], number: int) -> list[dict]:
        level = 0
        while level <= max((p["level"] for p in parts), default=-1):
            same = [p for p in parts if p["level"] == level]
            if len(same) >= MERGE:
                made = self._write(table, self._frame(table, same), number, level + 1)
                parts = [p for p in parts if p["level"] != level] + [made]
            level += 1
        return parts

    def subscribe(self, listener: Callable[[int, set[str]], None]) -> Callable[[], None]:
        """Call listener(number, tables) after every publish of this store; returns how to stop it."""
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener)

    def vacuum(self, keep: int = 1) -> None:
        """Remove parts that none of the last `keep` manifests names, and older manifests."""
        with self._queue:
            numbers = self._manifests()
            kept = [self._read_manifest(n) for n in numbers[-keep:]]
            for t in TABLES:
                live = {p["path"] for m in kept for p in m["tables"][t]}
                newest = max(m["number"] for m in kept)
                folder = self._path(f"{self.root}/{t}")
                if self._fs.exists(folder):
                    for s in self._fs.listStatus(folder):
                        name = s.getPath().getName()
                        if name not in live and int(name[5:].split("-")[0]) <= newest:  # not what a publish is writing
                            self._fs.delete(s.getPath(), True)
                for path in live if t in DATED_BY else ():
                    firsts = [p.get("from", "") for m in kept for p in m["tables"][t] if p["path"] == path]
                    for b in self._folders(t, path) if min(firsts) else ():
                        folder = f"{self.root}/{t}/{path}/bucket={b}"
                        for s in self._fs.listStatus(self._path(folder)):
                            if "" < s.getPath().getName().removeprefix("day=") < min(firsts)[:10]:
                                self._fs.delete(s.getPath(), True)
            for n in numbers[:-keep]:
                self._fs.delete(self._path(f"{self.root}/_manifest/{n:012d}.json"), False)

    def destroy(self) -> None:
        self._fs.delete(self._path(self.root), True)

