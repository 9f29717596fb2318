"""Keyed tables that are written by change: base partitions, a log of deltas, and a commit per version."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens.session import remove, rename_if_free


class Commits:
    """Small JSON records by number below one folder, each put only if its number is free.

    A record is written aside and renamed without overwriting, so it is there whole or not at all; two writers of one
    number are told apart as far as the file system's rename does. No Spark job runs.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def all(self) -> list[tuple[int, dict]]:
        """Every record with its number, in order."""
        folder = self._hadoop.Path(self.path)
        files = folder.getFileSystem(self._conf)
        if not files.exists(folder):
            return []
        numbers = []
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                numbers.append(int(name[:-5]))
        found = []
        for number in sorted(numbers):
            stream = files.open(self._at(f"{number}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append((number, json.loads(text)))
        return found

    def put(self, number: int, record: dict) -> bool:
        """Whether the record is now the one of its number; False if another was there before."""
        name = f".{uuid.uuid4().hex}"
        aside = self._at(name)
        files = aside.getFileSystem(self._conf)
        stream = files.create(aside, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        if rename_if_free(self.spark, f"{self.path}/{name}", f"{self.path}/{number}.json"):
            return True
        files.delete(aside, False)
        return False

    def drop(self, number: int) -> None:
        remove(self.spark, f"{self.path}/{number}.json")


class KeyedLog:
    """One row per key, kept as base partitions and the changes since.

    A batch writes its changed rows as one delta, whatever the size of the table; its commit names the live base
    folder of every key-hash partition and the live deltas. Reading takes the newest row of a key, or with ``sums``
    adds these columns up. When there are more than ``most_deltas``, they are folded: into one delta while they are
    small against the base, else into new base folders of the partitions they touch; all other partitions keep their
    files. Over time a changed row is so written a few times, and an unchanged one next to never.

    There is one writer. It reads the commits when it starts and then holds the newest itself. A version belongs to a
    run and batch: a batch that is committed is not written again. Commits beyond the newest ``KEEP`` go when older
    than ``retain_seconds``, with the files that only they name; readers keep the version they began with till then.
    """

    KEEP = 3

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: list[str],
        sums: list[str] | None = None,
        parts: int = 16,
        most_deltas: int = 8,
        retain_seconds: float = 86_400.0,
    ) -> None:
        self.spark, self.path, self.schema, self.keys, self.sums = spark, path.rstrip("/"), schema, keys, sums
        self.parts, self.most_deltas, self.retain_seconds = parts, most_deltas, retain_seconds
        self._commits = Commits(spark, f"{self.path}/commits")
        self._known: list[tuple[int, dict]] = []
        self.refresh()

    def refresh(self) -> None:
        """Read the commits again, for a reader beside the writer."""
        self._known = self._commits.all()

    @property
    def head(self) -> dict | None:
        return self._known[-1][1] if self._known else None

    def versions(self) -> list[int]:
        """Versions whose commits are there, oldest first."""
        return [v for v, _ in self._known]

    def next_version(self) -> int:
        return self._known[-1][0] + 1 if self._known else 0

    def committed(self, run: str, batch: int) -> bool:
        return any((r["run"], r["batch"]) == (run, batch) for _, r in self._known)

    def part(self) -> Column:
        """Partition of a row by the hash of its keys (nulls included)."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def delta_path(self, version: int, run: str) -> str:
        return f"{self.path}/delta/{version}-{run}"

    def _wide(self, *more: str) -> T.StructType:
        return T.StructType([*self.schema.fields, *[T.StructField(n, T.IntegerType()) for n in more]])

    def _deltas(self, deltas: list[dict]) -> DataFrame:
        return self.spark.read.schema(self._wide("_v")).parquet(*[d["path"] for d in deltas])

    def _base(self, base: dict[str, str], parts: list[int] | None) -> DataFrame | None:
        live: dict[str, list[int]] = {}
        for part, path in base.items():
            if parts is None or int(part) in parts:
                live.setdefault(path, []).append(int(part))
        rows = None
        for path, found in live.items():
            own = self.spark.read.schema(self._wide("part")).parquet(path).filter(F.col("part").isin(found))
            own = own.select(*self.schema.fieldNames(), F.lit(-1).alias("_v"))
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def _merged(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.schema.fieldNames() if c not in self.keys]
        if self.sums is not None:
            found = rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])
        else:
            newest = F.max_by(F.struct(*others), "_v").alias("_row")
            found = rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*")
        return found.select(*self.schema.fieldNames())

    def _at(self, record: dict, parts: list[int] | None) -> DataFrame:
        rows = self._base(record["base"], parts)
        if record["deltas"]:
            deltas = self._deltas(record["deltas"])
            if parts is not None:
                deltas = deltas.filter(self.part().isin(parts))
            rows = deltas if rows is None else rows.unionByName(deltas)
        elif rows is not None:
            return rows.drop("_v")  # a key is there once
        else:
            rows = self.spark.createDataFrame([], self._wide("_v"))
        return self._merged(rows)

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The rows of the newest version, of all partitions or of some; None before any commit."""
        return None if self.head is None else self._at(self.head, parts)

    def load(self, rows: DataFrame, run: str, batch: int = 0, facts: dict | None = None) -> int:
        """Commit a whole table, with one row per key, as the base."""
        version = self.next_version()
        base, counts = self._write_base(rows, version, run)
        return self._commit(version, run, batch, base, counts, [], facts)

    def write(self, rows: DataFrame, run: str, batch: int, facts: dict | None = None) -> int:
        """Write changed rows (a key once) as the next version, unless this batch of this run is there already."""
        if self.committed(run, batch):
            return next(v for v, r in self._known if (r["run"], r["batch"]) == (run, batch))
        version, seen = self.next_version(), Observation()
        path = self.delta_path(version, run)
        changed = rows.select(*self.schema.fieldNames(), F.lit(version).alias("_v"))
        changed.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(path)
        return self.commit(version, run, batch, path, seen.get["rows"], facts)

    def commit(self, version: int, run: str, batch: int, path: str, rows: int, facts: dict | None = None) -> int:
        """Commit changed rows that lie at ``path`` with the columns of the table and ``_v``, the version."""
        old = self.head or {"base": {}, "counts": {}, "deltas": []}
        base, counts, deltas = old["base"], old["counts"], [*old["deltas"]]
        if rows:
            deltas.append({"path": path, "rows": rows})
        if len(deltas) > self.most_deltas:
            base, counts, deltas = self._fold(version, run, base, counts, deltas)
        return self._commit(version, run, batch, base, counts, deltas, facts)

    def _commit(self, version, run, batch, base, counts, deltas, facts) -> int:
        record = {"run": run, "batch": batch, "written_at": time.time(), "base": base, "counts": counts}
        record |= {"deltas": deltas, "facts": facts or {}}
        if not self._commits.put(version, record):
            self.refresh()
            raise RuntimeError(f"another writer has committed version {version} of {self.path}")
        self._known.append((version, record))
        self._forget()
        return version

    def _fold(
        self, version: int, run: str, base: dict, counts: dict, deltas: list[dict]
    ) -> tuple[dict, dict, list[dict]]:
        total = sum(d["rows"] for d in deltas)
        if 4 * total < sum(counts.values()):
            path = f"{self.path}/folded/{version}-{run}"
            rows = self._merged(self._deltas(deltas)).withColumn("_v", F.lit(version))
            rows.write.mode("overwrite").parquet(path)
            return base, counts, [{"path": path, "rows": total}]
        touched = [r[0] for r in self._deltas(deltas).select(self.part()).distinct().collect()]
        rows = self._at({"base": base, "deltas": deltas}, touched)
        new, fresh = self._write_base(rows, version, run)
        return base | new, counts | fresh, []

    def _write_base(self, rows: DataFrame, version: int, run: str) -> tuple[dict, dict]:
        path = f"{self.path}/base/{version}-{run}"
        placed = rows.select(*self.schema.fieldNames(), self.part().alias("part"))
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        found = self.spark.read.schema(self._wide("part")).parquet(path).groupBy("part").count().collect()
        return {str(r["part"]): path for r in found}, {str(r["part"]): r["count"] for r in found}

    def _files(self, record: dict) -> set[str]:
        own = {d["path"] for d in record["deltas"] if d["path"].startswith(f"{self.path}/")}
        return own | {f"{path}/part={p}" for p, path in record["base"].items()}

    def _forget(self) -> None:
        """Remove old commits, and the files that no kept commit names."""
        limit = time.time() - self.retain_seconds
        while len(self._known) > self.KEEP and self._known[0][1]["written_at"] < limit:
            version, record = self._known.pop(0)
            kept = set().union(*[self._files(r) for _, r in self._known])
            self._commits.drop(version)
            for path in self._files(record) - kept:
                remove(self.spark, path)
