"""Durable tables on plain parquet: snapshots, append tables and thin external writers."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens.functions.plan import local_rows
from clicklens.operators.model import Head, Model
from clicklens.schemas import WEIGHTS
from clicklens.session import exists, names, remove, rename_if_free, shared_folder


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def staged(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    For a reduced result that several later steps read, so that its big inputs are scanned once.
    The written table also cuts the lineage and survives the loss of executors.
    """
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class SnapshotTable:
    """A table that is replaced as a whole, one version at a time, by a single writer.

    Every version has a folder of its own and becomes current when its small manifest row is written
    after it, so a failed write leaves the current version untouched and a reader keeps the version
    it began with. A version carries the run and batch that wrote it: the same pair again changes
    nothing, and a new run goes on from the newest version. Versions beyond the newest ``KEEP`` go
    when they are older than ``retain_seconds``.
    """

    KEEP = 3
    _MANIFEST = T.StructType(
        [
            T.StructField("version", T.LongType()),
            T.StructField("run", T.StringType()),
            T.StructField("batch", T.LongType()),
            T.StructField("written_at", T.DoubleType()),
        ]
    )

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, retain_seconds: float = 86_400.0
    ) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.retain_seconds = retain_seconds

    def _known(self) -> list[Row]:
        """Manifest rows, oldest first: a few, as old versions are removed."""
        rows = read_or_none(self.spark, f"{self.path}/manifest", self._MANIFEST)
        return [] if rows is None else sorted(rows.drop("v").collect(), key=lambda r: r["version"])

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        return [r["version"] for r in self._known()]

    def version_of(self, run: str, batch: int) -> tuple[int, bool]:
        """The version that a batch of a run has written or is to write, and whether it is complete."""
        known = self._known()
        for r in known:
            if (r["run"], r["batch"]) == (run, batch):
                return r["version"], True
        return (known[-1]["version"] + 1 if known else 0), False

    def read(self, version: int | None = None, before: int | None = None) -> DataFrame | None:
        """The newest version, a given one, or the newest below ``before``; None if there is none."""
        known = [v for v in self.versions() if before is None or v < before]
        if version is None:
            version = known[-1] if known else None
        if version is None or version not in known:
            return None
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{version}")

    def write(self, rows: DataFrame, run: str | None = None, batch: int | None = None) -> int:
        """Write the next version, unless this batch of this run is there already."""
        run = uuid.uuid4().hex if run is None else run
        version, complete = self.version_of(run, batch or 0)
        if complete:
            return version
        fields = self.schema.fieldNames()
        rows.select(*fields).write.mode("overwrite").parquet(f"{self.path}/data/{version}")
        row = (version, run, batch or 0, time.time())
        manifest = local_rows(self.spark, [row], self._MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self._forget()
        return version

    def _forget(self) -> None:
        """Remove old versions, the manifest row first."""
        limit = time.time() - self.retain_seconds
        for r in self._known()[: -self.KEEP]:
            if r["written_at"] < limit:
                remove(self.spark, f"{self.path}/manifest/v={r['version']}")
                remove(self.spark, f"{self.path}/data/{r['version']}")


class AppendTable:
    """Rows with increasing ids, appended by any number of writers.

    A row is written aside and its folder then renamed to the first id that nobody has: writers who meet at one id
    get two, and neither row is lost. A row that was never renamed is not seen. The ids are a partition column, so
    looking up one id reads one file.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([T.StructField("id", T.LongType()), *schema.fields])

    def read(self) -> DataFrame:
        rows = read_or_none(self.spark, self.path, self.schema)
        return local_rows(self.spark, [], self.schema) if rows is None else rows.select(*self.schema.fieldNames())

    def next_id(self) -> int:
        """The id after the greatest one; another writer may take it first."""
        found = [n[3:] for n in names(self.spark, self.path) if n.startswith("id=")]
        return max((int(n) for n in found if n.isdigit()), default=0) + 1

    def append(self, row: DataFrame) -> int:
        """Append one row and return its id."""
        own = f"_{uuid.uuid4().hex}"
        waits = f"{self.path}/{own}"
        row.select(*self.schema.fieldNames()[1:]).write.parquet(waits)
        new_id = self.next_id()
        while True:
            target = f"{self.path}/id={new_id}"
            if rename_if_free(self.spark, waits, target):
                # Where a rename onto a folder that appeared meanwhile moves into it, the row is there, unseen.
                if not exists(self.spark, f"{target}/{own}"):
                    return new_id
                waits = f"{target}/{own}"
            new_id += 1

    def count(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("rows"))


class ModelStore:
    """Model history: an append table of heads, and the weights of each as a folder that its head names.

    The weights stay a distributed table however many features there are. The head is written
    last, so a model is visible only when it is complete. The current model is the newest head.
    Several writers may append: each writes weights of its own before its head gets an id.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        fields = [
            T.StructField("snapshot_name", T.StringType()),
            T.StructField("w0", T.DoubleType()),
            T.StructField("baseline_ctr", T.DoubleType()),
            T.StructField("global_strength", T.DoubleType()),
            T.StructField("triplet_strength", T.DoubleType()),
            T.StructField("family_strengths", T.MapType(T.StringType(), T.DoubleType())),
            # Metrics of the run that made the model, as JSON text.
            T.StructField("weight_update", T.StringType()),
            # Number of the clock's pass that made the model, if one did.
            T.StructField("tick", T.LongType()),
            # Name of the folder with its weights.
            T.StructField("weights", T.StringType()),
        ]
        self.heads = AppendTable(spark, f"{self.path}/heads", T.StructType(fields))

    def append(self, model: Model, run_metrics: DataFrame | None = None, tick: int | None = None) -> int:
        """Append a model with the optional one-row metrics of its run; returns the id."""
        h, folder = model.head, uuid.uuid4().hex
        model.weights.select(*WEIGHTS.fieldNames()).write.parquet(f"{self.path}/weights/{folder}")
        head = self.spark.range(1).select(
            F.lit(h.snapshot_name).alias("snapshot_name"),
            F.lit(float(h.w0)).alias("w0"),
            F.lit(float(h.baseline_ctr)).alias("baseline_ctr"),
            F.lit(float(h.global_strength)).alias("global_strength"),
            F.lit(float(h.triplet_strength)).alias("triplet_strength"),
            F.create_map(
                *[F.lit(x) for f, v in sorted(h.family_strengths.items()) for x in (f, float(v))]
            ).alias("family_strengths"),
            (
                F.lit(None).cast("string")
                if run_metrics is None
                else run_metrics.select(F.to_json(F.struct("*"))).scalar()
            ).alias("weight_update"),
            F.lit(tick).cast("bigint").alias("tick"),
            F.lit(folder).alias("weights"),
        )
        return self.heads.append(head)

    def has_tick(self, number: int) -> bool:
        return not self.heads.read().filter(F.col("tick") == number).isEmpty()

    def last_id(self) -> int:
        return self.heads.next_id() - 1

    def _head(self, model_id: int) -> Row | None:
        return self.heads.read().filter(F.col("id") == model_id).first()

    def _weights(self, head: Row) -> DataFrame:
        return self.spark.read.schema(WEIGHTS).parquet(f"{self.path}/weights/{head['weights']}")

    def weights(self, model_id: int) -> DataFrame:
        head = self._head(model_id)
        if head is None:
            raise ValueError(f"there is no model {model_id}")
        return self._weights(head)

    def current(self) -> Model:
        """The newest model; an error if there is none."""
        r = self._head(self.last_id())
        if r is None:
            raise ValueError("current model is missing")
        head = Head(
            r["snapshot_name"],
            r["w0"],
            r["baseline_ctr"],
            r["global_strength"],
            r["triplet_strength"],
            dict(r["family_strengths"]),
        )
        return Model(head, self._weights(r))


def write_kafka(messages: DataFrame, servers: str, topic: str | None = None) -> None:
    """Batch write of (topic, key, value) rows. Needs the Kafka connector on the class path."""
    writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
    if topic is not None:
        writer = writer.option("topic", topic)
    writer.save()


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a relational table, for example a staging table that the database merges."""
    rows.write.mode("append").jdbc(url, table, properties=properties)
