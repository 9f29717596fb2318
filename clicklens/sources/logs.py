"""Processor logs and experiment result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklens import constants as K
from clicklens.schemas import EXPERIMENT_RESULT, PROCESSOR_RECORD


def metrics_json(line: Column | str = "value") -> Column:
    """JSON object behind the metrics marker of a log line, colour codes cut off; else NULL."""
    line = F.col(line) if isinstance(line, str) else line
    found = F.regexp_extract(line, K.METRICS_MARKER + r"[^{]*(\{.*\})", 1)
    return F.when(found != "", found)


def parse_metrics_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records of a log; lines without marker or with undecodable JSON are skipped.

    Counters may be written as whole numbers with a fraction, such as 6.0. Values of the wrong JSON type become
    NULL, so they count as 0 later.
    """
    whole = [f.name for f in PROCESSOR_RECORD.fields if isinstance(f.dataType, T.LongType)]
    numbers = T.StructType(
        [T.StructField(f.name, T.DoubleType() if f.name in whole else f.dataType) for f in PROCESSOR_RECORD.fields]
    )
    text = lines.withColumn("_json", metrics_json(column)).filter(
        F.expr("try_parse_json(_json) IS NOT NULL")
    )
    kept = [c for c in lines.columns if c != column]
    fields = [
        F.col(f"_r.{f}").cast("bigint").alias(f) if f in whole else F.col(f"_r.{f}").alias(f)
        for f in PROCESSOR_RECORD.fieldNames()
    ]
    return text.select(*kept, F.from_json("_json", numbers).alias("_r")).select(*kept, *fields)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file and their ``place`` in it, which orders the lines of a file."""
    within = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), within.alias("place"))


def ordered_records(lines: DataFrame) -> DataFrame:
    """Records of the lines of ``read_log`` with their number ``seq`` in the file, from 1.

    With it the latest record of a log and the number of records follow as for any other records.
    """
    order = W.partitionBy("file").orderBy("place")
    records = parse_metrics_lines(lines)
    return records.withColumn("seq", F.row_number().over(order).cast("bigint")).drop("place")


def log_line(record: Column, logger: str = "jobs.realtime") -> Column:
    """A metrics log line in colour, as a processor prints it."""
    return F.concat(
        F.lit(f"\u001b[36mINFO {logger}: {K.METRICS_MARKER}"), F.to_json(record), F.lit("\u001b[0m")
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results, one JSON document per file or per line."""
    return spark.read.schema(EXPERIMENT_RESULT).option("multiLine", True).json(path)


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPERIMENT_RESULT).json(path)


def result_records(results: DataFrame) -> DataFrame:
    """Processor records of every result with their order and ordinal per subtask."""
    from clicklens.operators.throughput import with_record_index

    flat = results.select(
        F.col("config.run_id").alias("run_id"),
        F.posexplode("metrics.processor_metrics.realtime_ctr.records").alias("seq", "_r"),
    ).select("run_id", F.col("seq").cast("bigint").alias("seq"), "_r.*")
    return with_record_index(flat.fillna(0, ["subtask_index"]), ["run_id"])
