"""Exactly-once-by-key appends: the sink is the state, so a restart needs no other."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _existing(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path).select(*keys)


def append_new(batch: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """Append the rows of a batch whose key the table at ``path`` lacks; of equal keys within the batch the first."""
    row = F.struct(order, *[c for c in batch.columns if c != order])
    fresh = batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*").select(*batch.columns)
    have = _existing(batch.sparkSession, path, keys)
    if have is not None:
        fresh = fresh.join(have, list(keys), "left_anti")
    fresh.write.mode("append").parquet(path)


def resume_stream(spark: SparkSession, source: str, schema: str, sink: str, keys: Sequence[str], order: str, state: str, fmt: str = "json", work: Callable[[DataFrame], DataFrame] | None = None, files: int = 1):
    """A file stream from ``source`` whose rows reach ``sink`` once per key, all that is there now.

    ``state`` is the stream's checkpoint folder; a batch that is run again after
    a failure finds its keys in the sink and adds nothing. ``work`` is applied
    to each batch before it is written.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(source)

    def write(batch: DataFrame, _number: int) -> None:
        append_new(work(batch) if work else batch, sink, keys, order)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def missing(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose key isn't done."""
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def recovered(traces: DataFrame, completions: DataFrame, keys: Sequence[str] = ("prompt_id", "condition")) -> DataFrame:
    """Completions with those rebuilt from traces that lack one; their finish_reason is ``unknown``."""
    lost = missing(traces, completions, keys).withColumn("finish_reason", F.lit("unknown"))
    return completions.unionByName(lost.select(*[c for c in completions.columns if c in lost.columns]), allowMissingColumns=True)
