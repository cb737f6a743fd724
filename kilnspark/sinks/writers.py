"""Writers of the pipeline's files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, replaced or appended; nulls are kept as keys are part of a record."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_by_category(df: DataFrame, path: str) -> None:
    """One folder per category; reading the path itself gives their union."""
    df.write.mode("overwrite").partitionBy("category").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], append: bool = False) -> None:
    """CSV with a header and a fixed column order."""
    df.select(*columns).write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_exemplars(df: DataFrame, path: str) -> None:
    """A folder of one record per exemplar (name and its fields)."""
    df.write.mode("overwrite").partitionBy("name").json(path)


def write_single_token(kept: DataFrame, stats: DataFrame, path: str) -> None:
    """What the single-token filter keeps, a folder per category, and its summary."""
    write_by_category(kept, f"{path}/kept")
    write_jsonl(stats, f"{path}/summary")


def write_traces(df: DataFrame, path: str) -> None:
    """Tensor traces as arrays, a folder per condition."""
    df.write.mode("append").partitionBy("condition").parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, dataset_hash) that depends on the rows but not on their order or files.

    Row digests are summed in two 64-bit halves before the shuffle; nothing is sorted.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(20,0)"))
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), half(1).alias("a"), half(16).alias("b"))
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.coalesce(F.col("a").cast("string"), F.lit("0")), F.coalesce(F.col("b").cast("string"), F.lit("0"))), 256).alias("dataset_hash"))


def counts_map(df: DataFrame, key: str) -> DataFrame:
    """One row with a map from key to number of rows."""
    return df.groupBy(F.coalesce(key, F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def nested_tables(**tables: DataFrame) -> DataFrame:
    """One row of JSON with a sorted list of records per table; for report tables, whose size is that of their groups."""
    lists = {name: df.agg(F.array_sort(F.collect_list(F.struct(*sorted(df.columns))))).scalar().alias(name) for name, df in tables.items()}
    one = next(iter(tables.values())).sparkSession.range(1)
    return one.select(*lists.values()).select(F.to_json(F.struct(*tables)).alias("tables_json"))


def batch_request(custom_id: Column, system: Column, user: Column, model: str, endpoint: str = "/v1/responses", temperature: float = 0.7, max_tokens: int = 2000) -> Column:
    """A batch request line as JSON text."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", system), message("user", user)).alias("input"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_output_tokens"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit(endpoint).alias("url"), body.alias("body")))


def check_halt(df: DataFrame, error: str, most: int = 0, rate: float = 0.0) -> DataFrame:
    """``df``, or RuntimeError if more rows than allowed have the error flag."""
    n, bad = df.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.col(error), F.lit(False)).cast("int"))).first()
    if (bad or 0) > max(most, rate * n):
        raise RuntimeError(f"{bad} of {n} rows have {error}")
    return df
