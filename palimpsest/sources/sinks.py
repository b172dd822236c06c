"""Writers: overwrite, append, keep-last upsert, details sidecar, report, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def keep_last(previous: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables, the newer row of each key winning. Write it to another path than the one ``previous`` is read from."""
    both = previous.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_gen"))
    return both.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_gen", "_rn")


def details(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """A row for each element of an array of structs."""
    return df.select(*keys, F.explode(items).alias("_d")).select(*keys, "_d.*")


def sharded(df: DataFrame, shards: int, key: str = "qid") -> DataFrame:
    """Rows of a key together, for jobs that work on a shard at a time."""
    return df.repartition(shards, key)


def markdown(df: DataFrame, *order: str) -> DataFrame:
    """(line_no, line) of a Markdown table, rows in that order; for results small enough to be read."""
    shown = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("line_no"), line(shown).alias("line"))
    head = df.sparkSession.range(2).select(F.col("id").cast("int").alias("line_no"), F.when(F.col("id") == 0, line([F.lit(c) for c in df.columns])).otherwise(line([F.lit("-")] * len(df.columns))).alias("line"))
    return head.unionByName(rows)


def manifest(spark: SparkSession, path: str, outputs: dict[str, str], **parameters: object) -> DataFrame:
    """A row for each Parquet output, with its rows (counted from the footers) and columns, and the parameters of the run;
    written as JSON to ``path`` and returned."""
    found = [(name, where, (df := spark.read.parquet(where)).count(), df.columns, {k: str(v) for k, v in parameters.items()}) for name, where in sorted(outputs.items())]
    rows = spark.createDataFrame(found, "output string, path string, n_rows long, columns array<string>, parameters map<string,string>")
    rows.coalesce(1).write.mode("overwrite").json(path)
    return rows
