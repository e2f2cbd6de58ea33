"""Sinks: reports, evidence bundles and the retention log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.functions.numeric import clean


def _floating(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_floating(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _floating(kind.elementType)
    return _floating(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))


def _cleaned(value: Column, kind: T.DataType) -> Column:
    """The value with NaN and infinities as nulls at every depth; parts without floating numbers are left as they are."""
    if not _floating(kind):
        return value
    if isinstance(kind, T.StructType):
        fields = [_cleaned(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _cleaned(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _cleaned(x, kind.valueType))
    return clean(value).cast(kind)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating column, and in arrays, map values and structs at any depth. Nulls stay nulls; map keys are left alone."""
    bad = {f.name: _cleaned(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if _floating(f.dataType)}
    return df.withColumns(bad) if bad else df


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    out = without_nan(df)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").format(fmt).save(path)


def write_campaign(targets: DataFrame, path: str, campaign: Column, size: int = 1000, key: str = "target_id") -> None:
    """Campaign records of at most ``size`` targets, so no record grows with the survey."""
    cols = [c for c in targets.columns]
    numbered = targets.withColumn("campaign", campaign).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(1 << 30)))
    total = targets.count()
    parts = max(1, -(-total // max(1, size // 2)))
    grouped = numbered.withColumn("_part", F.col("_part") % parts).groupBy("campaign", "_part")
    grouped.agg(F.collect_list(F.struct(*cols)).alias("targets")).drop("_part").write.mode("overwrite").json(path)


def append_evidence(df: DataFrame, path: str) -> None:
    """One record per (run, target), stored by run so that a read of one run skips the rest."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def evidence_of(spark: SparkSession, path: str, run_id=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if run_id is None else df.filter(F.col("run_id") == run_id)


def boundary_rows(df: DataFrame, score: str, threshold: float, margin: float) -> DataFrame:
    """Rows that just miss a threshold, with the reason they were kept."""
    s = F.col(score)
    reason = F.when(s >= threshold - margin / 2, "just below threshold").otherwise("near threshold")
    return df.filter((s >= threshold - margin) & (s < threshold)).withColumn("reason", reason)


def append_retention(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
