"""File sources and sinks: JSON lines in three strictnesses, CSV, sharded tables with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def jsonl_blank_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Blank lines are left out; malformed ones fail."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def jsonl_counting(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): good rows, and the lines that are none."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    df = spark.read.schema(wide).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").persist()
    return df.where("_bad is null").drop("_bad"), df.where("_bad is not null").select("_bad")


def csv_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def resolve_fields(columns: list[str], aliases: dict[str, list[str]], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The column for each field: an override, else the first alias that is there, in any case of letters."""
    lower = {c.lower(): c for c in columns}
    out = {}
    for field, names in aliases.items():
        if overrides and field in overrides:
            if overrides[field] not in columns:
                raise ValueError(f"no column {overrides[field]} for {field}")
            out[field] = overrides[field]
        elif found := next((lower[n.lower()] for n in names if n.lower() in lower), None):
            out[field] = found
    return out


def digest(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-independent digest: the sum of row hashes."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return r[0], str(r[1] or 0)


def write_sharded(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes df partitioned by columns, then, last, a manifest: path, rows, digest. A folder without it is no table."""
    df.write.partitionBy(*by).mode("errorifexists").parquet(f"{path}/data")
    back = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    rows, sum_ = digest(back.select(*df.columns))
    m = df.sparkSession.createDataFrame([(f"{path}/data", rows, sum_)], "path string, rows long, digest string")
    m.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return m


def read_sharded(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Reads what write_sharded wrote, and checks it against the manifest."""
    m = spark.read.schema("path string, rows long, digest string").json(f"{path}/manifest").first()
    df = spark.read.schema(schema).parquet(f"{path}/data").select(*[f.name for f in schema.fields])
    if digest(df) != (m["rows"], m["digest"]):
        raise ValueError(f"{path} is not as its manifest says")
    return df


def write_frozen(df: DataFrame, path: str, schema: StructType) -> None:
    """Writes once; a second write of the same rows is no change, of other rows an error."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if digest(spark.read.schema(schema).parquet(path).select(*df.columns)) != digest(df):
            raise ValueError(f"{path} is frozen with other rows")
        return
    df.write.parquet(path)


def inspected(df: DataFrame, split: str, order: str, n: int = 3, width: int = 240) -> DataFrame:
    """The first n rows of each split, strings cut to `width`; also a row limit for each split, with width 0 for whole strings."""
    w = Window.partitionBy(split).orderBy(order)
    out = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    cut = [F.substring(f.name, 1, width).alias(f.name) if width and f.dataType == StringType() else F.col(f.name) for f in df.schema.fields]
    return out.select(*cut)


def table_states(tables: dict[str, DataFrame], copies: dict[str, DataFrame]) -> dict[str, str]:
    """same, different, missing or unexpected for each table of a backup, by row counts and digests."""
    out = {}
    for name in sorted(tables.keys() | copies.keys()):
        if name not in copies:
            out[name] = "missing"
        elif name not in tables:
            out[name] = "unexpected"
        else:
            a, b = tables[name], copies[name]
            out[name] = "same" if a.columns == b.columns and digest(a) == digest(b) else "different"
    return out
