"""Blank-delimited buoy text files (S1), dated CSV files (S2) and the CSV /
Parquet sinks (S3). Scans are lazy DataFrame reads; the series id comes from
each row's file path (``_metadata.file_path``), so a glob of many station
files is one distributed scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tokens(line) -> F.Column:
    return F.split(F.trim(line), r"\s+")


def buoy_headers(raw: DataFrame) -> list[list[str]]:
    """The distinct column-name lines of the files: a file's names line is
    the '#' line that names the first five (time) columns, the units line
    starts with ``#yr``. One row per distinct header reaches the driver."""
    rows = raw.where(F.col("value").startswith("#")).select(F.array_join(_tokens(F.regexp_replace("value", "^#+", "")), " ").alias("h"), "_path") \
        .where(~F.lower("h").startswith("yr mo dy")).groupBy("h").agg(F.min("_path").alias("first")).orderBy("first", "h").collect()
    return [r["h"].split() for r in rows]


def read_buoy(spark: SparkSession, path: str, series_pattern: str = r"([^/]+?)(?:\.txt)?$") -> DataFrame:
    """Parse blank-delimited buoy files.

    Every file's own names line decides the order of its columns: files of one
    glob may order them differently, and a column that a file lacks is NULL
    there. Lines starting with '#' are skipped; columns 1-5 (by position)
    build one TIMESTAMP_NTZ ``ts`` and are dropped; the rest are doubles
    (``try_cast``: bad tokens become NULL). ``series_id`` is extracted from
    the file path with ``series_pattern``. Files without a names line are an
    error when headers differ.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    headers = buoy_headers(raw)
    if not headers:
        raise ValueError(f"no header line in {path}")
    names = list(dict.fromkeys(n for h in headers for n in h[5:]))
    body = raw.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    if len(headers) > 1:  # one small row per file: which header it has
        which = raw.where(F.col("value").startswith("#")).select(F.array_join(_tokens(F.regexp_replace("value", "^#+", "")), " ").alias("_header"), "_path") \
            .where(~F.lower("_header").startswith("yr mo dy")).distinct()
        two = which.groupBy("_path").count().where("count > 1").limit(1).collect()
        if two:
            raise ValueError(f"{two[0]['_path']} has two different header lines")
        body = body.join(which, "_path", "left")
        body = body.withColumn("_header", F.when(F.col("_header").isNull(), F.raise_error(F.concat(F.col("_path"), F.lit(" has no header line")))).otherwise(F.col("_header")))
    t = _tokens(F.col("value"))
    part = lambda i: F.element_at(t, i + 1).cast("int")
    ts = F.make_timestamp_ntz(part(0), part(1), part(2), part(3), part(4), F.lit(0))

    def value(name):
        at = [F.when(F.col("_header") == " ".join(h), F.lit(h.index(name) + 1)) for h in headers if name in h]
        place = F.lit(headers[0].index(name) + 1) if len(headers) == 1 else F.coalesce(*at)
        return F.try_element_at(t, place).try_cast("double").alias(name)

    sid = F.url_decode(F.regexp_extract(F.col("_path"), series_pattern, 1))  # paths are URIs
    return body.select(sid.alias("series_id"), ts.alias("ts"), *[value(n) for n in names])


def write_buoy(df: DataFrame, path: str, cols: list[str], ts: str = "ts", key: str = "series_id") -> None:
    """Write one buoy text file per series and year
    (``path/series_id=<id>/year=<y>/part-*``): a '#' names line, a '#' units
    line, then ``YYYY MM DD hh mm v1 v2 ...``. A long series is written by
    as many tasks as it has years."""
    header = "#YY MM DD hh mm " + " ".join(cols)
    units = "#yr mo dy hr mn " + " ".join("-" for _ in cols)
    line = F.concat_ws(" ", F.year(ts).cast("string"), F.lpad(F.month(ts).cast("string"), 2, "0"),
                       F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"), F.lpad(F.hour(ts).cast("string"), 2, "0"),
                       F.lpad(F.minute(ts).cast("string"), 2, "0"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("MM")) for c in cols])
    body = df.select(key, F.year(ts).alias("year"), F.lit(2).alias("_o"), F.col(ts).alias("_t"), line.alias("value"))
    keys = df.select(key, F.year(ts).alias("year")).distinct()
    heads = keys.select(key, "year", F.lit(0).alias("_o"), F.lit(None).cast("timestamp_ntz").alias("_t"),
                        F.lit(header).alias("value")) \
        .unionByName(keys.select(key, "year", F.lit(1).alias("_o"), F.lit(None).cast("timestamp_ntz").alias("_t"),
                                 F.lit(units).alias("value")))
    out = heads.unionByName(body).repartition(key, "year").sortWithinPartitions(key, "year", "_o", "_t")
    out.select(key, "year", "value").write.mode("errorifexists").partitionBy(key, "year").text(path)


def read_dated_csv(spark: SparkSession, path: str, value_cols: list[str], index: str = "Date",
                   date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a ``Date`` index column (``yyyy-MM-dd``) and double
    value columns; explicit schema, no inference."""
    schema = T.StructType([T.StructField(index, T.DateType())] +
                          [T.StructField(c, T.DoubleType()) for c in value_cols])
    return spark.read.csv(path, header=True, schema=schema, dateFormat=date_format)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: CSV sink with a header line, the time column kept."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: str | None = "series_id",
                  mode: str = "errorifexists") -> None:
    """S3 default sink: Parquet partitioned by series."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
