"""Readers and writers: ping files of drifting layout, catalogs of views, partitioned archives, manifests."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import cut

#: The columns of headerless ping files, in order, and what other files call the ones we use.
LEGACY_COLUMNS = [
    "Timestamp", "Type of mobile", "MMSI", "Latitude", "Longitude", "Navigational status", "ROT", "SOG", "COG", "Heading", "IMO",
    "Callsign", "Name", "Ship type", "Cargo type", "Width", "Length", "Type of position fixing device", "Draught", "Destination", "ETA", "Data source type",
]
SYNONYMS = {
    "ts": ["# Timestamp", "Timestamp", "time", "datetime"],
    "mmsi": ["MMSI"],
    "lat": ["Latitude", "lat"],
    "lon": ["Longitude", "lon", "lng"],
    "sog": ["SOG", "speed over ground", "speed"],
    "name": ["Name", "vessel name"],
    "ship_type": ["Ship type", "vessel type"],
    "length": ["Length"],
    "draught": ["Draught", "draft"],
}


def find_column(columns: list[str], names: list[str]) -> str | None:
    """The column that has one of the names in any case, else the first that contains one; None without any."""
    folded = {c.strip().lstrip("﻿").lower(): c for c in reversed(columns)}
    for n in names:
        if n.lower() in folded:
            return folded[n.lower()]
    return next((c for n in names for k, c in folded.items() if n.lower() in k), None)


def rename(df: DataFrame, synonyms: dict[str, list[str]] = SYNONYMS, required: tuple[str, ...] = ("ts", "mmsi", "lat", "lon")) -> DataFrame:
    """df with our names for the columns found; a missing required one fails, other columns go."""
    found = {k: find_column(df.columns, v) for k, v in synonyms.items()}
    if lost := [k for k in required if not found[k]]:
        raise ValueError(f"no column for {', '.join(lost)} among {', '.join(df.columns)}")
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in found.items() if c))


def read_pings(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """All-text pings of one layout; without a header the legacy columns, up to 5 more or fewer."""
    reader = spark.read.option("sep", sep).option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    if header:
        return rename(reader.option("header", True).csv(path))
    names = [*LEGACY_COLUMNS, *(f"extra_{i}" for i in range(5))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return rename(reader.schema(schema).csv(path))


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """file, sep, header and line (the header line, else null) of each ping file under a path, from its first line.

    The first line is the least row of the file's first block; a byte-order
    mark is dropped, the separator is the more frequent of comma and
    semicolon, and a line that names a vessel and a latitude is a header.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value").withColumn("i", F.monotonically_increasing_id())
    first = rows.filter("at = 0").groupBy("file").agg(F.regexp_replace(F.min_by("value", "i"), "^\ufeff", "").alias("line"))
    many = lambda c: F.char_length("line") - F.char_length(F.replace("line", F.lit(c)))
    header = F.lower("line").contains("mmsi") & F.lower("line").contains("lat")
    return first.select("file", F.when(many(";") > many(","), ";").otherwise(",").alias("sep"), header.alias("header"), F.when(header, F.col("line")).alias("line"))


def read_drifting(spark: SparkSession, path: str) -> DataFrame:
    """All-text pings of every file under a path, whatever each one's layout; files of one layout are one scan.

    What comes to the driver is the list of files, which Spark's own listing
    holds there too.
    """
    found = layouts(spark, path).groupBy("sep", "header", "line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("sep", "header", "line").collect()
    return read_layouts(spark, [{"path": r.files, "sep": r.sep, "header": r.header} for r in found])


def read_layouts(spark: SparkSession, layouts: list[dict]) -> DataFrame:
    """Union by name of read_pings for several layouts."""
    out = None
    for x in layouts:
        one = read_pings(spark, **x)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no layouts")
    return out


def conform(df: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """df's columns in the schema's order and types, absent ones null; an absent required one fails."""
    if lost := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def read_columns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table conformed to a schema, so that only its columns are read."""
    return conform(spark.read.parquet(path), schema)


def register(spark: SparkSession, sources: dict[str, dict]) -> list[str]:
    """Temporary views by name; sources have path, format (parquet), options and required (True). Returns what was made.

    An optional source whose path does not exist is left out; any other fault fails.
    """
    made = []
    for name, s in sources.items():
        if not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise ValueError(f"not a view name: {name!r}")
        try:
            df = spark.read.format(s.get("format", "parquet")).options(**s.get("options", {})).load(s["path"])
        except AnalysisException as e:
            if s.get("required", True) or "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        df.createOrReplaceTempView(name)
        made.append(name)
    return made


def views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def read_archive(spark: SparkSession, root: str, wanted: DataFrame, keys: tuple[str, ...] = ("wind_farm", "year")) -> DataFrame:
    """Rows of a partitioned archive for the wanted keys; folders of others aren't opened.

    Spark prunes folders at run time by the values of each key on the other side,
    if it broadcasts that side and takes it for selective: the keys are
    written, so that their size is known, and read behind a comparison, which
    holds for every key. Keys too many for a broadcast are joined unpruned.
    """
    keep = cut(wanted.select(*keys).distinct()).filter(F.hash(*keys) >= F.lit(-(1 << 31)))
    return spark.read.parquet(root).join(keep, list(keys), "left_semi")


def archive_index(spark: SparkSession, root: str, keys: list[str], ranges: list[str] = (), columns: list[str] = ()) -> DataFrame:
    """An archive's partitions by their keys (folders): rows, first_ and last_ of ranges (dates or numbers), and how many values columns have.

    All of it stands in the footers of Parquet files, which tasks read
    instead of rows; so the index costs no scan. Columns that the schema lacks
    have no values. The result is written, as the settings that let counts
    down to the footers hold here only.
    """
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return cut(index_plan(spark.read.parquet(root), keys, ranges, columns))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def index_plan(archive: DataFrame, keys: list[str], ranges: list[str] = (), columns: list[str] = ()) -> DataFrame:
    """The aggregation of archive_index, on any table."""
    known = [c for c in columns if c in archive.columns]
    aggs = [F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in ranges for n, f in (("first", F.min), ("last", F.max))), *(F.count(c).alias(f"{c}_values") for c in known)]
    out = archive.groupBy(*keys).agg(*aggs)
    return out.select(*out.columns, *(F.lit(0).cast("long").alias(f"{c}_values") for c in columns if c not in known))


def write_archive(df: DataFrame, root: str, existing: DataFrame | None = None, keys: tuple[str, ...] = ("wind_farm", "year")) -> None:
    """Write one folder for each key, only of keys that do not exist yet."""
    if existing is not None:
        df = df.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    df.repartition(*keys).write.option("partitionOverwriteMode", "dynamic").mode("append").partitionBy(*keys).parquet(root)


def inventory(df: DataFrame) -> DataFrame:
    """Rows of each file of a file-based table, with the place and month its name tells."""
    from tidemark.functions.values import file_fields

    name = F.col("_metadata.file_name")
    lat, lon, year, month = file_fields(name)
    return df.select(name.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows")).select("file", "rows", *(c.alias(n) for c, n in zip(file_fields(F.col("file")), ("lat", "lon", "year", "month"))))


def variable_sets(files: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Files, rows, farms and years of each set of variables: the first set all of whose columns a file has values of.

    files has file, wind_farm, year and the variables; a file without any set is other.
    """
    names = list(dict.fromkeys(c for s in sets.values() for c in s))
    per = files.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.first("wind_farm").alias("wind_farm"), F.first("year").alias("year"), *(F.count(c).alias(c) for c in names))
    kind = F.coalesce(*(F.when(F.forall(F.array(*(F.col(c) for c in s)), lambda n: n > 0), F.lit(k)) for k, s in sets.items()), F.lit("other"))
    return per.groupBy(kind.alias("set")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.count_distinct("wind_farm").alias("farms"), F.count_distinct("year").alias("years"))


def write(df: DataFrame, path: str, format: str = "parquet", overwrite: bool = False, **options: str) -> None:
    """Write a table; an existing one is kept unless overwrite is asked for."""
    df.write.format(format).options(**options).mode("overwrite" if overwrite else "errorifexists").save(path)


def append_manifest(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Append run rows with the next batch_id, which is returned."""
    try:
        last = spark.read.parquet(path).agg(F.max("batch_id")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        last = 0
    rows.withColumn("batch_id", F.lit(last + 1).cast("long")).write.mode("append").parquet(path)
    return last + 1


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated status files, tagged with the file that names their event."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    return raw.select("*", F.regexp_extract("_metadata.file_name", r"([^/]+)\.[^.]*$", 1).alias("file_id"))


def asset_coverage(status: DataFrame, asset: str, ts: str = "ts") -> DataFrame:
    """For each asset of status rows: files, rows, first and last time."""
    return status.groupBy(asset).agg(F.count_distinct("file_id").alias("files"), F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def registry_parts(turbines: DataFrame, countries: list[str], farms: list[str]) -> DataFrame:
    """A turbine registry once for each part it belongs to (column part): all, country:<name> and farm:<name>; write it partitioned by part."""
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("country").isin(countries), F.concat(F.lit("country:"), "country")), F.when(F.col("wind_farm").isin(farms), F.concat(F.lit("farm:"), "wind_farm"))))
    return turbines.withColumn("part", F.explode(names))
