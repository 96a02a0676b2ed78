"""Sources and sinks: zipped CSV archives, sensor matrices, tidy states, results, manifests, checks."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gausstide.operators.grid import numbered
from gausstide.operators.states import from_tidy, tidy

TIMES, STATIONS = "started_at", ("start_station_id", "start_station_name")
CHUNK = 200_000


def month_paths(template: str, months: list[str]) -> list[str]:
    """Paths (or URLs) of monthly archives, from a template with ``{month}``."""
    return [template.format(month=m) for m in months]


def _csv_members(archive: zipfile.ZipFile) -> list[str]:
    """CSV members that do not lie among system files."""
    return [n for n in archive.namelist() if n.lower().endswith(".csv") and not n.startswith("__MACOSX/") and not n.rsplit("/", 1)[-1].startswith("._")]


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class _MemberReader(DataSourceReader):
    """A partition per (archive, member). Archives are opened by path, so they lie on a file system that the driver and all executors mount."""

    def __init__(self, options: dict, schema: StructType):
        self.paths, self.columns = json.loads(options["paths"]), [f.name for f in schema.fields]
        self.alternatives = json.loads(options.get("alternatives", "{}"))

    def partitions(self) -> list[Member]:
        out = []
        for path in self.paths:
            with zipfile.ZipFile(path) as archive:  # the directory at its end, no member
                names = _csv_members(archive)
            if not names:
                raise ValueError(f"no CSV member in {path}")
            out += [Member(path, n) for n in names]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(partition.path) as archive:
            with archive.open(partition.name) as f:
                header = pd.read_csv(f, nrows=0).columns
            source = {c: next((x for x in self.alternatives.get(c, [c]) if x in header), None) for c in self.columns}
            if None in source.values():
                return
            with archive.open(partition.name) as f:  # decompressed as it is read
                for chunk in pd.read_csv(f, usecols=list(set(source.values())), dtype=str, chunksize=CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(chunk[source[c]].where(chunk[source[c]].notna(), None), pa.string()) for c in self.columns], self.columns)


class ZippedCsv(DataSource):
    """Spark data source "zipped_csv": string columns of the CSV members of zip archives, only those of the schema.

    Options: ``paths``, a JSON list; ``alternatives``, a JSON object from a column to the header names it may have, the
    first that is there counts. Members that lack a column are skipped; an archive without CSV members is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> _MemberReader:
        return _MemberReader(self.options, schema)


def read_zipped_csv(spark: SparkSession, paths: list[str], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """``columns`` (name to the header names it may have) of the CSV members of zip archives, as strings; a task per member, streamed in chunks."""
    spark.dataSource.register(ZippedCsv)
    reader = spark.read.format("zipped_csv").schema(", ".join(f"`{c}` string" for c in columns))
    return reader.option("paths", json.dumps(paths)).option("alternatives", json.dumps(columns)).load()


def read_trip_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ts, k) as strings from zipped CSV files, see ``read_zipped_csv``; a member without the time or a station column is skipped."""
    return read_zipped_csv(spark, paths, {"ts": (TIMES,), "k": STATIONS})


def read_locations(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, latitude, longitude) in the order of ``ids`` (id, place), from a CSV without header; a missing id is an error."""
    found = spark.read.schema("id long, latitude double, longitude double").csv(path, header=False)
    both = ids.join(F.broadcast(found), "id", "left")
    need = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.col("latitude")).otherwise(F.raise_error(F.lit("a sensor has no location")).cast("double"))
    return both.select("id", "place", need.alias("latitude"), "longitude").orderBy("place")


def read_sensor_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, ts, k, c) of a sensor table stored as Parquet (ts_ns, sensor, value); HDF5 needs a library that is not assumed here."""
    rows = spark.read.parquet(path).select(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)).alias("ts"), F.col("sensor").cast("string").alias("k"), F.col("value").cast("double").alias("c"))
    steps = numbered(rows.select("ts").distinct(), ["ts"]).withColumn("i", F.col("i").cast("int"))
    return rows.join(steps, "ts").select("i", "ts", "k", "c")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, plain or gzip, with an explicit schema."""
    return spark.read.schema(schema).csv(path, header=True)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def cached(path: str, make) -> DataFrame:
    """The Parquet table at ``path``, made by ``make()`` if it is not there."""
    spark = SparkSession.getActiveSession()
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with header; a path that exists is an error."""
    df.write.mode("errorifexists").option("header", True).option("compression", compression).csv(path)


#: What the diagnostics of the local chart hold, of the columns that are there.
DIAGNOSTICS = ["origin", "horizon", "source_index", "target_index", "window_length", "ridge", "min_pred_eig", "reference_residual", "reference_refreshed", "reference_fallback", "error"]


def write_panel_outputs(folder: str, panel: DataFrame, tuning: DataFrame, inference: DataFrame, settings: DataFrame) -> None:
    """CSV tables of an evaluation: losses, tuning, inference, settings, and the local chart's diagnostics."""
    diagnostics = panel.filter("method = 'transport_local'").select(*(c for c in DIAGNOSTICS if c in panel.columns))
    for name, table in {"losses": panel, "tuning": tuning, "inference": inference, "settings": settings, "diagnostics": diagnostics}.items():
        write_results(table, f"{folder}/{name}")


def write_states(states: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Long means and covariances; ``by`` names columns of a series, such as a panel. Doubles are written so that they read back the same."""
    means, cells = tidy(states, by)
    write_results(means, f"{path}/means")
    write_results(cells, f"{path}/covariances")


def read_states(spark: SparkSession, path: str, by: str = "") -> DataFrame:
    """(by, t, mean, cov); ``by`` as a schema, such as "panel int"."""
    keys = f"{by}, " if by else ""
    names = [c.split()[0] for c in by.split(",")] if by else []
    return from_tidy(read_results(spark, f"{path}/means", f"{keys}t int, i int, value double"), read_results(spark, f"{path}/covariances", f"{keys}t int, i int, j int, value double"), names)


def row_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns, content): for each table the rows, the columns, and a sum of row hashes that does not depend on order; one pass each. Beside the digests of ``manifest`` it tells what was written."""
    parts = [df.select(F.lit(n).alias("name"), F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).groupBy("name").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("content")).withColumn("columns", F.lit(",".join(df.columns))) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("name", "rows", "columns", "content")


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def altered(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose size or digest is not the expected one, or which are missing."""
    name = F.element_at(F.split("path", "/"), -1)
    got = found.select(name.alias("name"), "bytes", "sha256")
    want = expected.select(name.alias("name"), F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want"))
    return want.join(got, "name", "left").filter("sha256 is null or sha256 <> want or bytes <> want_bytes")


def grid_problems(grid: DataFrame, steps: int) -> DataFrame:
    """(problem, n): values that are null, negative, not finite or not whole, repeated cells, missing steps."""
    bad = grid.agg(
        F.count_if(F.col("c").isNull() | F.isnan("c") | (F.abs("c") == float("inf"))).alias("not finite"),
        F.count_if(F.col("c") < 0).alias("negative"),
        F.count_if(F.abs(F.col("c") - F.rint("c")) > 1e-12).alias("not whole"),
        (F.count("*") - F.count_distinct("i", "k")).alias("repeated cell"),
        (F.lit(steps).cast("long") - F.count_distinct("i")).alias("missing step"),
    )
    return bad.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, bad.columns)), F.array(*[f"`{c}`" for c in bad.columns]))).alias("problem", "n")).filter("n <> 0")


# ---- processed packages

COUNTS, PROFILE, MANIFEST = "selected_hourly_counts.csv", "selected_station_profile.csv", "processed_data_manifest.json"


def package_problems(counts: DataFrame, stations: list[str], start: str, steps: int, fit_end: int) -> DataFrame:
    """(problem, n): what keeps a package of hourly counts (timestamp, a column per station in the order of ``stations``) from being loaded; no rows if nothing does.

    The data are read once. The calendar is every hour from ``start`` on, ``steps`` of them, each once; values are finite,
    not negative, and whole to 1e-12; the fitting block ends within the calendar.
    """
    spark = counts.sparkSession
    driver = [("no stations", int(not stations)), ("repeated station", len(stations) - len(set(stations))), ("columns differ from the profile", int(counts.columns != ["timestamp", *stations])), ("fitting block outside the calendar", int(not 0 < fit_end <= steps))]
    at = F.col("timestamp").try_cast("timestamp")
    hour = (F.unix_timestamp(at) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 3600
    inside = at.isNotNull() & (hour == F.floor(hour)) & (hour >= 0) & (hour < steps)
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in counts.columns[1:])) if len(counts.columns) > 1 else F.array().cast("array<double>")
    rows = counts.select(F.when(inside, hour).alias("h"), values.alias("v"))
    bad = lambda f: F.sum(F.size(F.filter("v", f)))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    found = rows.agg(
        F.count_if(F.col("h").isNull()).alias("row outside the calendar"),
        (F.count("h") - F.count_distinct("h")).alias("repeated hour"),
        (F.lit(steps).cast("long") - F.count_distinct("h")).alias("missing hour"),
        bad(lambda x: ~finite(x)).alias("not finite"),
        bad(lambda x: finite(x) & (x < 0)).alias("negative"),
        bad(lambda x: finite(x) & (F.abs(x - F.rint(x)) > 1e-12)).alias("not whole"),
    )
    names = found.columns
    data = found.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long") for c in names)))).alias("problem", "n"))
    return data.unionByName(spark.createDataFrame(driver, "problem string, n long")).filter("n <> 0")


def load_package(spark: SparkSession, folder: str, start: str, steps: int) -> tuple[DataFrame, list[str], int]:
    """(grid (i, k, c), stations in order, end of the fitting block) of a processed package; ValueError with all its problems if it has any. Stations are few: a column each."""
    profile = spark.read.csv(f"{folder}/{PROFILE}", header=True)
    stations = [r.station_id for r in profile.select("station_id", F.col("station_rank").cast("int").alias("rank")).orderBy("rank").collect()]
    fit_end = int(read_json(spark, f"{folder}/{MANIFEST}")["processing"]["standardization_block_hours"])
    counts = spark.read.csv(f"{folder}/{COUNTS}", header=True)
    problems = package_problems(counts, stations, start, steps, fit_end).orderBy("problem").collect()
    if problems:
        raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in problems))
    i = ((F.unix_timestamp(F.col("timestamp").cast("timestamp")) - F.unix_timestamp(F.lit(start).cast("timestamp"))) / 3600).cast("int")
    cells = F.explode(F.map_from_arrays(F.array(*map(F.lit, stations)), F.array(*(F.col(f"`{c}`").cast("double") for c in stations)))).alias("k", "c")
    return counts.select(i.alias("i"), cells), stations, fit_end
