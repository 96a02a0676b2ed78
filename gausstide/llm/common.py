"""Shared helpers: table access, staged tables in the shared folder, text keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space: the space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
#: The most rows a table may have to be broadcast by hint; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 100_000

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of this process where that is unset and the master is local (tests). Any other master without the setting is an error: its executors would write to their own disks."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="gausstide-")
    return f"file://{_own_folder[app]}"


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns a reader of it. This cuts the lineage: a lost executor costs no more than the tasks that were running. The table stays, since the caller's result reads it; what a computation needs for itself goes through ``scratch``."""
    return _staged(df, f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession, tag: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stage`` whose tables are deleted together at the end of the block, also after an error. What leaves the block must not read them."""
    folder = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    try:
        yield lambda df, name: _staged(df, f"{folder}/{name}-{uuid.uuid4().hex[:8]}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where a count has shown that ``df`` is small; ``df`` should be a staged table, since it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until none of ``columns`` (compared without case, as Spark does) has it: helper columns that no column of the input clashes with."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; null has none."""
    parts = F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def text_key() -> Column:
    """Distinguishes rows that repeat a doc_id with other texts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on ``names``."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names])


def components(edges: DataFrame, step: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """Connected components by contraction.

    ``edges`` has long columns u and v. Each round points every node at its least neighbour, follows one pointer
    further, and rewrites the edges between what the nodes point at, until no edge is left; rounds grow with the
    logarithm of the longest path. Returns (node, label), label being the least node of the component. No edge list
    leaves the cluster; every round is a table staged by ``step``.
    """
    edges = step(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    labels = None
    while edges.take(1):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = step(up, "pointers")
        further = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        up = step(up.join(further, "up", "left").select("node", F.coalesce("up2", "up").alias("label")), "pointers")
        if labels is None:
            labels = up
        else:
            moved = up.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = step(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        a, b = up.select(F.col("node").alias("u"), F.col("label").alias("lu")), up.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        edges = edges.join(a, "u").join(b, "v").filter("lu <> lv")
        edges = step(edges.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
