"""Session helpers shared by all operators: table reading, durable cuts of lineage, safe names."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.errors import ConfigurationError

#: What stands in a column for "no value", compared after trimming and lower-casing.
NO_VALUE_WORDS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "undefined", "unknown", "undated", "not available", "no value")

#: White space and characters without a glyph that may surround a value.
BLANKS = r"[\s\u00a0\u00ad\u034f\u061c\u115f\u1160\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"


def table(spark: SparkSession, root: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One input table; only the named columns reach the scan."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns is not None else df


def strip_blanks(value: Column) -> Column:
    """Value without white space or invisible characters at either end."""
    return F.regexp_replace(value, rf"^{BLANKS}+|{BLANKS}+$", "")


def filled(value: Column) -> Column:
    """True where the value is neither null, blank nor a word for no value."""
    return value.isNotNull() & ~F.lower(strip_blanks(value)).isin(*NO_VALUE_WORDS)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only on a local master
    (tests, one machine) a temporary folder stands in where that setting is unset.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="broadsheet-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """df with its place (from 0) in a total order, without a window over all rows.

    Rows are sorted by range and written; each partition's number of rows gives the offset of the next
    (one row per partition on the driver). The numbers depend on the order alone, not on the partitions.
    """
    made = durable(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = sorted((r.part, r.n) for r in made.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, ahead = [], 0
    for p, n in sizes:
        offsets.append((p, ahead))
        ahead += n
    offset = F.create_map(*[F.lit(x) for pair in offsets for x in pair])[part] if offsets else F.lit(0)
    return made.withColumn(name, (offset + F.col("__id").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__id")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_broadsheet_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="broadsheet-code-")) / "broadsheet.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._broadsheet_shipped = True


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)
