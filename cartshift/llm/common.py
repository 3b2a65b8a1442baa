"""What the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the text contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share.

    Only a session with a local master and without that setting gets a folder of its own,
    which is set as the session's and removed at the end of the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application."""
    package = Path(__file__).resolve().parents[1]
    name = f"{package.name}-code.zip"
    context = spark.sparkContext
    if any(f.endswith(f"/{name}") for f in context.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="code-")  # on the driver, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{name}", "w") as code:
        for file in sorted(package.rglob("*.py")):
            code.write(file, file.relative_to(package.parent))
    context.addPyFile(f"{folder}/{name}")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    Cuts the lineage, so a lost executor costs a reread and no more, and nothing
    above the cut is computed twice.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_digest(df: DataFrame) -> Column:
    """A digest of all columns; with the id it names a row where ids repeat or are null."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else left alone."""
    return F.translate(text, UPPER, UPPER.lower())


def strip_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """The runs of other characters than white space, as an array (null: empty)."""
    bare = strip_spaces(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that each node of ``edges`` can reach.

    Alternates the large-star and the small-star step, which hook all larger (all smaller)
    neighbours of a node to the smallest one, until the edges stay the same; that takes a
    number of rounds that grows with the logarithm of the size. Each round is written to the
    shared folder. Nodes without an edge to another node are not returned.
    """
    links = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u != v")
        .distinct()
    )
    before = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        links = stored(small)
        now = links.agg(
            F.count("*"),
            F.countDistinct("u"),
            F.sum(F.col("u").cast("decimal(38,0)")),
            F.sum(F.col("v").cast("decimal(38,0)")),
        ).first()
        if now[0] == now[1] and now == before:
            break
        before = now
    star = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionAll(star.select(F.col("component").alias("node"), "component").distinct())
