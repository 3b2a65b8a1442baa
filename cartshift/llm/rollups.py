"""Token counts kept as additive totals by source, language and tokenizer version.

A store is a folder that only grows. A batch of changes is turned into signed rows (an old count taken
back, a new one put in), which are written with their sums into a folder of the attempt's own. One small
commit file that names this folder makes the batch count. A batch that has a commit is not applied again, and an
attempt without one is never read, so a rerun after any failure leaves the totals right.

    entries/<attempt>      doc_id, source, lang, version, sign, tokens
    totals/<attempt>       source, lang, version, docs, tokens
    commits/<number>.json  number, batch, attempt, kind

Commits are numbered. A batch is worked out against the commits that it has read and may only become the next one
after them: its file is put in place whole, and only if no other has that number. So of two batches at once one
fails, changes nothing, and is applied again against what the other left. A snapshot is a commit whose attempt holds the
counts that are live; readers begin with the last one, so reading does not grow with the history.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, stored

KEYS = ("source", "lang", "version")
COMMITS = "number long, batch string, attempt string, kind string"
BATCH, SNAPSHOT = "batch", "snapshot"


class Overtaken(RuntimeError):
    """Another batch was committed first; nothing was changed, apply again."""


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file with its whole content, unless there is one of that name: False then."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    place, draft = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = place.getFileSystem(conf).create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(place.toUri(), conf).rename(draft, place, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception):
            raise
        return False
    return True


class TokenRollup:
    """Totals in ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> DataFrame:
        folder = f"{self.path}/commits"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).option("pathGlobFilter", "*.json").json(folder)

    def state(self) -> tuple[int, list[str]]:
        """The last commit's number, and the attempts to read: the last snapshot's and those since."""
        commits = self.commits()
        last, begin = commits.agg(F.max("number"), F.max(F.when(F.col("kind") == SNAPSHOT, F.col("number")))).first()
        if last is None:
            return 0, []
        rows = commits.where(F.col("number") >= F.lit(begin or 0)).select("attempt").collect()  # since the snapshot
        return last, sorted(r["attempt"] for r in rows)

    def read(self, kind: str, schema: T.StructType, attempts: list[str]) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{a}" for a in attempts])

    @staticmethod
    def entry_schema(id_type: T.DataType) -> T.StructType:
        return T.StructType(
            [
                T.StructField("doc_id", id_type),
                *[T.StructField(k, T.StringType()) for k in KEYS],
                T.StructField("sign", T.IntegerType()),
                T.StructField("tokens", T.LongType()),
            ]
        )

    def live(self, id_type: T.DataType, attempts: list[str]) -> DataFrame:
        """The counts that hold: entries that were put in and not taken back."""
        return (
            self.read("entries", self.entry_schema(id_type), attempts)
            .groupBy("doc_id", *KEYS)
            .agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
            .where("n > 0")
            .drop("n")
        )

    def commit(self, after: int, kind: str, batch: str | None, entries: DataFrame) -> None:
        """Write ``entries`` with their sums, and make them the commit next to ``after``."""
        attempt = uuid.uuid4().hex
        folder = f"{self.path}/entries/{attempt}"
        entries.write.parquet(folder)
        written = self.spark.read.schema(entries.schema).parquet(folder)
        written.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        ).write.parquet(f"{self.path}/totals/{attempt}")
        row = {"number": after + 1, "batch": batch, "attempt": attempt, "kind": kind}
        if not put_once(self.spark, f"{self.path}/commits/{after + 1:012}.json", json.dumps(row)):
            raise Overtaken(f"commit {after + 1} is taken")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before, :class:`Overtaken` if another one came first.

        ``changes``: ``op``, ``doc_id``, ``source``, ``lang``, ``version``, ``tokens`` and ``seq``. ``insert`` and
        ``revise`` put a document's count under its version, in place of one that holds; ``delete`` takes back what
        holds under the version, or under all versions if it is null, those put in by the same batch before it
        included. Of several changes of a document and version in a batch the last by ``seq`` holds (of equal ones the
        largest row); changes with another ``op``, without an id or without a count to put in are left out. Null
        sources and languages are groups of their own; other columns are ignored. An empty batch is committed and
        changes nothing.
        """
        after, attempts = self.state()
        if not self.commits().where((F.col("kind") == BATCH) & (F.col("batch") == batch)).isEmpty():
            return False
        id_type = changes.schema["doc_id"].dataType
        given = changes.select("op", "doc_id", *KEYS, "tokens", "seq").where(
            "doc_id is not null and (op = 'delete' or (op in ('insert', 'revise') and tokens is not null and version is not null))"
        )
        live = self.live(id_type, attempts).select(
            "doc_id", *[F.col(k).alias(f"old_{k}") for k in KEYS], F.col("tokens").alias("old_tokens")
        )
        named = given.where("version is not null")
        versions = live.select("doc_id", F.col("old_version").alias("any_version")).unionByName(
            named.select("doc_id", F.col("version").alias("any_version"))
        )
        everywhere = (
            given.where("version is null")
            .join(versions.distinct(), "doc_id")
            .withColumn("version", F.col("any_version"))
            .drop("any_version")
        )
        last = (
            named.unionByName(everywhere)
            .groupBy("doc_id", "version")
            .agg(F.max(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "op", "source", "lang", "tokens")).alias("c"))
            .select("doc_id", "version", "c.op", "c.source", "c.lang", "c.tokens")
        )
        old = last.select("doc_id", "version").join(
            live, (last["doc_id"] == live["doc_id"]) & (last["version"] == live["old_version"])
        )
        back = old.select(
            last["doc_id"], F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version",
            F.lit(-1).alias("sign"), F.col("old_tokens").alias("tokens"),
        )
        put = last.where("op != 'delete'").select(
            "doc_id", "source", "lang", "version", F.lit(1).alias("sign"), "tokens"
        )
        self.commit(after, BATCH, batch, back.unionByName(put))
        return True

    def compact(self, id_type: T.DataType) -> None:
        """Commit a snapshot of what is live; batches that are committed meanwhile make it :class:`Overtaken`."""
        after, attempts = self.state()
        live = self.live(id_type, attempts).select("doc_id", *KEYS, F.lit(1).alias("sign"), "tokens")
        self.commit(after, SNAPSHOT, None, live)

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``version``, ``n_docs``, ``n_tokens`` where documents are left."""
        schema = T.StructType(
            [*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())]
        )
        return (
            self.read("totals", schema, self.state()[1])
            .groupBy(*KEYS)
            .agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
            .where("n_docs > 0")
        )


# Two tokenizers as patterns: runs without white space; and runs of letters and digits or single others.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]"}


def more(pattern: str):
    return lambda n, line: n + F.regexp_count(line, F.lit(pattern))


def op6_token_rollup(spark, sf_dir: str) -> DataFrame:
    """All documents are counted under both versions; then those labelled toxic are deleted; then what is live is
    compacted and those of low quality are recounted without repeated lines; then the first two batches come once more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.array_distinct(F.split(text, "\n"))
    counted = stored(
        docs.select(
            "doc_id", "source", "lang",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(v).alias("version"),
                            F.regexp_count(text, F.lit(p)).cast("long").alias("tokens"),
                            F.aggregate(
                                lines, F.lit(0).cast("long"), more(p)
                            ).alias("fewer"),
                        )
                        for v, p in VERSIONS.items()
                    ]
                )
            ).alias("c"),
        ).select("doc_id", "source", "lang", "c.*")
    )
    nothing = F.lit(None).cast("string")
    inserts = counted.select(
        F.lit("insert").alias("op"), "doc_id", "source", "lang", "version", "tokens", F.lit(0).cast("long").alias("seq")
    )
    deletes = labels.where("toxic = 1").select(
        F.lit("delete").alias("op"), "doc_id", nothing.alias("source"), nothing.alias("lang"), nothing.alias("version"),
        F.lit(None).cast("long").alias("tokens"), F.lit(0).cast("long").alias("seq"),
    )
    low = labels.where("quality = 0 and toxic = 0").select("doc_id").distinct()
    revisions = counted.join(low, "doc_id").select(
        F.lit("revise").alias("op"), "doc_id", "source", "lang", "version", F.col("fewer").alias("tokens"),
        F.lit(0).cast("long").alias("seq"),
    )
    rollup = TokenRollup(spark, scratch(spark))
    for batch, changes in (("1", inserts), ("2", deletes), ("3", revisions), ("1", inserts), ("2", deletes)):
        if batch == "3":
            rollup.compact(docs.schema["doc_id"].dataType)
        rollup.apply(batch, changes)
    return rollup.totals()


OP6_SQL = r"""
with counted as (
  select doc_id, source, lang, version,
         len(regexp_extract_all(coalesce(text, ''), p))::bigint as tokens,
         coalesce(list_sum(list_transform(list_distinct(string_split(coalesce(text, ''), chr(10))),
                                          lambda l: len(regexp_extract_all(l, p)))), 0)::bigint as fewer
  from documents,
       (values ('words-1', '[^\x20\x09-\x0D]+'), ('pieces-1', '[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]')) v(version, p))
select source, lang, version, count(*)::bigint as n_docs,
       sum(case when doc_id in (select doc_id from labels where quality = 0 and toxic = 0) then fewer else tokens end)
         ::bigint as n_tokens
from counted
where doc_id not in (select doc_id from labels where toxic = 1)
group by source, lang, version
"""
