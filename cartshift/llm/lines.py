"""Line dedup: lines whose key stands in many documents leave every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored, strip_spaces


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(strip_spaces(line))


def line_hash(line: Column) -> Column:
    """The key's SHA-256 cut to 128 bits; null for keys of no code points, which are never dropped."""
    key = line_key(line)
    return F.when(key != "", F.substring(F.unhex(F.sha2(key, 256)), 1, 16))


def placed_lines(docs: DataFrame) -> DataFrame:
    """``(_doc, _text, _pos, _hash)`` for every line that has a key, stored; ``_text`` is a digest that tells rows of
    one id apart."""
    text = F.coalesce("text", F.lit(""))
    return stored(
        docs.select(
            F.col("doc_id").alias("_doc"),
            F.unhex(F.md5(text)).alias("_text"),
            F.posexplode(F.transform(F.split(text, "\n"), line_hash)).alias("_pos", "_hash"),
        ).where("_hash is not null")
    )


def frequent_lines(placed: DataFrame, min_docs: int) -> DataFrame:
    """``_hash`` of the lines found in ``min_docs`` documents.

    Lines are made distinct by document before they are counted, so a line's count is of documents, and counting
    combines map-side. Rows without an id are one document.
    """
    found = placed.select("_doc", "_hash").distinct()
    return found.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs).select("_hash")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; all columns stay.

    Null and empty texts are one empty line. Repeated rows are each answered; a column of
    ``docs`` that has the name of a result is replaced by it. Lines are hashed once. Only hashes and places are shuffled
    to find what goes; the texts move once, to meet the places that they lose, and are put together again from
    the places that stay, in time that is linear in the text.
    """
    given = docs.drop("n_lines", "n_dropped", "kept_text")
    placed = placed_lines(given)
    gone = (
        placed.join(stored(frequent_lines(placed, min_docs)), "_hash", "left_semi")  # both sides shuffled: AQE can split
        .select("_doc", "_text", "_pos")
        .distinct()
        .groupBy("_doc", "_text")
        .agg(F.collect_list("_pos").alias("_gone"))
    )
    text = F.coalesce("text", F.lit(""))
    same = given["doc_id"].eqNullSafe(gone["_doc"]) & (F.unhex(F.md5(text)) == gone["_text"])
    lines = F.split(text, "\n")
    joined = given.join(gone, same, "left").withColumn("_lines", lines)
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(
        F.transform(stays, lambda i: F.get("_lines", i))
    )
    return joined.select(
        *[given[c] for c in given.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP4_SQL = r"""
with lines as (
  select doc_id, i, lines[i] as line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
common as (
  select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint as n_lines,
       count(*) filter (key in (select key from common))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (key not in (select key from common)), ''))
         as kept_sha256
from lines group by doc_id
"""
