"""Mixing sources to target weights by Pareto order sampling.

Every document of a source first gets the whole copies that are certain. What the target still
lacks is drawn: document i asks for one more copy with inclusion chance p_i and is ranked by

    (u_i / (1 - u_i)) / (p_i / (1 - p_i)),      u_i uniform, from a digest of its id

smallest first. The sample's size is fixed in words: ranks are taken while they fit the budget, and
one last document, the one whose size is nearest to the words still missing, closes the gap.
p_i grows with the size s as s / (s + mean size), so fragments are repeated less often than texts
of usual length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_digest, stored

FEW_SOURCES = 20_000  # up to so many, rows about sources (some 100 bytes each) are broadcast; else joined by shuffles
BINS = 1024  # rank ranges per source; only the range that the budget ends in is sorted


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code point order; ``cap`` bounds the repeats."""

    weights: tuple[int, ...] = (5, 2, 1)
    cap: int = 3
    seed: str = "mix"


def source_targets(totals: DataFrame, mix: Mix) -> DataFrame:
    """``totals`` (``_source``, ``_size``, ``_docs``) with ``_target``.

    Sorted by size per weight, the sources that reach their cap are a prefix, so the reshared
    excess is one running sum. One row per source: a small table by nature, in one window.
    """
    by_name = Window.orderBy(F.asc_nulls_last("_source"))
    cycle = F.array(*[F.lit(w) for w in mix.weights])
    weighed = totals.withColumn(
        "_w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(mix.weights)).cast("long")
    ).withColumn("_cap", F.col("_size") * mix.cap)
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("_source"))
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = weighed.withColumns(
        {
            "_left": F.sum("_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_wsum": F.sum("_w").over(after),
        }
    ).withColumn("_capped", F.col("_cap") * F.col("_wsum") <= F.col("_w") * F.col("_left"))
    open_ = [F.when(~F.col("_capped"), F.col(c)) for c in ("_left", "_wsum")]
    share = F.col("_w") * F.max(open_[0]).over(everything) / F.max(open_[1]).over(everything)
    return weighed.select(
        "_source",
        "_size",
        "_docs",
        F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("_target"),
    )


def sampled(docs: DataFrame, mix: Mix = Mix(), size=None, row=None) -> DataFrame:
    """Every row of ``docs`` reduced to ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``copies`` and ``_row``, the value of the column expression ``row`` (null by default).

    ``size`` is a column expression; by default the number of words of ``text`` (null: 0). A null
    source is a source of its own, the last. Repeated rows and rows without an id are documents of
    their own; equal ranks fall to the smaller id. Other columns are ignored. The draw depends on the
    ids and the seed only, so reruns agree. An empty table gives an empty result, and a source
    without words the target 0.

    Sizes are stored once. A hot source is never gathered: its ranks are summed by range first,
    and only the range in which the budget ends is sorted.
    """
    if size is None:
        size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = stored(
        docs.select(
            F.col("doc_id").alias("_id"),
            F.col("source").alias("_source"),
            size.cast("long").alias("_s"),
            (F.lit(None).cast("long") if row is None else row).alias("_row"),
        )
    )
    totals = sized.groupBy("_source").agg(F.sum("_s").alias("_size"), F.count("*").alias("_docs"))
    targets = stored(source_targets(totals, mix))
    few = targets.count() <= FEW_SOURCES
    mean = F.greatest(F.lit(1), F.expr("_size div _docs"))
    targets = targets.withColumn("_mean", mean.cast("long")).withColumn(
        "_whole",
        F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("long"),
    )
    targets = targets.withColumn("_budget", F.col("_target") - F.col("_whole") * F.col("_size"))

    def with_source(rows, facts):
        facts = facts.withColumnRenamed("_source", "_of")
        facts = F.broadcast(facts) if few else facts  # a row per source at most
        return rows.join(facts, rows["_source"].eqNullSafe(facts["_of"]), "left").drop("_of")

    ranked = with_source(sized, targets).withColumn("_w", F.expr("(1000 * _s) div (_s + _mean)"))
    weights = ranked.groupBy("_source").agg(F.sum(F.col("_w") * F.col("_s")).alias("_ws"))
    digest = F.substring(F.md5(F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    p = F.least(F.lit(1.0), F.col("_budget") * F.col("_w") / F.col("_ws"))
    ranked = with_source(ranked, weights).withColumns({"_u": u, "_p": F.when(F.col("_ws") > 0, p)})
    # q / (1 + q) of the ranking variable q, in [0, 1): the same order, and ranges to sum by
    ranked = ranked.withColumn(
        "_rank",
        F.when(
            (F.col("_p") > 0) & (F.col("_budget") > 0),
            (F.col("_u") * (1 - F.col("_p")))
            / (F.col("_u") * (1 - F.col("_p")) + (1 - F.col("_u")) * F.col("_p")),
        ),
    ).drop("_u", "_p", "_ws", "_w", "_mean", "_docs")
    ranked = stored(ranked.withColumn("_bin", F.floor(F.col("_rank") * BINS).cast("int")))
    per_bin = ranked.where("_bin is not null").groupBy("_source", "_bin", "_budget").agg(F.sum("_s").alias("_sum"))
    running = Window.partitionBy("_source").orderBy("_bin")
    edge = (
        per_bin.withColumn("_end", F.sum("_sum").over(running))
        .where(F.col("_end") > F.col("_budget"))
        .groupBy("_source")
        .agg(F.min("_bin").alias("_edge"), F.min(F.col("_end") - F.col("_sum")).alias("_below"))
    )
    ranked = with_source(ranked, edge)
    inside = ranked.where((F.col("_bin") == F.col("_edge")).eqNullSafe(True))
    in_order = Window.partitionBy("_source").orderBy("_rank", "_id")
    upto = F.col("_below") + F.sum("_s").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_extra", upto <= F.col("_budget"))
    outside = ranked.where(~(F.col("_bin") == F.col("_edge")).eqNullSafe(True)).withColumn(
        "_extra",
        F.col("_bin").isNotNull() & F.coalesce(F.col("_bin") < F.col("_edge"), F.lit(True)),
    )
    drawn = inside.unionByName(outside)
    missing = drawn.groupBy("_source", "_budget").agg(
        F.coalesce(F.sum(F.when(F.col("_extra"), F.col("_s"))), F.lit(0)).alias("_got")
    )
    missing = missing.where("_budget > 0").select("_source", (F.col("_budget") - F.col("_got")).alias("_gap"))
    drawn = with_source(drawn, missing)
    waiting = (~F.col("_extra")) & F.col("_rank").isNotNull() & (F.abs(F.col("_gap") - F.col("_s")) < F.col("_gap"))
    last = (
        drawn.where(waiting)
        .groupBy("_source")
        .agg(F.min(F.struct(F.abs(F.col("_gap") - F.col("_s")), "_rank", "_id", "_s")).alias("_last"))
    )
    drawn = with_source(drawn, last)
    closes = waiting & F.col("_last").isNotNull() & (F.col("_rank") == F.col("_last._rank")) & F.col("_id").eqNullSafe(F.col("_last._id")) & (F.col("_s") == F.col("_last._s"))
    drawn = drawn.withColumn("_closes", F.coalesce(closes, F.lit(False)))
    # of repeated rows only one closes the gap
    closing = drawn.where("_closes").withColumn(
        "_extra", F.row_number().over(Window.partitionBy("_source").orderBy("_rank")) == 1
    )
    drawn = drawn.where("not _closes").unionByName(closing)
    return drawn.select(
        F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_s").alias("size"),
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") + F.col("_extra").cast("long")).alias("copies"),
        "_row",
    )


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; those it does not take are left out."""
    given = docs.withColumn("_row", row_digest(docs))
    times = (
        sampled(given, mix, row=F.col("_row"))
        .groupBy(F.col("_row").alias("_of"))
        .agg(F.sum("copies").cast("int").alias("_times"))
        .where("_times > 0")
    )
    once = given.dropDuplicates(["_row"])
    return (
        once.join(times, once["_row"] == times["_of"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
        .select(*[once[c] for c in docs.columns])
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sampled(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP2_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as s
  from documents),
totals as (
  select source, sum(s)::bigint as size, count(*) as docs,
         [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from sized group by source),
need as (
  select *, 3 * size as cap, (sum(size) over ())::bigint
           - coalesce(sum(3 * size) over (order by 3 * size / w, source nulls last
                                          rows between unbounded preceding and 1 preceding), 0)::bigint as left_over,
         (sum(w) over (order by 3 * size / w, source nulls last
                       rows between current row and unbounded following))::bigint as wsum
  from totals),
capped as (select *, cap * wsum <= w * left_over as at_cap from need),
targets as (
  select source, size, docs, case when at_cap then cap::double else
           (w * max(left_over) filter (not at_cap) over ()) / (max(wsum) filter (not at_cap) over ()) end as target
  from capped),
wholes as (
  select *, case when size > 0 then floor(target / size) else 0 end::bigint as whole,
         greatest(1, case when docs > 0 then size // docs end)::bigint as mean from targets),
weighed as (
  select doc_id, s, t.*, target - whole * size as budget, (1000 * s) // (s + mean) as w,
         (('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from sized join wholes t on sized.source is not distinct from t.source),
chances as (
  select *, least(1.0, budget * w / sum(w * s) over (partition by source)::bigint) as p from weighed),
ranked as (
  select *, case when p > 0 and budget > 0 then (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) end as rank from chances),
run as (
  select *, rank is not null and
         sum(case when rank is not null then s else 0 end) over (partition by source order by rank nulls last, doc_id
             rows between unbounded preceding and current row) <= budget as extra from ranked),
gaps as (
  select *, budget - coalesce(sum(s) filter (extra) over (partition by source), 0)::bigint as gap from run),
closing as (
  select doc_id from gaps where budget > 0 and not extra and rank is not null and abs(gap - s) < gap
  qualify row_number() over (partition by source order by abs(gap - s), rank, doc_id) = 1)
select doc_id, s as size, size as source_size, target,
       ((whole + (extra or doc_id in (select doc_id from closing))::bigint) * s)::bigint as taken
from gaps
"""
