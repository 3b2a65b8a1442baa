"""Quality rules by host: failures per host, shrunk rates, verdicts joined back.

All steps are DataFrame functions. A document is rejected outright by the base rule, and by a
softer rule only where that rule, or the base rule, fails on its host so often that the host is not trusted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, row_digest, stored, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules.

    ``distrust`` is the shrunk failure rate from which a host's failing documents go.
    The prior's strength (its count of pseudo documents) stays within ``strength``; the lower end is what even
    hosts that differ much are held against, so a few documents alone never make a host bad.
    """

    min_words: int = 50
    repeat_percent: int = 50
    symbols_per_100_words: int = 10
    dup_line_percent: int = 30
    min_word_chars: int = 2
    max_word_chars: int = 15
    distrust: float = 0.5
    strength: tuple[float, float] = (10.0, 1e6)


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` and the counts of its whole text.

    A null text counts as empty. ``n_repeat_words`` is found within the row: equal window
    hashes are looked for in a hash set, and only texts that have some are sorted.
    """
    base = docs.select(
        *keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), words_of(F.col(text)).alias("_words")
    )
    lines = F.filter(
        F.split("_text", "\n"), lambda line: F.translate(line, SPACES, "") != ""
    )
    windows = F.when(
        F.size("_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(
                F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)
            ),
        ),
    )
    base = base.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")))
        .cast("long")
        .alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    base = base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            repeated,
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    twice = F.filter(
        "_sorted",
        lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]).eqNullSafe(True)
        | (F.get("_sorted", k + 1)["h"] == x["h"]).eqNullSafe(True),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            (p + 2).alias("last"), (acc["n"] + F.least(F.lit(3), p + 2 - acc["last"])).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def soft_failures(rules: HostRules) -> dict[str, Column]:
    """The rules whose failures are weighed by host. Texts without words fail none of them."""
    return {
        "symbols": F.expr(f"100 * n_symbols > {rules.symbols_per_100_words} * n_words"),
        "dup_lines": F.expr(f"100 * n_dup_lines > {rules.dup_line_percent} * n_lines"),
        "word_length": F.expr(
            f"word_chars < {rules.min_word_chars} * n_words"
            f" or word_chars > {rules.max_word_chars} * n_words"
        ),
    }


def strength_of(hosts: int, documents: float, squares: float, failures: float, spread: float, rules: HostRules) -> float:
    """The prior's count of pseudo documents, by moments of the beta-binomial distribution.

    With p the share of all documents that fail and w = n / N the hosts' shares of the documents, the hosts' rates
    vary by S = sum of w (k / n - p)^2. Of that sampling alone explains p (1 - p) A, A = sum of w (1 - w) / n, and a
    correlation r within hosts adds r p (1 - p) (B - A), B = sum of w (1 - w). Solved for r, the strength is
    1 / r - 1. Hosts that vary no more than by sampling, or that cannot tell the two apart (one document each), give
    the greatest strength. ``squares`` is the sum of n^2, ``spread`` that of k^2 / n.
    """
    low, high = rules.strength
    p = failures / documents
    within = p * (1 - p)
    by_sampling, by_hosts = (hosts - 1) / documents, 1 - squares / documents**2
    if not within or by_hosts - by_sampling < 1e-12:
        return high
    correlation = (spread / documents - p * p - within * by_sampling) / (within * (by_hosts - by_sampling))
    return high if correlation <= 0 else max(low, min(high, 1 / correlation - 1))


def shrunk_rates(counts: DataFrame, names: list[str], rules: HostRules) -> DataFrame:
    """``counts`` (a row per host: ``n`` and failures ``k_<name>``) with ``rate_<name>``.

    The prior is a beta distribution with the mean m of all documents and the strength s of
    :func:`strength_of`. The rate is (k + m s) / (n + s).
    """
    n = F.col("n").cast("double")
    sums = counts.agg(
        F.count("*").alias("hosts"),
        F.sum(n).alias("n"),
        F.sum(n * n).alias("squares"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in names],
        *[F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / n).alias(f"spread_{r}") for r in names],
    ).first()  # a few numbers
    for r in names:
        m, s = 0.0, rules.strength[1]
        if sums["n"]:
            m = sums[f"k_{r}"] / sums["n"]
            s = strength_of(sums["hosts"], sums["n"], sums["squares"], sums[f"k_{r}"], sums[f"spread_{r}"], rules)
        counts = counts.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(m * s)) / (F.col("n") + F.lit(s)))
    return counts


def judge(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source", id_column: str = "doc_id",
          carry: tuple[str, ...] = ()) -> DataFrame:
    """Verdict per row of ``docs``: ``id_column``, ``host``, the counts, ``base_failed``, ``kept``.

    Rows are judged one by one, so repeated rows each get a row and nulls in the id do no
    harm; rows without a host form a host of their own. Other columns are ignored unless
    named in ``carry``. An empty table gives an empty result.

    The measures are stored once; hosts are summed map-side, and the host verdicts (one row per
    host) return by a join of narrow rows, in which a hot host is split by AQE.
    """
    soft = list(soft_failures(rules))
    names = ["base", *soft]
    keep = tuple(dict.fromkeys((id_column, host, *carry)))
    ids = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(keep)], F.col("text").alias("_in_text"))
    measured = measures(ids, "_in_text", tuple(f"_in_{i}" for i in range(len(keep))))
    measured = measured.withColumn(
        "base_failed",
        F.expr(
            f"n_words < {rules.min_words} or 100 * n_repeat_words > {rules.repeat_percent} * n_words"
        ),
    ).withColumns({f"soft_{r}": test for r, test in soft_failures(rules).items()})
    measured = stored(measured)
    host_column = f"_in_{keep.index(host)}"
    counts = measured.groupBy(F.col(host_column).alias("_host")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("base_failed").cast("long")).alias("k_base"),
        *[F.sum(F.col(f"soft_{r}").cast("long")).alias(f"k_{r}") for r in soft],
    )
    rates = shrunk_rates(counts, names, rules)
    verdicts = rates.select("_host", *[(F.col(f"rate_{r}") >= rules.distrust).alias(f"bad_{r}") for r in names])
    judged = measured.join(verdicts, F.col(host_column).eqNullSafe(F.col("_host")), "left")
    rejected = F.lit(False)
    for r in soft:
        rejected = rejected | (F.col(f"soft_{r}") & (F.col(f"bad_{r}") | F.col("bad_base")))
    return judged.select(
        *[F.col(f"_in_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def passing(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps."""
    given = docs.withColumn("_row", row_digest(docs))
    verdicts = judge(given, rules, carry=("_row",))
    rejected = verdicts.where("not kept").select(F.col("_row").alias("_gone")).distinct()
    return given.join(rejected, given["_row"] == rejected["_gone"], "left_anti").drop("_row")


def op9_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).drop("source")


OP9_SQL = r"""
with base as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
places as (
  select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from base)),
twice as (
  select doc_id, i from places qualify count(*) over (partition by doc_id, a, b, c) > 1),
covered as (
  select doc_id, count(distinct i + d) as n_repeat_words
  from twice, (values (0), (1), (2)) t(d) group by doc_id),
counted as (
  select base.doc_id, source, len(words)::bigint as n_words,
         list_sum(list_transform(words, lambda w: length(w)))::bigint as chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
         len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words
  from base left join covered using (doc_id)),
judged as (
  select doc_id, source, n_words, coalesce(chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         100 * n_symbols > 10 * n_words as f1, 100 * n_dup_lines > 30 * n_lines as f2,
         coalesce(chars, 0) < 2 * n_words or coalesce(chars, 0) > 15 * n_words as f3
  from counted),
failed as (
  select doc_id, source, rule, hit from (
    select doc_id, source, base_failed as f0, f1, f2, f3 from judged) unpivot (hit for rule in (f0, f1, f2, f3))),
hosts as (
  select source, rule, count(*)::double as n, count(*) filter (hit)::double as k from failed group by source, rule),
shares as (
  select *, sum(k) over r / sum(n) over r as p, n / sum(n) over r as w from hosts window r as (partition by rule)),
moments as (
  select rule, any_value(p) as p, sum(w * (k / n - p) ** 2) as s, sum(w * (1 - w) / n) as a, sum(w * (1 - w)) as b
  from shares group by rule),
prior as (
  select rule, p, case when p * (1 - p) = 0 or b - a < 1e-12 or s <= p * (1 - p) * a then 1e6
    else greatest(10, least(1e6, p * (1 - p) * (b - a) / (s - p * (1 - p) * a) - 1)) end as strength from moments),
verdicts as (
  select source, rule, (k + p * strength) / (n + strength) >= 0.5 as bad from hosts join prior using (rule)),
distrusted as (
  select source, bool_or(bad) filter (rule = 'f0') as b0, bool_or(bad) filter (rule = 'f1') as b1,
         bool_or(bad) filter (rule = 'f2') as b2, bool_or(bad) filter (rule = 'f3') as b3 from verdicts group by source)
select doc_id, n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not (f1 and (b0 or b1)) and not (f2 and (b0 or b2)) and not (f3 and (b0 or b3)) as kept
from judged join distrusted on judged.source is not distinct from distrusted.source
"""
