"""Comparing the two stores' customers and planning what to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import has_text
from cartshift.operators.grouping import attach, duplicate_report, join_side
from cartshift.operators.status import NO_PLATFORM_ID, OK


def full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer equi join in three parts: matched, left only, right only.

    AQE can split a hot key in an inner and in an anti join but not in a full outer
    one, and filters reach each side's scan. NULL keys match nothing, so the anti joins
    keep them; AQE splits the partition they meet in like that of any other hot key.
    """

    def unmatched(rows: DataFrame, others: DataFrame) -> DataFrame:
        others = others.select(key).where(F.col(key).isNotNull()).distinct()
        return rows.join(join_side(others), key, "left_anti")

    return (
        left.join(right, key)
        .unionByName(unmatched(left, right), allowMissingColumns=True)
        .unionByName(unmatched(right, left), allowMissingColumns=True)
    )


def _legacy_side(customers: DataFrame, key: Column, *columns: str) -> DataFrame:
    renamed = {"name": "full_name", "credits": "legacy_credits", "points": "legacy_points"}
    return customers.select(
        key.alias("email_key"),
        *[F.col(c).alias(renamed.get(c, c)) for c in ("name", "email", *columns)],
    )


def _platform_side(customers: DataFrame, key: Column, *columns: str) -> DataFrame:
    return customers.select(
        key.alias("email_key"),
        "customer_id",
        *[F.col(c).alias(f"platform_{c}") for c in columns],
    )


POINTS_COLUMNS = (
    "customer_id",
    "full_name",
    "email",
    "platform_credits",
    "platform_points",
    "legacy_credits",
    "legacy_points",
)


def any_balance() -> Column:
    """A non-zero credit or point on either side; NULLs alone do not count."""
    sides = [F.col(c) != 0 for c in POINTS_COLUMNS[3:]]
    return sides[0] | sides[1] | sides[2] | sides[3]


def points_recon(legacy: DataFrame, platform: DataFrame, how: str = "full") -> DataFrame:
    """Both stores' credits and points side by side, where there are any.

    ``full`` (the final version) matches lower-cased e-mails; ``inner`` and ``left``
    are the earlier versions and match them as written.
    """
    key = F.lower("email") if how == "full" else F.col("email")
    left = _legacy_side(legacy, key, "credits", "points")
    right = _platform_side(platform, key, "credits", "points")
    if how == "full":
        joined = full_join(left, right, "email_key")
    elif how == "left":
        joined = attach(left, right, "email_key")
    else:
        joined = left.join(right, "email_key")
    return joined.where(any_balance()).select(*POINTS_COLUMNS)


def tag_recon(
    legacy: DataFrame, platform: DataFrame, standard_tier: str = fixed.STANDARD_TIER
) -> DataFrame:
    """Customers of other than the standard tier, with their platform id if known.

    The tier test drops the right-only rows, so that part of the join vanishes.
    """
    key = F.lower("email")
    joined = full_join(
        _legacy_side(legacy, key, "tier"), _platform_side(platform, key), "email_key"
    )
    special = joined.where(F.col("tier") != standard_tier)
    return special.select("customer_id", "full_name", "email", "tier")


# --- snapshots and resolution --------------------------------------------------


def latest_balances(snapshot: DataFrame, *tie_break: str) -> DataFrame:
    """The newest balance per customer of ``(customer_id, balance, fetched_at)``.

    Equal times fall to the larger ``tie_break``, at last to the larger balance.
    """
    newest = F.max_by("balance", F.struct("fetched_at", *tie_break, "balance")).alias("balance")
    return snapshot.groupBy("customer_id").agg(newest)


def resolve_hits(wanted: DataFrame, hits: DataFrame, key: str, found: str) -> DataFrame:
    """Search results per key: exactly one hit is the answer, more need a person."""
    counted = hits.groupBy(key).agg(F.count(found).alias("n_hits"), F.min(found).alias("hit"))
    n = F.coalesce(F.col("n_hits"), F.lit(0).cast("bigint"))
    return attach(wanted.select(key).distinct(), counted, key).select(
        key,
        n.alias("n_hits"),
        F.when(n == 0, "not_found").when(n == 1, "matched").otherwise("ambiguous").alias("outcome"),
        F.when(n == 1, F.col("hit")).alias(found),
    )


def latest_hits(searches: DataFrame, key: str) -> DataFrame:
    """The hits of each key's last search. ``searches`` has ``searched_at`` and a row per hit; a search that found
    nothing is a row without one, and so takes the place of an earlier one that did."""
    last = searches.groupBy(key).agg(F.max("searched_at").alias("searched_at"))
    same = ["searched_at", key]
    return searches.join(join_side(last), same).select(*searches.columns)


def resolve_as_of(
    wanted: DataFrame, searches: DataFrame, recorded: DataFrame, key: str, found: str
) -> DataFrame:
    """:func:`resolve_hits` of each key's last search, held against what is recorded.

    ``recorded`` has ``key``, ``value`` and ``ts``, a row per key: ids that the ledger holds as of ``ts``. A search that is not
    later than the record knows less than it: the key is ``recorded`` with that id, whatever was found. A later
    search settles a key anew; its outcome counts, and ``searched_at`` is the time from which it does.
    """
    newest = latest_hits(searches, key)
    times = newest.groupBy(key).agg(F.max("searched_at").alias("searched_at"))
    resolved = attach(resolve_hits(wanted, newest, key, found), times, key)
    known = recorded.select(key, F.col("value").alias("known"), F.col("ts").alias("known_at"))
    older = F.col("known_at").isNotNull() & F.coalesce(F.col("searched_at") <= F.col("known_at"), F.lit(True))
    return attach(resolved, known, key).select(
        key,
        F.when(older, F.lit(None)).otherwise(F.col("n_hits")).alias("n_hits"),
        F.when(older, "recorded").otherwise(F.col("outcome")).alias("outcome"),
        F.when(older, F.col("known")).otherwise(F.col(found)).alias(found),
        F.when(older, F.col("known_at")).otherwise(F.col("searched_at")).alias("as_of"),
    )


def found_balances(wanted: DataFrame, hits: DataFrame, key: str, found_at: Column) -> DataFrame:
    """Snapshot rows of customers found by exactly one hit.

    ``hits`` are search results with ``customer_id`` and ``balance``; the rows returned
    are to be appended to the balance snapshot.
    """
    resolved = resolve_hits(wanted, hits, key, "customer_id")
    known = resolved.where(F.col("outcome") == "matched").select(key, "customer_id")
    return known.join(hits, [key, "customer_id"]).select(
        "customer_id", "balance", found_at.alias("fetched_at")
    )


def one_row_each(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """How many rows answer each id: ``ok``, ``missing`` or ``duplicate``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    n = F.coalesce(F.col("n_rows"), F.lit(0).cast("bigint"))
    outcome = F.when(n == 0, "missing").when(n == 1, OK).otherwise("duplicate")
    return attach(ids, counts, key).withColumn("n_rows", n).withColumn("outcome", outcome)


# --- points --------------------------------------------------------------------


def points_plan(recon: DataFrame, balances: DataFrame, below_id: str | None = None) -> DataFrame:
    """What to do about each reconciled customer, as ``outcome``.

    ``change`` rows become requests, ``no_diff`` rows are settled, all others are
    rejects: no platform id, several rows for one id, or no current balance.
    """
    if below_id is not None:
        recon = recon.where(F.col("customer_id") < F.lit(below_id))
    with_id = recon.where(F.col("customer_id").isNotNull())
    repeated = duplicate_report(with_id, "customer_id").select("customer_id", "n")
    current = balances.select("customer_id", "balance")
    known = attach(attach(recon, repeated, "customer_id"), current, "customer_id")
    diff = F.coalesce(F.col("legacy_points"), F.lit(0)) - F.col("balance")
    outcome = (
        F.when(F.col("customer_id").isNull(), NO_PLATFORM_ID)
        .when(F.col("n").isNotNull(), "duplicate")
        .when(F.col("balance").isNull(), "no_balance")
        .when(F.col("point_diff") == 0, "no_diff")
        .otherwise("change")
    )
    return (
        known.withColumn("point_diff", diff)
        .withColumn("outcome", outcome)
        .drop("n")
    )


def table_differences(rows: DataFrame) -> DataFrame:
    """Credit and point differences from one table's own columns."""
    return rows.withColumns(
        {
            "credit_diff": F.coalesce(F.col("legacy_credits"), F.lit(0))
            - F.coalesce(F.col("platform_credits"), F.lit(0)),
            "point_diff": F.coalesce(F.col("legacy_points"), F.lit(0))
            - F.coalesce(F.col("platform_points"), F.lit(0)),
        }
    )


def equal_or_false(a: Column, b: Column) -> Column:
    """Equality that is false, not NULL, when a side is missing."""
    return F.coalesce(a == b, F.lit(False))


def points_verdict(answered: DataFrame) -> DataFrame:
    """``status`` of each answered request from the balance the platform reports."""
    verdict = (
        F.when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "fail")
        .when(equal_or_false(F.col("point_balance"), F.col("legacy_points")), "success")
        .otherwise("wrong")
    )
    return answered.withColumn("status", verdict)


def points_audit(recon: DataFrame, balances: DataFrame) -> DataFrame:
    """``verified``: the current balance is the legacy one; anything missing is false."""
    known = attach(recon, balances.select("customer_id", "balance"), "customer_id")
    return known.withColumn(
        "verified", equal_or_false(F.col("balance"), F.col("legacy_points"))
    )


# --- tags ----------------------------------------------------------------------


def tag_plan(recon: DataFrame) -> DataFrame:
    """The tags to add; customers without a platform id are rejects."""
    outcome = F.when(has_text(F.col("customer_id")), OK).otherwise(NO_PLATFORM_ID)
    tag = F.concat(F.lit(fixed.TIER_TAG_PREFIX), F.col("tier"))
    return recon.withColumn("tags", F.array(tag)).withColumn("outcome", outcome)


def tag_verdict(answered: DataFrame) -> DataFrame:
    """Success if the platform answers with at least one tag."""
    tagged = F.coalesce(F.size("tags") > 0, F.lit(False))
    return answered.withColumn("status", F.when(tagged, "success").otherwise("fail"))
