"""Order, payment and delivery status decisions and failure classes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import has_text

OK = "ok"
NO_PLATFORM_ID = "no_platform_id"
UNKNOWN_STATUS = "unknown_status"


def lookup(key: Column, pairs: dict[str, str]) -> Column:
    """Value of a literal map, NULL for other keys and for a NULL key."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(literal, F.coalesce(key, F.lit("")))


def order_status(state: Column) -> Column:
    return lookup(state, fixed.ORDER_STATUS)


def payment_status(state: Column, paid_at: Column) -> Column:
    """Paid orders are completed unless cancelled; unpaid ones only when finished."""
    paid = F.when(state == fixed.CANCELLED, "refunded").otherwise("completed")
    unpaid = F.when(state == fixed.FINISHED, "completed").otherwise("pending")
    return F.when(has_text(paid_at), paid).otherwise(unpaid)


def delivery_status(state: Column, shipped_at: Column) -> Column:
    cancelled = F.when(has_text(shipped_at), "returned").otherwise("pending")
    return F.when(state == fixed.CANCELLED, cancelled).otherwise(
        lookup(state, fixed.DELIVERY_STATUS)
    )


def _outcome(*checks: tuple[Column, str]) -> Column:
    """The first failed check's name, else ok."""
    outcome = F
    for failed, name in checks:
        outcome = outcome.when(failed, name)
    return outcome.otherwise(OK)


def decide_statuses(orders: DataFrame) -> DataFrame:
    """Three decisions per order in one pass: value and outcome of each.

    An unknown order state is found before a missing platform id, while payment and
    delivery look at the platform id first.
    """
    state = F.col("order_status")
    no_id = ~has_text(F.col("platform_order_id"))
    order = order_status(state)
    delivery = delivery_status(state, F.col("shipped_at"))
    return orders.withColumns(
        {
            "order_to": order,
            "order_outcome": _outcome((order.isNull(), UNKNOWN_STATUS), (no_id, NO_PLATFORM_ID)),
            "payment_to": payment_status(state, F.col("paid_at")),
            "payment_outcome": _outcome((no_id, NO_PLATFORM_ID)),
            "delivery_to": delivery,
            "delivery_outcome": _outcome(
                (no_id, NO_PLATFORM_ID), (delivery.isNull(), UNKNOWN_STATUS)
            ),
        }
    )


def status_changes(decided: DataFrame) -> DataFrame:
    """One row per decision, ``seq`` 1 to 3: order, payment, delivery."""
    rows = [
        F.struct(
            F.lit(seq).alias("seq"),
            F.lit(path).alias("path_template"),
            F.col(f"{kind}_to").alias("status"),
            F.col(f"{kind}_outcome").alias("outcome"),
        )
        for seq, (kind, path) in enumerate(
            {
                "order": fixed.ORDER_STATUS_PATH,
                "payment": fixed.PAYMENT_STATUS_PATH,
                "delivery": fixed.DELIVERY_STATUS_PATH,
            }.items(),
            start=1,
        )
    ]
    return decided.select("order_uid", "platform_order_id", F.inline(F.array(*rows)))


def failure_class(http_status: Column) -> Column:
    """Responses by kind: fine, refused for their content, or failed otherwise."""
    return (
        F.when(http_status.between(200, 299), "success")
        .when(http_status == fixed.UNPROCESSABLE, "unprocessable")
        .otherwise("error")
    )


def outcome_summary(responses: DataFrame) -> DataFrame:
    return responses.groupBy(failure_class(F.col("http_status")).alias("outcome")).agg(
        F.count("*").alias("n")
    )
