"""Requests as rows. The engine plans the calls; an external sender makes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartshift import fixed_values as fixed
from cartshift.functions.coercion import canonical
from cartshift.operators.status import OK

OUTBOX_COLUMNS = (
    "request_id", "entity", "entity_id", "seq", "method", "path", "body_json", "phase"
)


def path_for(template: str | Column, entity_id: Column) -> Column:
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(template, F.lit("{}"), entity_id)


def requests(
    rows: DataFrame,
    entity: str,
    entity_id: str,
    method: str,
    path: str | Column,
    body: Column,
    seq: Column | None = None,
    phase: str | None = None,
    content: Column | None = None,
) -> DataFrame:
    """Outbox rows. The id is a digest of method, path and content (``seq`` and body unless ``content`` is
    given), so a sender that drops ids it has sent may be given a request again; a corrected body is another one."""
    own = canonical(F.col("seq"), F.col("body_json")) if content is None else F.col("content")
    built = rows.select(
        F.lit(entity).alias("entity"),
        F.col(entity_id).cast("string").alias("entity_id"),
        (F.lit(1) if seq is None else seq).cast("int").alias("seq"),
        F.lit(method).alias("method"),
        path_for(path, F.col(entity_id).cast("string")).alias("path"),
        body.alias("body_json"),
        F.lit(phase).cast("string").alias("phase"),
        (F.lit(None).cast("string") if content is None else content).alias("content"),
    )
    digest = F.sha2(canonical(*map(F.col, ("entity", "entity_id", "method", "path")), own), 256)
    return built.withColumn("request_id", digest).select(*OUTBOX_COLUMNS)


def create_order_requests(documents: DataFrame, phase: str | None = None) -> DataFrame:
    """One request per order. The body of a very long order stands in several rows of one
    ``request_id``: the texts in the order of ``seq`` are one JSON document."""
    return requests(
        documents,
        "order",
        "order_uid",
        "POST",
        fixed.CREATE_ORDER_PATH,
        F.col("body_text"),
        seq=F.col("piece"),
        phase=phase,
        content=F.col("facts"),
    )


def whole_order_requests(documents: DataFrame, phase: str | None = None) -> DataFrame:
    """:func:`create_order_requests` with one row and one text per order. Only bodies that stand in several pieces are
    gathered; all others are whole where they were made, and are not shuffled again."""
    single = create_order_requests(documents.where("pieces = 1"), phase)
    several = create_order_requests(documents.where("pieces > 1"), phase)
    return single.unionByName(whole_bodies(several))


def whole_bodies(pieces: DataFrame) -> DataFrame:
    """Requests with their bodies in one text each, as the sender needs them; ``seq`` is 1."""
    rest = [c for c in OUTBOX_COLUMNS if c not in ("seq", "body_json")]
    texts = F.sort_array(F.collect_list(F.struct("seq", "body_json")))
    return pieces.groupBy(*rest).agg(
        F.lit(1).alias("seq"), F.array_join(texts["body_json"], "").alias("body_json")
    ).select(*OUTBOX_COLUMNS)


def status_requests(changes: DataFrame, phase: str | None = None) -> DataFrame:
    return requests(
        changes.where(F.col("outcome") == OK),
        "order",
        "platform_order_id",
        "PATCH",
        F.col("path_template"),
        F.to_json(F.struct("status")),
        seq=F.col("seq"),
        phase=phase,
    )


def points_requests(plan: DataFrame, phase: str | None = None) -> DataFrame:
    """Adjust points by the difference, without notices."""
    body = F.struct(
        F.col("point_diff").alias("value"),
        F.lit(fixed.POINTS_REMARK).alias("remarks"),
        F.lit(fixed.DO_NOT_NOTIFY).alias("email_target"),
        F.lit(fixed.DO_NOT_NOTIFY).alias("sms_notification_target"),
    )
    changed = plan.where(F.col("outcome") == "change")
    return requests(
        changed, "customer", "customer_id", "POST", fixed.POINTS_PATH, F.to_json(body), phase=phase
    )


def credits_requests(plan: DataFrame, enabled: bool = False) -> DataFrame:
    """Adjust store credits; off by default because the platform notifies customers."""
    body = F.struct(
        F.col("credit_diff").alias("value"), F.lit(fixed.CREDITS_REMARK).alias("remarks")
    )
    changed = plan.where(F.lit(enabled) & (F.col("credit_diff") != 0))
    return requests(
        changed, "customer", "customer_id", "POST", fixed.CREDITS_PATH, F.to_json(body)
    )


def tag_requests(plan: DataFrame) -> DataFrame:
    body = F.struct("tags", F.lit(fixed.TAG_MODE).alias("update_mode"))
    return requests(
        plan.where(F.col("outcome") == OK),
        "customer",
        "customer_id",
        "PATCH",
        fixed.TAGS_PATH,
        F.to_json(body),
    )


def purge_requests(customers: DataFrame, after_id, enabled: bool = False) -> DataFrame:
    """Delete the test store's customers above an id; off by default."""
    chosen = customers.where(F.lit(enabled) & (F.col("customer_id") > F.lit(after_id)))
    return requests(
        chosen,
        "customer",
        "customer_id",
        "DELETE",
        fixed.CUSTOMER_PATH,
        F.lit(None).cast("string"),
    )


def cancel_requests(orders: DataFrame, enabled: bool = False) -> DataFrame:
    """Cancel orders of the test store; off by default."""
    reason = F.struct(
        F.lit(fixed.CANCEL_REASON_KEY).alias("key"),
        F.lit(fixed.CANCEL_REASON_TEXT).alias("message"),
    )
    body = F.struct(
        F.col("platform_order_id").cast("string").alias("order_id"),
        reason.alias("cancelled_reason"),
    )
    return requests(
        orders.where(F.lit(enabled)),
        "order",
        "platform_order_id",
        "PATCH",
        fixed.CANCEL_ORDER_PATH,
        F.to_json(body),
    )
