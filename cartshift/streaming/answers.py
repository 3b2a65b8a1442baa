"""Answers to requests, written back to the ledger as they arrive.

The legacy job wrote each outcome right after its call. Here the sender drops answer
files; a stream turns every answer into a ledger row once, and a restart goes on from
its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cartshift.sources.schemas import RESPONSES
from cartshift.sources.writers import append_ledger


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RESPONSES).json(folder)


def write_back(
    arriving: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    ledger_path: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Append ``judge(answers)``, ledger rows, to the ledger's files.

    ``judge`` is one of the ``record_`` flows; it needs no state, so a stored table
    joined inside it stays an ordinary stream-static join. With ``once`` the query
    ends when all files present are read.

    Each batch is appended like any other ledger rows, so what batch jobs write to the same
    folder stays visible. A batch that is written twice after a failure does no harm, as
    the ledger's latest value is a maximum.
    """
    writer = (
        judge(arriving)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda entries, _: append_ledger(entries, ledger_path))
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
