"""The compacted ledger: the same values before, during and after, from fewer bytes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartshift.operators import ledger
from cartshift.sources.ledger_store import LedgerStore


@pytest.fixture
def store(spark, tmp_path):
    return LedgerStore(spark, str(tmp_path / "ledger"))


def entries(spark, at, n=400):
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "order").otherwise("customer").alias("entity"),
        (F.col("id") % 50).cast("string").alias("entity_id"),
        F.when(F.col("id") % 3 == 0, "a b/c").otherwise("x").alias("field"),
        F.concat(F.lit(f"{at}-"), F.col("id")).alias("value"),
        F.timestamp_seconds(F.lit(1000 * at) + F.col("id") % 7).alias("ts"),
    )


def newest(store):
    return sorted(map(tuple, ledger.latest(store.read()).collect()))


def size(store):
    base = Path(store.path) / "rows"
    return sum(f.stat().st_size for name in store.folders() for f in (base / f"batch={name}").rglob("*.parquet"))


def test_an_empty_store(store):
    assert store.read().collect() == [] and store.folders() == []
    store.compact()
    assert store.read().collect() == []


def test_same_values_before_and_after_compaction(spark, store):
    for at in range(5):
        store.append(entries(spark, at))
    before, bytes_before, rows = newest(store), size(store), store.read().count()
    store.compact()
    assert newest(store) == before and len(store.folders()) == 1
    assert store.read().count() < rows / 4 and size(store) < bytes_before / 3
    store.append(entries(spark, 9, 10))
    assert len(store.folders()) == 2 and newest(store) != before
    again = newest(store)
    store.compact()
    assert newest(store) == again and len(store.folders()) == 1


def test_a_compaction_that_dies_leaves_no_trace(spark, store, monkeypatch):
    for at in range(3):
        store.append(entries(spark, at))
    before, folders = newest(store), store.folders()
    monkeypatch.setattr(LedgerStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.compact()
    with pytest.raises(OSError):
        store.append(entries(spark, 8))
    assert newest(store) == before and store.folders() == folders


def test_appends_and_compactions_at_the_same_time(spark, store):
    store.append(entries(spark, 1))
    seen = store.folders()  # a compaction begins here
    store.append(entries(spark, 2, 30))
    store.compact()  # another one overtakes it
    store.append(entries(spark, 3, 20))
    want = newest(store)
    store._put(ledger.latest(store._rows(seen)), seen)
    assert newest(store) == want
    store.compact()
    assert newest(store) == want and len(store.folders()) == 1


def test_lookups_read_their_own_folders_only(spark, store):
    store.append(entries(spark, 1))
    store.compact()
    found = ledger.values_of(store.read(), "order", "x", "order_uid")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity" in plan and "order" in plan
    wanted = spark.range(60).select(F.col("id").cast("string").alias("order_uid"))
    assert ledger.pending(wanted, store.read(), "order", "x", "order_uid").count() == 60 - found.count()
