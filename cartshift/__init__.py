"""Store migration and reconciliation as Spark DataFrame jobs."""

from cartshift.session import checkpointed, tune

__all__ = ["checkpointed", "tune"]
