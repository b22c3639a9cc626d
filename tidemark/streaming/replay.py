"""Structured Streaming: a log folded batch by batch into a table, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import apply_changes, net_change
from ..sources.state import State, advance


def exactly_once(apply: Callable[[DataFrame, int], None], ledger: State, consumer: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves out batches the ledger has: apply
    runs, then the position moves, so a crash between repeats the same batch;
    apply must replace what it wrote for that batch (as :func:`replayer` does)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        seen = ledger.load().where(F.col("consumer") == consumer).select("last_tick").first()
        if seen is None or seen["last_tick"] < batch_id + 1:
            apply(batch, batch_id)
            advance(ledger, consumer, batch_id + 1)

    return run


def replayer(table: State, key: list[str], payload: list[str], order: str = "ev_id") -> Callable[[DataFrame, int], None]:
    """Folds a batch of changes (op, order, key, payload) into a versioned table.
    Folding a batch twice gives what folding it once does."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.save(apply_changes(table.load(), net_change(batch, key, payload, order), key, payload))
        table.prune()

    return run


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per window and type; what is later than the watermark is left out."""
    return events.withWatermark("ev_time", late).groupBy(F.window("ev_time", width).alias("w"), "ev_type").agg(F.count("*").alias("n"))


def per_batch(expressions: dict[str, str], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands SQL expressions over each event to a sink."""
    from ..operators.handlers import per_event

    return lambda batch, batch_id: sink(per_event(batch, expressions), batch_id)
