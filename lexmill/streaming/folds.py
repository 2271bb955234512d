"""Streaming forms of the one-pass counters and the ordered validator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(stream: DataFrame, keys: list[str], measures: dict) -> DataFrame:
    """T5: foldable counters; the same expression on a batch or a stream (complete mode)."""
    return stream.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))


def windowed(stream: DataFrame, time: str, late: str, length: str, keys: list[str]) -> DataFrame:
    """Counts per tumbling window behind a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def order_breaks(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose order doesn't follow its predecessor's by one, with state per document.

    A micro-batch's numbers of one key are put in order first; between micro-batches order counts as they come.
    """
    import pandas as pd

    def step(k, parts, state):
        last = state.get[0] if state.exists else None
        # a key's chunks of one micro-batch come in no order
        values = sorted(v for part in parts for v in part[order].tolist())
        before = ([last] if last is not None else []) + values
        bad = [(k[0], a, b) for a, b in zip(before, before[1:]) if b != a + 1]  # noqa: B905
        if before:
            state.update((before[-1],))
        yield pd.DataFrame(bad, columns=[key, "previous", "found"])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, previous long, found long", "last long", "append", "NoTimeout")
