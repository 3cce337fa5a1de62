"""The cleaning steps over a stream of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import normalize_text
from ..operators.clean import within_limits


def clean_stream(pairs: DataFrame, event_time: str = "loaded_at", late: str = "1 hour") -> DataFrame:
    """Pairs within the limits, one for each normalised source within the watermark ``late`` of ``event_time``.

    The state holds the sources of that time only; which of two copies comes
    first is the stream's order.
    """
    p = within_limits(pairs.withWatermark(event_time, late))
    return p.withColumn("norm", normalize_text("src")).dropDuplicatesWithinWatermark(["norm"])
