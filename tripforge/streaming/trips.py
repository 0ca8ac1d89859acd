"""The stateless stages over a stream of raw trips, with the same functions as in batch.

The published pipelines have no streams; this only shows that cleaning, features and the rule need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.trips import RULE, TripRule, clean_trips, filter_trips, trip_features


def filtered_stream(raw: DataFrame, rule: TripRule = RULE) -> DataFrame:
    return filter_trips(trip_features(clean_trips(raw)), rule)


def start(raw: DataFrame, path: str, checkpoint: str, rule: TripRule = RULE) -> StreamingQuery:
    """Append filtered trips to Parquet as files arrive, then stop."""
    return filtered_stream(raw, rule).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
