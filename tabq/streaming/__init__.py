"""Queries over streams.

The dialect has no operators for streams, but its projections, filters and plain aggregates are ordinary DataFrame plans,
so a registered streaming DataFrame can be queried like a table. What needs the order of rows (distinct, limits without
aggregates, inc(), columns outside aggregates) is for finite tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import Engine


def query_stream(engine: Engine, name: str, stream: DataFrame, text: str) -> DataFrame:
    """The streaming DataFrame of a query that reads ``stream`` as table ``name``."""
    if not stream.isStreaming:
        raise ValueError(f"{name!r} is not a stream")
    engine.register(name, stream)
    return engine.sql(text)
