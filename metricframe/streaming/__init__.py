"""Models over streams: the verbs that need no state lower unchanged, aggregates take a watermark.

A connection's table may be a streaming DataFrame.  Picks, filters, to-one joins
with a static side and unions then give a streaming DataFrame from
``model.spark_df()``.  :func:`windowed_counts` and :func:`aggregate_stream` add the
watermark that lets Spark close the groups of an aggregate over truncated time.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql.streaming import StreamingQuery

    from metricframe.expressions import Expression
    from metricframe.model import Model


def aggregate_stream(model: Model, timestamp: str, delay: str, size: str, measures: dict[str, Expression]) -> DataFrame:
    """Measures of a streaming model in tumbling windows of its column ``timestamp``, late by ``delay`` at most."""
    from metricframe.plans.compile import Context, to_sql

    df = model.spark_df().withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, delay).alias("self")
    context = Context(view=lambda _: (_ for _ in ()).throw(ValueError("no subqueries in a stream's measures")))
    made = [F.expr(to_sql(model._one(e), context)).alias(name) for name, e in measures.items()]
    return df.groupBy(F.window(timestamp, size).alias("window")).agg(*made).select("window.start", "window.end", *measures)


def windowed_counts(model: Model, timestamp: str, delay: str, size: str) -> DataFrame:
    from metricframe import functions as func

    return aggregate_stream(model, timestamp, delay, size, {"count": func.count()})


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming result into the in-memory table ``name``, all that is available now."""
    return (
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    )
