"""Events and the result of each call as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_rows(df: DataFrame, envelope: str, keep: list[str]) -> DataFrame:
    """(keep..., kind, payload): one row of kind ``event`` for each event and one of kind ``result`` for each call."""
    rows = F.concat(F.transform(F.col(envelope)["events"], lambda e: F.struct(F.lit("event").alias("kind"), e["payload"].alias("payload"))), F.array(F.struct(F.lit("result").alias("kind"), F.to_json(F.struct(F.col(envelope)["value"].alias("value"))).alias("payload"))))
    return df.select(*keep, F.explode(rows).alias("_row")).select(*keep, "_row.kind", "_row.payload")
