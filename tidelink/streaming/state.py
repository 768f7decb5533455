"""What a stateful stream still holds.

Append-mode streams give a session, segment, request or window once it can no
longer change.  The rest lies in the query's state; Spark's state reader shows
it as a table (``key``, ``value`` structs and the state partition), so nothing
that has arrived is out of reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def open_state(spark: SparkSession, checkpoint_dir: str, operator: int = 0, variable: str | None = None) -> DataFrame:
    """State rows of the last committed batch of a stopped or running stream.

    ``variable`` names one state variable of a ``transformWithState`` stream,
    e.g. ``waiting``, the messages that the watermark has not passed.
    """
    reader = spark.read.format("statestore").option("operatorId", operator)
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint_dir)
