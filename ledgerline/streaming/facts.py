"""An addition of ours: the batch operators over streams. The engine's semantics are those of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.facts import routed
from ledgerline.operators.health import FLOATS


def route_stream(facts: DataFrame, path: str, checkpoint: str, thresholds: dict[str, float] | None = None) -> StreamingQuery:
    """Facts as they come, written by route; each micro-batch replaces its own files, so a replay doubles nothing."""

    def batch(df: DataFrame, epoch: int) -> None:
        routed(df, thresholds).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "route").parquet(path)

    return facts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(facts: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean confidence and hallucination rate per city and window of event time, late rows up to the watermark."""
    df = facts.withWatermark("ts", late).groupBy(F.window("ts", width), "jurisdiction")
    return df.agg(F.count("*").alias("facts"), F.avg("confidence").alias("mean_confidence"), F.avg(F.when(F.col("verified"), 0.0).otherwise(1.0)).alias("hallucination_rate"))


_BASE = "jurisdiction string, run_id string, runs long, " + ", ".join(f"base_{c} double" for c in FLOATS)


def trailing_stream(runs: DataFrame) -> DataFrame:
    """Each run beside the means of all earlier runs of its city; state is a count and a sum per metric and city."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *sums = state.get if state.exists else (0, *[0.0] * len(FLOATS))
        rows = []
        for run in pd.concat(list(batches)).sort_values("generated_at").to_dict("records"):
            rows.append((*key, run["run_id"], n, *[s / n if n else None for s in sums]))
            n, sums = n + 1, [s + (run[c] or 0.0) for s, c in zip(sums, FLOATS)]
        state.update((n, *sums))
        yield pd.DataFrame(rows, columns=["jurisdiction", "run_id", "runs", *[f"base_{c}" for c in FLOATS]])

    schema = "n long, " + ", ".join(f"s_{c} double" for c in FLOATS)
    return runs.groupBy("jurisdiction").applyInPandasWithState(step, _BASE, schema, "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(lambda df, _: work(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
