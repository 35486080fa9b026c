"""Incremental and stateful processing: resume by id, available-now waves, reservations with a time limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import in_order


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Runs ``each`` on every micro-batch of what is there now and returns how many there were. A second call sees only new files."""
    seen = [0]

    def step(batch: DataFrame, number: int) -> None:
        seen[0] += 1
        each(batch, number)

    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
    q.awaitTermination()
    return seen[0]


def once_per_id(stream: DataFrame, key: str, time: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each id, for good; with ``late``, ids are remembered only as long as rows may be late by ``time``."""
    if late is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drain_counted(stream: DataFrame, reason, each: Callable[[DataFrame, int], None], checkpoint: str, most: float = 0.25) -> list[dict]:
    """:func:`drain` with counts: of every wave its number, rows, rejected rows (``reason`` not null) and whether the rejected are
    more than the share ``most``."""
    waves: list[dict] = []

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        r = batch.agg(F.count(F.lit(1)).alias("n"), F.count(reason).alias("rejected")).first()
        waves.append({"wave": number, "rows": r["n"], "rejected": r["rejected"], "warning": r["n"] > 0 and r["rejected"] > most * r["n"]})
        each(batch, number)
        batch.unpersist()

    drain(stream, step, checkpoint)
    return waves


def follow(start: Callable[[], DataFrame], each: Callable[[DataFrame, int], None], checkpoint: str, done: Callable[[], bool], pause: float = 1.0) -> int:
    """Drains a source again and again until ``done`` says its writer has finished, and once more after that; returns the waves."""
    import time

    waves = 0
    while True:
        last = done()
        waves += drain(start(), each, checkpoint)
        if last:
            return waves
        time.sleep(pause)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per tumbling window and key (an extension: the batch form is the same expression without the watermark)."""
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def reservations(stream: DataFrame, key: str, limit_ms: int = 360_000) -> DataFrame:
    """Open reservations: (key, usd, state). Rows (key, action reserve|commit|release, usd). A reservation neither committed nor
    released within the limit expires."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            usd = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "usd": [usd], "state": ["expired"]})
            return
        usd = state.get[0] if state.exists else 0.0
        out = []
        for f in frames:
            for action, amount in zip(f["action"], f["usd"]):
                if action == "reserve":
                    usd += float(amount)
                    out.append((k[0], usd, "open"))
                elif state.exists or usd:
                    out.append((k[0], usd, "committed" if action == "commit" else "released"))
                    usd = 0.0
        if usd:
            state.update((usd,))
            state.setTimeoutDuration(limit_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "usd", "state"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, usd double, state string", "usd double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def admitted(requests: DataFrame, order: list[str], cost: str, limit: float, in_flight: float = 0.0) -> DataFrame:
    """Requests whose running total, themselves and what is under way included, stays within the limit."""
    return in_order(requests, order, F.col(cost)).where(F.col("before") + F.col(cost) + in_flight <= limit + 1e-9)


def admitted_by_stage(requests: DataFrame, stage: str, order: list[str], cost: str, limits: DataFrame, total: float) -> DataFrame:
    """Requests within the limit of their stage (stage, stage_limit), and of these the ones within the total, each in order."""
    w = Window.partitionBy(stage).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    staged = requests.withColumn("_s", F.sum(cost).over(w)).join(limits, stage).where(F.col("_s") <= F.col("stage_limit") + 1e-9).drop("_s", "stage_limit")
    return admitted(staged, order, cost, total)


def draws_needed(first: str, second: str, k: int):
    """Two draws if they agree, else k."""
    return F.when(F.col(first) == F.col(second), 2).otherwise(k)


def provider(rows: DataFrame, ask: Callable[[dict], dict], schema: str, tries: int = 3) -> DataFrame:
    """Rows sent to a function per partition, with retries; the function is the only place where a network may be used. A
    recorded answer table can stand in for it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                for attempt in range(tries):
                    try:
                        out.append(ask(r))
                        break
                    except Exception as e:  # noqa: BLE001
                        if attempt == tries - 1:
                            out.append({**r, "error": str(e)})
            yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)
