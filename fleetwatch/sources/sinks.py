"""Alert log, health reports and evaluation files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from ..schemas import EVAL


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", by: list[str] | None = None) -> None:
    out = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        out = out.option("header", "true")
    (out.partitionBy(*by) if by else out).save(path)


def write_alerts(df: DataFrame, path: str, **kw) -> None:
    write_table(df, path, **kw)


def write_health(df: DataFrame, path: str, **kw) -> None:
    write_table(df, path, **kw)


def write_eval(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-episode CSV in fixed column order, one folder per run."""
    write_table(df.select("run_id", *EVAL), path, "csv", mode, by=["run_id"])


def stream_table(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger):
    """Append sink with a checkpoint; exactly once by the file sink's own log."""
    out = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def stream_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Writes every micro-batch under its checkpoint's name and its number: a repeated batch replaces itself, and no other run's."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return out.trigger(**(trigger or {"availableNow": True})).start()
