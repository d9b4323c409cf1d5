"""Reports for people: sensor lines, health reports, late-joiner views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import health_text
from ..plans.asof import hold

# What a health report shows before the first message.
PLACEHOLDER = {"sensor": "waiting", "mission": "waiting", "security": "OK"}


def late_joiner_view(df: DataFrame, start: Column, durable: bool, depth: int = 10, key=("topic",), order=("recv_ts", "seq")) -> DataFrame:
    """Rows a subscriber starting at ``start`` sees.

    A volatile one sees rows from then on; a durable one also gets the last
    ``depth`` rows per key from before.
    """
    after = df.where(F.col(order[0]) >= start)
    if not durable:
        return after
    w = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    kept = df.where(F.col(order[0]) < start).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= depth).drop("_r")
    return after.unionByName(kept)


def health_report(ticks: DataFrame, sensor: DataFrame, mission: DataFrame, security: DataFrame) -> DataFrame:
    """Report text at ticks from the latest verified texts.

    Each input is (robot_id, recv_ts, seq, sensor|mission|security).
    """
    streams = [
        (d.withColumnRenamed("seq", "_tie"), "recv_ts", [name])
        for d, name in ((sensor, "sensor"), (mission, "mission"), (security, "security"))
    ]
    held = hold(ticks, streams, "robot_id")
    filled = [F.coalesce(name, F.lit(text)) for name, text in PLACEHOLDER.items()]
    return held.withColumn("report", health_text(*filled))


def audit_commands(observed: DataFrame, cmd: DataFrame) -> DataFrame:
    """Logged command against the rule's: ``v_off`` and ``w_off`` per observation.

    Observations are (robot_id, tick_ts, want struct(v, w)); the command is the
    latest one at that time.
    """
    mine = cmd.select("robot_id", "recv_ts", F.col("seq").alias("_tie"), F.struct("v_lin", "v_ang").alias("_cmd"))
    held = hold(observed, [(mine, "recv_ts", ["_cmd"])], "robot_id")
    return (
        held.withColumn("v_off", F.col("_cmd.v_lin") - F.col("want.v")).withColumn("w_off", F.col("_cmd.v_ang") - F.col("want.w")).drop("_cmd")
    )
