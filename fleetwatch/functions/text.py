"""Names, payload parsing and alert texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def short_name(full: Column) -> Column:
    return F.substring_index(full, "/", -1)


def full_name(namespace: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(namespace, "/+$", ""), F.lit("/"), name)


def printable(text: Column) -> Column:
    """Drops control, unassigned and separator characters except the plain space."""
    return F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", "")


def goto_name(name: Column, length: int = 40, default: str = "unnamed") -> Column:
    cut = printable(F.substring(name, 1, length))
    return F.coalesce(F.when(F.length(cut) > 0, cut), F.lit(default))


def parse_goto(payload: Column, default: str = "unnamed") -> Column:
    """struct(name, x, y, error) from a JSON goal; numbers may come as text."""
    body = F.from_json(payload, "name string, x string, y string")
    x, y = body["x"].try_cast("double"), body["y"].try_cast("double")
    bad = body.isNull() | x.isNull() | y.isNull()
    return F.struct(
        goto_name(body["name"], default=default).alias("name"),
        x.alias("x"),
        y.alias("y"),
        F.when(bad, F.lit("format")).alias("error"),
    )


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\n", " "), "\r", "")


def preview(text: Column, length: int) -> Column:
    return F.substring(one_line(text), 1, length)


def join_text(node: Column, total: Column) -> Column:
    return F.format_string("[node alert] unknown node joined\n> node: %s\n> live nodes: %d", node, total)


def exit_text(node: Column) -> Column:
    return F.concat(F.lit("[node offline] node left the graph\n> node: "), node)


def detector_text(votes: Column, details: Column, reason: Column, threshold: int = 2, detectors: int = 6) -> Column:
    head = F.when(
        reason == "vote", F.format_string(f"vote=%d/{detectors} >= {threshold}", F.size(votes))
    ).otherwise(F.lit("strong signal"))
    return F.concat(
        F.lit("[behaviour alert] ("), head, F.lit("):\n"),
        F.array_join(F.transform(details, lambda d: F.concat(F.lit("  - "), d)), "\n"),
    )


def burst_text(total: Column, names: Column, listed: Column, overflow: Column, window_s: int = 30, shown: int = 10) -> Column:
    lines = F.array_join(F.transform(names, lambda n: F.concat(F.lit("  - "), n)), "\n")
    more = F.when(listed > shown, F.format_string("\n  ... %d more", listed - shown)).otherwise(F.lit(""))
    lost = F.when(overflow > 0, F.format_string("\n  %d over the cap", overflow)).otherwise(F.lit(""))
    return F.concat(F.format_string(f"[burst summary] {window_s} s: %d unknown nodes\n", total), lines, more, lost)


def two_places(x: Column, signed: bool = False) -> Column:
    """Two decimals, exact halves to even."""
    return F.format_string("%+.2f" if signed else "%.2f", F.bround(x, 2))


def sensor_text(nearest: Column, accel: Column, danger: Column) -> Column:
    state = F.when(danger, F.lit("DANGER")).otherwise(F.lit("CLEAR"))
    near = F.coalesce(two_places(nearest), F.lit("-"))
    return F.concat(state, F.lit(" | nearest "), near, F.lit(" m | accel "), two_places(accel))


def security_text(payload: Column) -> Column:
    return F.concat(F.lit("ALERT: "), preview(payload, 100))


def health_text(sensor: Column, mission: Column, security: Column) -> Column:
    return F.concat(
        F.lit("== health ==\nsensor: "), sensor, F.lit("\nmission: "), mission, F.lit("\nsecurity: "), security
    )


def progress(steps: Column, elapsed_s: Column, total: Column) -> Column:
    """struct(rate, share, eta_s, eta): steps per second and time left as H:MM:SS."""
    rate = F.when(elapsed_s > 0, steps / elapsed_s).otherwise(F.lit(0.0))
    left = F.when(rate > 0, F.greatest(total - steps, F.lit(0)) / rate).otherwise(F.lit(0.0))
    s = F.floor(left)
    clock = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.struct(rate.alias("rate"), (steps / total).alias("share"), left.alias("eta_s"), clock.alias("eta"))


def trend(recent: Column, before: Column, dead_band: float = 1e-6) -> Column:
    """struct(arrow, delta) with a dead band around zero."""
    d = recent - before
    return F.struct(
        F.when(d > dead_band, F.lit("up")).when(d < -dead_band, F.lit("down")).otherwise(F.lit("flat")).alias("arrow"),
        two_places(d, signed=True).alias("delta"),
    )
