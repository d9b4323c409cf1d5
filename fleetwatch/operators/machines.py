"""State machines over ordered rows: small pure steps, no Spark inside ``run``.

Each is run per key by ``plans.replay`` (batch), ``streaming.stateful`` or ``streaming.ordered``. A machine that
forgets says in ``rests`` before which rows its state is that of the start (``_fresh``), for cutting large keys.
``run`` takes tuples ``(t, *cols)``. States are JSON values, so an exit state
can be compared and handed on. Times are microseconds.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..plans.replay import after_silence

SEC = 1_000_000


def known(x: float | None, y: float | None) -> bool:
    """Whether a position is one: rows with null or NaN in it are passed over."""
    return x is not None and y is not None and not math.isnan(x) and not math.isnan(y)


class PatrolPause:
    """Alerts pause the patrol; repeated pauses open a quiet time.

    An alert pauses for ``pause_s`` and later alerts do not extend it. ``burst``
    pauses within ``window_s`` start ``quiet_s`` in which alerts do not pause;
    afterwards the history is empty.
    """

    schema = "t long, action string, pause_start long, escalated boolean"
    cols: tuple[str, ...] = ()

    def __init__(self, pause_s: float = 30, window_s: float = 90, burst: int = 2, quiet_s: float = 120):
        self.pause, self.window, self.quiet = int(pause_s * SEC), int(window_s * SEC), int(quiet_s * SEC)
        self.burst = burst

    def initial(self):
        return {"pause": None, "history": [], "quiet": None}

    def rests(self, rows, tl):
        """After a silence longer than every limit nothing is held."""
        return after_silence(rows, tl, max(self.pause, self.window, self.quiet))

    def run(self, rows, s):
        pause, history, quiet = s["pause"], list(s["history"]), s["quiet"]
        out = []
        for (t,) in rows:
            if quiet is not None:
                if t < quiet:
                    out.append((t, "quiet", None, False))
                    continue
                quiet, history = None, []
            if pause is not None and t >= pause + self.pause:
                pause = None
            if pause is not None:
                out.append((t, "counted", pause, False))
                continue
            pause = t
            history = [h for h in (*history, t) if t - h < self.window]
            escalated = len(history) >= self.burst
            if escalated:
                quiet = t + self.quiet
            out.append((t, "pause", t, escalated))
        return out, {"pause": pause, "history": history, "quiet": quiet}


class MissionMode:
    """PATROL / AVOID_OBSTACLE / EMERGENCY_STOP from sensor rows, alerts and ticks.

    ``kind`` is sensor, alert or tick; ``danger`` is read on sensor rows. The
    first alert starts ``recovery_s``, looked at on ticks; sensors are ignored
    meanwhile. ``burst`` stops within ``window_s`` escalate.
    """

    schema = "t long, mode string, cause string, escalated boolean"
    cols = ("kind", "danger")

    def __init__(self, recovery_s: float = 30, window_s: float = 60, burst: int = 3):
        self.recovery, self.window, self.burst = int(recovery_s * SEC), int(window_s * SEC), burst

    def initial(self):
        return {"mode": "PATROL", "since": None, "stops": []}

    def rests(self, rows, tl):
        """After a tick that ends every recovery and finds no stop in the window: only whether it is stopped is held."""
        seen = tl.running(rows, {"_alert": ("last", F.when(F.col("kind") == "alert", F.col("t")))}, before=True)
        over = (F.col("kind") == "tick") & (F.col("_alert").isNull() | (F.col("t") - F.col("_alert") >= max(self.recovery, self.window)))
        return tl.previous(seen.withColumn("_over", over), {"_fresh": "_over"}).withColumn("_fresh", F.coalesce("_fresh", F.lit(False))).drop("_alert", "_over")

    def run(self, rows, s):
        mode, since, stops = s["mode"], s["since"], list(s["stops"])
        out = []
        for t, kind, danger in rows:
            stopped = mode == "EMERGENCY_STOP"
            if kind == "sensor" and not stopped:
                mode = "AVOID_OBSTACLE" if danger else "PATROL"
                out.append((t, mode, kind, False))
            elif kind == "alert" and not stopped:
                mode, since = "EMERGENCY_STOP", t
                stops = [x for x in (*stops, t) if t - x < self.window]
                out.append((t, mode, kind, len(stops) >= self.burst))
            elif kind == "tick" and stopped and t - since >= self.recovery:
                mode, since = "PATROL", None
                out.append((t, mode, kind, False))
        return out, {"mode": mode, "since": since, "stops": stops}


class TrainingGuard:
    """Stop flag per training episode with a burst limit.

    ``kind`` is alert or reset (a new episode). The ``burst``-th alert within
    ``window_s`` opens ``quiet_s`` and does not stop.
    """

    schema = "t long, action string"
    cols = ("kind",)

    def __init__(self, window_s: float = 60, burst: int = 10, quiet_s: float = 60):
        self.window, self.quiet, self.burst = int(window_s * SEC), int(quiet_s * SEC), burst

    def initial(self):
        return {"stopped": False, "history": [], "quiet": None}

    def rests(self, rows, tl):
        """A reset long after the last alert: no flag, no history, no quiet time."""
        quiet = after_silence(rows, tl, max(self.window, self.quiet), F.coalesce(F.col("kind") != "reset", F.lit(False)))
        return quiet.withColumn("_fresh", F.col("_fresh") & F.coalesce(F.col("kind") == "reset", F.lit(False)))

    def run(self, rows, s):
        stopped, history, quiet = s["stopped"], list(s["history"]), s["quiet"]
        out = []
        for t, kind in rows:
            if kind is None:
                continue
            if kind == "reset":
                stopped = False
                continue
            if quiet is not None and t < quiet:
                out.append((t, "quiet"))
                continue
            quiet = None
            history = [h for h in (*history, t) if t - h < self.window]
            if len(history) >= self.burst:
                quiet = t + self.quiet
                out.append((t, "escalate"))
            else:
                out.append((t, "held" if stopped else "stop"))
                stopped = True
        return out, {"stopped": stopped, "history": history, "quiet": quiet}


class StuckWatch:
    """Too little movement for too long: reverse with a growing, alternating turn.

    ``x``, ``y`` give the position, ``arrived`` a waypoint reached at that row.
    With ``events`` rows have a ``kind``: ``odom``; ``goto`` (a new target: the
    count starts over); ``pause`` and ``resume`` (nothing is judged while
    paused; the wait and the anchor start over at the last position known).
    """

    schema = "t long, stuck_no long, turn double"

    def __init__(self, dist: float = 0.03, time_s: float = 3.0, backup_s: float = 2.0, max_turn: float = 0.8, step: float = 0.3, events: bool = False):
        self.dist, self.time, self.backup = dist, int(time_s * SEC), int(backup_s * SEC)
        self.max_turn, self.step = max_turn, step
        self.events = events
        self.cols = ("x", "y", "arrived", "kind") if events else ("x", "y", "arrived")

    def initial(self):
        return {"at": None, "since": None, "n": 0, "until": None} | ({"here": None, "paused": False} if self.events else {})

    def run(self, rows, s):
        at, since, n, until = s["at"], s["since"], s["n"], s["until"]
        here, paused = s.get("here"), s.get("paused", False)
        out = []
        for t, x, y, arrived, *kind in rows:
            if kind and kind[0] != "odom":
                if kind[0] == "goto":
                    n = 0
                elif kind[0] == "pause":
                    paused = True
                elif kind[0] == "resume" and paused:
                    paused, since, at = False, t, here
                continue
            if not known(x, y):
                continue
            here = [x, y]
            if paused:
                continue
            if at is None:
                at, since = [x, y], t
            if until is not None:
                if t < until:
                    continue
                until, since, at = None, t, [x, y]
            if math.hypot(x - at[0], y - at[1]) > self.dist:
                at, since = [x, y], t
            elif t - since > self.time:
                n += 1
                turn = min(self.max_turn, self.step * n)
                out.append((t, n, turn if n % 2 == 1 else -turn))
                until = t + self.backup
                continue
            if arrived:
                since, at, n = t, [x, y], 0
        held = {"at": at, "since": since, "n": n, "until": until}
        return out, held | ({"here": here, "paused": paused} if self.events else {})


class TurningStuck:
    """Only turning for ``limit`` steps: the next ``back`` steps are reversed.

    ``raw_action`` is what the policy chose. Three turning actions that are not
    all equal are replaced by ``forward``; reversed steps take no action in.
    """

    schema = "t long, action int, reversed boolean"
    cols = ("raw_action",)

    def __init__(self, limit: int = 20, back: int = 5, smooth: int = 3, forward: int = 0):
        self.limit, self.back, self.smooth, self.forward = limit, back, smooth, forward

    def initial(self):
        return {"n": 0, "back": 0, "recent": []}

    def run(self, rows, s):
        n, back, recent = s["n"], s["back"], list(s["recent"])
        out = []
        for t, raw in rows:
            if back > 0:
                back -= 1
                out.append((t, self.forward, True))
                continue
            recent = [*recent, int(raw)][-self.smooth:]
            turning = len(recent) == self.smooth and self.forward not in recent and len(set(recent)) > 1
            action = self.forward if turning else int(raw)
            n = 0 if action == self.forward else n + 1
            if n >= self.limit:
                n, back, recent = 0, self.back, []
            out.append((t, action, False))
        return out, {"n": n, "back": back, "recent": recent}


class VisitProgress:
    """Target index along a route; it moves on when closer than ``reach``.

    ``route_x`` and ``route_y`` are arrays on every row. A row with ``goto_x``
    replaces the target and empties the queue; once reached, the route starts
    over. With ``loop`` the route repeats, else it ends after its last point.
    """

    schema = "t long, target int, dist double, reached boolean, done boolean"
    cols = ("x", "y", "route_x", "route_y", "goto_x", "goto_y")

    def __init__(self, reach: float = 0.30, loop: bool = True):
        self.reach, self.loop = reach, loop

    def initial(self):
        return {"i": 0, "goto": None, "done": False}

    def run(self, rows, s):
        i, goto, done = s["i"], s["goto"], s["done"]
        out = []
        for t, x, y, rx, ry, gx, gy in rows:
            if gx is not None:
                goto = [float(gx), float(gy)]
            if done or rx is None or len(rx) == 0 or not known(x, y):
                continue
            tx, ty = goto if goto is not None else (float(rx[i]), float(ry[i]))
            target = -1 if goto is not None else i
            dist = math.hypot(tx - x, ty - y)
            reached = dist < self.reach
            if reached:
                last = goto is None and i + 1 >= len(rx)
                done = last and not self.loop
                i = 0 if goto is not None or last else i + 1
                goto = None
            out.append((t, target, dist, reached, done))
        return out, {"i": i, "goto": goto, "done": done}


class ActionSmoother:
    """Stream twin of ``episodes.smooth_actions``."""

    schema = "t long, action int"
    cols = ("raw_action",)

    def __init__(self, n: int = 3, forward: int = 0):
        self.n, self.forward = n, forward

    def initial(self):
        return []

    def run(self, rows, recent):
        out = []
        for t, raw in rows:
            recent = [*recent, int(raw)][-self.n:]
            turning = len(recent) == self.n and self.forward not in recent and len(set(recent)) > 1
            out.append((t, self.forward if turning else int(raw)))
        return out, recent
