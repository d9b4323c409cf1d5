"""Stream twins of the windowed operators: the same rules over short buffers.

Spark refuses row-count windows on streams, so each twin keeps just the rows
its window can still see. All follow the machine protocol of
``operators.machines`` and run with ``stateful.run_stream``.
"""

from __future__ import annotations

import math

import numpy as np

from ..operators import detectors as D
from ..operators.machines import SEC


class Cooldown:
    """G1: keep a row at least (``strict``: more than) ``seconds`` after the last kept."""

    def __init__(self, seconds: float, strict: bool = False, carry: str = "seq", carry_type: str = "long"):
        self.gap = int(seconds * SEC) + (1 if strict else 0)
        self.cols = (carry,)
        self.schema = f"t long, {carry} {carry_type}"

    def initial(self):
        return None

    def run(self, rows, last):
        out = []
        for r in rows:
            if last is None or r[0] - last >= self.gap:
                last = r[0]
                out.append(r)
        return out, last


def above(a: float | None, b: float) -> bool:
    """a > b as Spark compares: NaN is above every number, null above none."""
    return a is not None and (math.isnan(a) or a > b)


def below(a: float | None, b: float) -> bool:
    return a is not None and not math.isnan(a) and a < b


def largest(values) -> float | None:
    """The largest of what isn't null; NaN if there is one."""
    some = [v for v in values if v is not None]
    return next((v for v in some if math.isnan(v)), max(some, default=None))


def mean(values) -> float | None:
    some = [v for v in values if v is not None]
    return sum(some) / len(some) if some else None


def size_of(v: float | None) -> float | None:
    return None if v is None else abs(v)


class LastRows:
    """Window values over the last commands, one output per command.

    Null velocities count as rows but have no value; a NaN one breaks a limit
    and counts as forward, as in the batch plan.
    """

    schema = "t long, seq long, max_lin double, max_ang double, d1 boolean, d2 boolean, cmd5 double, speed10 double"
    cols = ("seq", "v_lin", "v_ang")

    def __init__(self, lin_max: float = D.LIN_MAX, ang_max: float = D.ANG_MAX, share: float = D.DIRECTION_SHARE):
        self.lin_max, self.ang_max, self.share = lin_max, ang_max, share

    def initial(self):
        return []

    def run(self, rows, last):
        out = []
        for t, seq, lin, ang in rows:
            last = [*last, [lin, ang]][-D.HISTORY:]
            five, n = last[-5:], len(last)
            max_lin, max_ang = largest(size_of(r[0]) for r in five), largest(size_of(r[1]) for r in five)
            fwd, bwd = sum(above(r[0], D.DIRECTION_DEAD) for r in last), sum(below(r[0], -D.DIRECTION_DEAD) for r in last)
            d2 = n >= 10 and fwd / n >= self.share and bwd / n >= self.share
            ten = last[-10:]
            out.append((t, seq, max_lin, max_ang, above(max_lin, self.lin_max) or above(max_ang, self.ang_max), d2,
                        mean(r[0] for r in five), mean(size_of(r[0]) for r in ten)))
        return out, last


def mean_diff(a, b) -> float:
    n = min(len(a), len(b))
    x, y = np.asarray(a[:n], dtype=float), np.asarray(b[:n], dtype=float)
    ok = np.isfinite(x) & np.isfinite(y)
    return float(np.abs(x[ok] - y[ok]).mean()) if ok.any() else 0.0


def _plain(ranges) -> list:
    """JSON has no NaN; what is not finite never counts in a difference."""
    return [float(r) if r is not None and math.isfinite(r) else None for r in ranges]


def _floats(ranges) -> list:
    return [math.nan if r is None else r for r in ranges]


class ScanMotion:
    """Difference to the frame before and its maxima over 4 and 2 pairs."""

    schema = "t long, seq long, diff double, diff4 double, diff2 double, frames long, d3 boolean"
    cols = ("seq", "ranges")

    def __init__(self, repeat: float = D.REPEAT_DIFF, min_points: int = 50, max_points: int = 4096):
        self.repeat, self.min_points, self.max_points = repeat, min_points, max_points

    def initial(self):
        return {"prev": None, "diffs": [], "n": 0}

    def run(self, rows, s):
        prev, diffs, n = s["prev"], list(s["diffs"]), s["n"]
        out = []
        for t, seq, ranges in rows:
            if ranges is None:
                continue
            cur = list(ranges)[: self.max_points]
            if len(cur) <= self.min_points:
                continue
            cur = _plain(cur)
            diff = None
            if prev is not None:
                diff = mean_diff(_floats(prev), _floats(cur))
                diffs = [*diffs, diff][-4:]
            prev, n = cur, min(n + 1, D.HISTORY)
            top = max(diffs) if diffs else None
            out.append((t, seq, diff, top, max(diffs[-2:]) if diffs else None, n, n >= 5 and top < self.repeat))
        return out, {"prev": prev, "diffs": diffs, "n": n}


class Lag:
    """D12, G13, G14, E6-like rules that only need the row before.

    ``rule(previous t, t, previous value, value)`` returns None or output values.
    """

    def __init__(self, col: str, schema: str, rule):
        self.cols, self.schema, self.rule = (col,), schema, rule

    def initial(self):
        return None

    def run(self, rows, last):
        out = []
        for t, v in rows:
            got = self.rule(last[0] if last else None, t, last[1] if last else None, v)
            if got is not None:
                out.append(got)
            last = [t, v]
        return out, last


def skip_seen() -> Lag:
    return Lag("stamp_s", "t long, stamp_s double", lambda pt, t, p, v: (t, v) if pt is None or p != v else None)


def silence(limit_s: float) -> Lag:
    """Gaps over ``limit_s``: also the heartbeat cadence with two periods."""
    return Lag("seq", "since long, until long", lambda pt, t, p, v: (pt, t) if pt is not None and t - pt > limit_s * SEC else None)


class Silence:
    """G13 with a timer: reports the silence itself, not only its end.

    Run with ``idle_s`` equal to the limit.
    """

    schema = "since long"
    cols = ()

    def initial(self):
        return None

    def run(self, rows, last):
        return [], rows[-1][0]

    def expire(self, last):
        return [(last,)]


class Detectors:
    """All six detectors, latch, vote and cooldown in one state per robot.

    Rows have ``kind`` cmd, odom, scan, beat, alarm or tick; ``a``, ``b`` hold
    velocities, ``ranges`` the frame, ``info`` the publisher alarm of a tick.
    Order rows by (t, late, seq) with ``late`` = 1 for ticks.
    """

    schema = ("t long, d1 boolean, d2 boolean, d3 boolean, d4 boolean, d5 boolean, d6 boolean, votes string, "
              "verdict string, emitted boolean")
    cols = ("kind", "a", "b", "ranges", "info")

    def __init__(self, lin_max=D.LIN_MAX, ang_max=D.ANG_MAX, share=D.DIRECTION_SHARE, repeat=D.REPEAT_DIFF, still=D.STILL_DIFF,
                 moving=D.MOVING, frozen=D.FROZEN, beat_timeout=D.BEAT_TIMEOUT_S, cooldown=D.COOLDOWN_S, min_points=50):
        self.moving, self.frozen, self.still = moving, frozen, still
        self.timeout, self.cooldown = int(beat_timeout * SEC), int(cooldown * SEC)
        self.commands = LastRows(lin_max, ang_max, share)
        self.frames = ScanMotion(repeat, min_points)

    def initial(self):
        return {"cmd": [], "c": None, "odo": [], "scan": self.frames.initial(), "s": None, "beat": None, "latched": False,
                "alarm": None, "sent": None}

    def run(self, rows, s):
        s = dict(s)
        out = []
        for t, kind, a, b, ranges, info in rows:
            if kind == "cmd":
                made, s["cmd"] = self.commands.run([(t, 0, a, b)], s["cmd"])
                s["c"] = [made[0][4], made[0][5], made[0][6]]
            elif kind == "odom":
                s["odo"] = [*s["odo"], size_of(a)][-10:]
            elif kind == "scan":
                made, s["scan"] = self.frames.run([(t, 0, ranges)], s["scan"])
                if made:
                    s["s"] = [made[0][6], made[0][4], made[0][5]]
            elif kind == "beat":
                s["beat"], s["latched"] = t, False
            elif kind == "alarm":
                s["alarm"] = [t, info]
            elif kind == "tick":
                out.append(self._tick(t, s))
        return out, s

    def _tick(self, t, s):
        d1, d2, cmd5 = s["c"] or (False, False, None)
        d3, diff2, frames = s["s"] or (False, None, 0)
        d4 = s["alarm"] is not None and s["alarm"][0] == t
        d5 = s["beat"] is not None and t - s["beat"] > self.timeout
        d6 = False
        if len(s["odo"]) >= 10 and frames >= 5:
            speed = mean(s["odo"])
            d6 = (above(speed, self.moving) and (diff2 or 0.0) < self.still) or (
                len(s["cmd"]) >= 5 and above(cmd5, self.moving) and below(speed, self.frozen)
            )
        new = d5 and not s["latched"]
        s["latched"] = s["latched"] or d5
        flags = (d1, d2, d3, d4, new, d6)
        votes = [f"D{i + 1}" for i, f in enumerate(flags) if f]
        verdict = "vote" if len(votes) >= D.VOTES else "strong-D4" if d4 or new else "warning" if votes else None
        emitted = verdict in ("vote", "strong-D4") and (s["sent"] is None or t - s["sent"] >= self.cooldown)
        if emitted:
            s["sent"] = t
        return (t, d1, d2, bool(d3), d4, d5, d6, ",".join(votes), verdict, emitted)


class NodeMonitor:
    """Join alerts from snapshots, one row per live node and poll.

    ``listed`` tells whitelisted nodes (a stream-static join before). A poll is
    judged when the next one begins; ``idle_s`` flushes the last one. Alerted
    names are forgotten after the time to live, so names do not pile up.
    """

    schema = "t long, node string, alert string, live_nodes long"
    cols = ("node", "listed")

    def __init__(self, ttl_s: float = 600.0, exit_alerts: bool = False):
        self.ttl, self.exits = int(ttl_s * SEC), exit_alerts

    def initial(self):
        return {"t": None, "now": {}, "known": None, "alerted": {}}

    def expire(self, s):
        return self._judge(dict(s)) if s["t"] is not None else []

    def run(self, rows, s):
        s = dict(s)
        out = []
        for t, node, listed in rows:
            if s["t"] is not None and t != s["t"]:
                out.extend(self._judge(s))
                s["now"] = {}
            s["t"] = t
            s["now"] = {**s["now"], node: bool(listed)}
        return out, s

    def _judge(self, s):
        t, now, known = s["t"], s["now"], s["known"]
        first = known is None
        joined = [n for n in sorted(now) if first or n not in known]
        gone = [] if first else [n for n in sorted(known) if n not in now]
        alerted = {n: at for n, at in s["alerted"].items() if t - at < self.ttl}
        out = []
        for n in joined:
            if not now[n] and n not in alerted:
                alerted[n] = t
                out.append((t, n, "joined", len(now)))
        if self.exits:
            for n in gone:
                if not known[n]:
                    out.append((t, n, "exited", len(now)))
                alerted.pop(n, None)
        s["known"] = {n: k for n, k in now.items() if k} if first else now
        s["alerted"] = alerted
        return out


class Notify:
    """Leading edge at once, a summary per window, push-limit flag.

    Windows count from the epoch, or with ``from_first`` from the key's first
    alert, as the batch plan does where ``starts`` names that time; a summary is emitted with the first row of a
    later window or when ``idle_s`` runs out.
    """

    schema = "t long, kind string, total long, listed long, overflow long, names array<string>, rate_limited boolean"
    cols = ("node", "is_exit")

    def __init__(self, window_s: float = 30, limit_s: float = 15, cap: int = 256, shown: int = 10, from_first: bool = False):
        self.window, self.limit, self.cap, self.shown = int(window_s * SEC), int(limit_s * SEC), cap, shown
        self.from_first = from_first

    def initial(self):
        return {"w": None, "total": 0, "joins": 0, "names": [], "edge": None, "sent": None, "origin": None if self.from_first else 0}

    def _send(self, s, t, kind, total, listed, overflow, names):
        limited = s["sent"] is not None and t - s["sent"] < self.limit
        if not limited:
            s["sent"] = t
        return (t, kind, total, listed, overflow, names, limited)

    def _flush(self, s):
        if not s["total"]:
            return []
        over = max(0, s["joins"] - self.cap)
        row = self._send(s, s["w"] + self.window, "summary", s["total"], s["total"] - over, over, s["names"])
        s["total"], s["joins"], s["names"] = 0, 0, []
        return [row]

    def expire(self, s):
        return self._flush(dict(s)) if s["w"] is not None else []

    def run(self, rows, s):
        s = dict(s)
        out = []
        for t, node, is_exit in rows:
            if s["origin"] is None:
                s["origin"] = t
            w = (t - s["origin"]) // self.window * self.window + s["origin"]
            if s["w"] is not None and w > s["w"]:
                out.extend(self._flush(s))
            s["w"] = w
            if s["edge"] is None or t - s["edge"] >= self.window:
                s["edge"] = t
                out.append(self._send(s, t, "immediate", 1, 1, 0, [node]))
                continue
            s["total"] += 1
            s["joins"] += 0 if is_exit else 1
            if len(s["names"]) < self.shown:
                s["names"] = [*s["names"], f"(exit) {node}" if is_exit else node]
        return out, s


class Reports:
    """throttled reports of refused messages with what they cover."""

    schema = "t long, refused long"
    cols = ()

    def __init__(self, seconds: float = 5.0, strict: bool = False):
        self.gap = int(seconds * SEC) + (1 if strict else 0)

    def initial(self):
        return {"last": None, "n": 0}

    def run(self, rows, s):
        last, n, out = s["last"], s["n"], []
        for (t,) in rows:
            n += 1
            if last is None or t - last >= self.gap:
                out.append((t, n))
                last, n = t, 0
        return out, {"last": last, "n": n}


class FrameRepeat:
    """The frame equals the last accepted one (see ``detectors.frame_repeat``)."""

    schema = "t long, seq long, repeated boolean"
    cols = ("seq", "ranges")

    def __init__(self, top: float = 3.5, min_points: int = 50):
        self.top, self.min_points = top, min_points

    def initial(self):
        return None

    def run(self, rows, stored):
        out = []
        for t, seq, ranges in rows:
            if ranges is None:
                out.append((t, seq, False))
                continue
            judged = len(ranges) > self.min_points
            cur = _plain(ranges)
            filled = np.array([self.top if r is None else r for r in cur])
            low = judged and float(filled.std()) < 0.01
            far = judged and float((filled > 0.9 * self.top).mean()) > 0.95
            out.append((t, seq, judged and not low and stored is not None and cur == stored))
            if not low and not far:
                stored = cur
        return out, stored


class SecurityStatus:
    """G7 at ticks: the last alert's text until it is older than ``timeout_s``.

    Rows have ``kind`` alert or tick and ``status``; order by (t, late, seq).
    """

    schema = "t long, status string"
    cols = ("kind", "status")

    def __init__(self, timeout_s: float = 30.0, calm: str = "OK"):
        self.timeout, self.calm = int(timeout_s * SEC), calm

    def initial(self):
        return None

    def run(self, rows, last):
        out = []
        for t, kind, status in rows:
            if kind == "alert":
                last = [t, status]
            else:
                out.append((t, last[1] if last and t - last[0] <= self.timeout else self.calm))
        return out, last


class Visits:
    """Prior visits of a grid cell; key by (run_id, gx, gy)."""

    schema = "t long, seq long, prior_visits long"
    cols = ("seq",)

    def initial(self):
        return 0

    def run(self, rows, n):
        return [(t, seq, n + i) for i, (t, seq) in enumerate(rows)], n + len(rows)


class Curriculum:
    """Stage before each episode and promotions."""

    schema = "t long, seq long, stage int, promoted boolean"
    cols = ("seq", "success")

    def __init__(self, stages: int = 5, window: int = 50, least: int = 30, promote: float = 0.7):
        self.stages, self.window, self.least, self.promote = stages, window, least, promote

    def initial(self):
        return {"stage": 1, "win": []}

    def run(self, rows, s):
        stage, win, out = s["stage"], list(s["win"]), []
        for t, seq, success in rows:
            win = [*win, int(success)][-self.window:]
            up = len(win) >= self.least and sum(win) / len(win) >= self.promote and stage < self.stages
            out.append((t, seq, stage, up))
            if up:
                stage, win = stage + 1, []
        return out, {"stage": stage, "win": win}
