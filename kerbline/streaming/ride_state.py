"""One ride's state and what each position fix does to it, in order of arrival. Small and free of Spark.

A fix is (t in seconds, lon, lat, accuracy, speed or None, heading or None, along metres or None, off-route
metres, class or None). Events are (kind, value) pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

JUMP_M, TRUST_AFTER = 500.0, 3
OFF_ROUTE_M, GOOD_ACCURACY_M, STRIKES = 40.0, 50.0, 3
COOLDOWN_S, ANNOUNCE_S, IDLE_S = 10.0, 45.0, 600.0
MIN_STEP_M, MOVING_M_S, POLYLINE_M = 3.0, 0.8, 15.0
REBASE_M, WINDOW_S, WINDOW_M, LEAST_RIDE_M = 50.0, 10.0, 12.0, 200.0
ARRIVED_M, LEFT_M = 15.0, 80.0
TURN_SLACK_M, HAZARD_AHEAD_M, HAZARD_PAST_M = 20.0, 100.0, 10.0
#: Stage of a turn's call: (seconds ahead, least metres, most metres).
CALLS = {3: (4.0, 12.0, 30.0), 2: (10.0, 30.0, 80.0), 1: (25.0, 60.0, 200.0)}
PROTECTED, QUIET = ("path", "separated", "buffered"), ("quiet_street", "service")


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    kx = 111320.0 * math.cos(math.radians((a[1] + b[1]) / 2))
    return math.hypot((b[0] - a[0]) * kx, (b[1] - a[1]) * 110540.0)


def bearing(a: tuple[float, float], b: tuple[float, float]) -> float:
    kx = 111320.0 * math.cos(math.radians((a[1] + b[1]) / 2))
    return math.degrees(math.atan2((b[0] - a[0]) * kx, (b[1] - a[1]) * 110540.0)) % 360.0


@dataclass
class Ride:
    start: float | None = None
    last_t: float = 0.0
    last: tuple | None = None
    seen: tuple | None = None  # the last plausible position
    strange: int = 0
    moved_from: tuple | None = None
    fix_t: float | None = None
    speed: float = 0.0
    heading: float | None = None
    anchor: tuple | None = None
    anchor_t: float = 0.0
    base: float | None = None
    top: float = 0.0
    banked: float = 0.0
    moving_s: float = 0.0
    moved_at: float = 0.0
    stopped: bool = False
    last_poly: tuple | None = None
    n_poly: int = 0
    by_class: dict = field(default_factory=dict)
    off: int = 0
    tries: int = 0
    rerouted_at: float = -1e9
    spoken_at: float = -1e9
    next_km: int = 1
    halfway: bool = False
    arrived: bool = False
    n_fixes: int = 0
    turn: int = 0  # where the rider is among the route's turns and hazards
    stage: int = 0
    hazard: int = 0
    last_seq: int = -1
    event_ms: int = 0

    @property
    def total(self) -> float:
        return self.banked + (0.0 if self.base is None else self.top - self.base)


def advance(ride: Ride, t: float, lon: float, lat: float, accuracy: float, speed: float | None, heading: float | None, along: float | None, off_m: float | None, cls: str | None, route_m: float | None = None, turns: list[float] = (), hazards: list[float] = ()) -> list[tuple[str, float]]:
    """Takes one fix in; returns the events it causes."""
    here, events = (lon, lat), []
    if ride.seen is not None and metres(ride.seen, here) > JUMP_M:
        ride.strange += 1
        if ride.strange < TRUST_AFTER:
            return [("implausible", t)]
    else:
        ride.strange = 0
    ride.seen, ride.n_fixes = here, ride.n_fixes + 1
    _motion(ride, t, here, speed, heading)
    on_route = off_m is not None and off_m <= OFF_ROUTE_M
    _record(ride, t, here, cls, along if on_route else None)
    if ride.start is not None and not ride.stopped and t - ride.moved_at >= IDLE_S:
        ride.stopped = True
        events.append(("idle", t))
    if off_m is not None and not on_route:
        events += _off_route(ride, t, accuracy)
    elif on_route:
        ride.off, ride.tries = 0, 0
        if along is not None:
            if route_m is not None:
                events += _progress(ride, along, route_m)
            if not ride.arrived:
                events += guide(ride, along, ride.speed, turns, hazards)
    return events


def _motion(ride: Ride, t: float, here: tuple, speed: float | None, heading: float | None) -> None:
    if speed is not None and speed >= 0:
        ride.speed = speed if ride.speed == 0 else ride.speed * 0.6 + speed * 0.4
    elif ride.moved_from is not None and ride.fix_t is not None and t - ride.fix_t > 0.2:
        v = metres(ride.moved_from, here) / (t - ride.fix_t)
        if v < 25:
            ride.speed = v if ride.speed == 0 else ride.speed * 0.7 + v * 0.3
    ride.fix_t = t
    if heading is not None and (speed or 0.0) > 0.7:
        ride.heading = heading
    elif ride.moved_from is not None and metres(ride.moved_from, here) > 5:
        ride.heading = bearing(ride.moved_from, here)
    if ride.moved_from is None or metres(ride.moved_from, here) > 3:
        ride.moved_from = here


def _record(ride: Ride, t: float, here: tuple, cls: str | None, along: float | None) -> None:
    if ride.start is None:
        ride.start = ride.last_t = ride.anchor_t = ride.moved_at = t
        ride.last = ride.last_poly = ride.anchor = here
        ride.n_poly = 1
        return
    step, dt = metres(ride.last, here), t - ride.last_t
    ride.last_t, ride.last = t, here
    if dt > 0 and step >= MIN_STEP_M and step / dt > MOVING_M_S:
        ride.moving_s, ride.moved_at, ride.stopped = ride.moving_s + dt, t, False
    if metres(ride.last_poly, here) > POLYLINE_M:
        ride.last_poly, ride.n_poly = here, ride.n_poly + 1
    gained = 0.0
    if along is not None:  # the highest progress counts, so wander cannot add up
        if ride.base is None:
            ride.base = ride.top = along
        elif along < ride.base - REBASE_M:  # another route: keep what was ridden and start anew
            ride.banked += ride.top - ride.base
            ride.base = ride.top = along
        elif along > ride.top:
            gained, ride.top = along - ride.top, along
    elif t - ride.anchor_t >= WINDOW_S:  # windows of time, so wander is small beside the distance
        span = metres(ride.anchor, here)
        if span >= WINDOW_M:
            gained, ride.banked = span, ride.banked + span
        ride.anchor, ride.anchor_t = here, t
    if cls is not None and gained > 0:
        ride.by_class[cls] = ride.by_class.get(cls, 0.0) + gained


def _off_route(ride: Ride, t: float, accuracy: float) -> list[tuple[str, float]]:
    if accuracy > GOOD_ACCURACY_M:
        return []
    ride.off += 1
    if ride.off < STRIKES or t - ride.rerouted_at <= COOLDOWN_S * min(2**ride.tries, 6):
        return []
    ride.off, ride.rerouted_at, ride.tries = 0, t, ride.tries + 1
    spoken = t - ride.spoken_at > ANNOUNCE_S
    if spoken:
        ride.spoken_at = t
    return [("reroute", t)] + ([("announce", t)] if spoken else [])


def _progress(ride: Ride, along: float, route_m: float) -> list[tuple[str, float]]:
    events, left = [], max(0.0, route_m - along)
    if ride.arrived and left > LEFT_M:
        ride.arrived = False
    if ride.next_km == 1 and along > 1500:  # joined part-way: no news of what lies behind
        ride.next_km, ride.halfway = int(along // 1000) + 1, along >= route_m / 2
    if along >= ride.next_km * 1000:
        events.append(("kilometre", float(ride.next_km)))
        ride.next_km += 1
    if not ride.halfway and route_m > 1500 and along >= route_m / 2:
        ride.halfway = True
        events.append(("halfway", along))
    if left < ARRIVED_M and not ride.arrived:
        ride.arrived = True
        events.append(("arrived", along))
    return events


@dataclass
class Guide:
    """Where a rider is among a route's turns and hazards (metres along it, ascending)."""

    turn: int = 0
    stage: int = 0
    hazard: int = 0


def guide(state: Guide | Ride, along: float, speed: float, turns: list[float], hazards: list[float]) -> list[tuple[str, float]]:
    """Calls for the next turn in up to three stages, going back if the rider does; each hazard once, 100 m ahead."""
    events = []
    while state.turn < len(turns) - 1 and turns[state.turn] < along - TURN_SLACK_M:
        state.turn, state.stage = state.turn + 1, 0
    while state.turn > 0 and turns[state.turn - 1] > along + TURN_SLACK_M:
        state.turn, state.stage = state.turn - 1, 0
    if turns:
        left = max(0.0, turns[state.turn] - along)
        for stage in (3, 2, 1):
            seconds, low, high = CALLS[stage]
            if state.stage < stage and left <= max(low, min(high, speed * seconds)):
                events.append((f"turn_{stage}", turns[state.turn]))
                state.stage = stage
                break
    while state.hazard < len(hazards) and hazards[state.hazard] < along - HAZARD_PAST_M:
        state.hazard += 1
    if state.hazard < len(hazards) and hazards[state.hazard] - along <= HAZARD_AHEAD_M:
        events.append(("hazard", hazards[state.hazard]))
        state.hazard += 1
    return events


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def summary(ride: Ride) -> dict | None:
    """None for a ride too short to keep."""
    if ride.start is None or ride.total < LEAST_RIDE_M:
        return None
    known = sum(ride.by_class.values())
    share = lambda kinds: _half_up(100 * sum(m for c, m in ride.by_class.items() if c in kinds) / known) if known > 0 else 0
    return {
        "meters": _half_up(ride.total), "duration_s": _half_up(ride.last_t - ride.start), "moving_s": _half_up(ride.moving_s), "pct_protected": share(PROTECTED), "pct_quiet": share(QUIET), "n_points": ride.n_poly,
    }
