"""Synthetic agents: destination diaries by exploration and return, movement, and bursts of pings. An agent's numbers come from its id and a seed."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.spread import spread
from .city import City

# Chance to stay per kind, and the hours at which a kind is open.
STAY = {"home": 0.85, "workplace": 0.8, "retail": 0.5, "park": 0.4}
OPEN = {"home": (0, 24), "workplace": (7, 20), "retail": (9, 21), "park": (6, 22)}
DIARY = "agent_id long, timestamp long, duration long, location string"
PINGS = "agent_id long, timestamp long, x double, y double, ha double"
#: Agents that are simulated at once: more take more memory, fewer more time.
AGENTS = 1000


def _rng(agent: int, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, agent & (1 << 62) - 1])


def _picked(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Per row the index that Generator.choice takes with these weights for a uniform number; zeros are never taken."""
    cdf = np.cumsum(weights / weights.sum(axis=1, keepdims=True), axis=1)
    return (cdf / cdf[:, -1:] > u[:, None]).argmax(axis=1)


def diary_arrays(city: City, rngs: list[np.random.Generator], start: int, days: int, rho: float = 0.4, gamma: float = 0.3, step_min: int = 15) -> tuple[np.ndarray, ...]:
    """Diaries of several agents, a step of all at a time: (agent's number, time, minutes, place) in the agents' order, and the places' names.

    Each agent's numbers are drawn ahead in one call; its generator is put back to the first that was not used, so it goes on as if drawn one by one.
    """
    names = sorted(city.buildings)
    doors = np.array([city.buildings[n].door for n in names])
    kinds = [city.buildings[n].kind for n in names]
    homes = [i for i, k in enumerate(kinds) if k == "home"] or list(range(len(names)))
    stay = np.array([STAY[k] for k in kinds])
    open_at = np.array([[OPEN[k][0] <= h < OPEN[k][1] for k in kinds] for h in range(24)])
    pull = 1.0 / np.abs(doors[:, None] - doors[None]).sum(axis=2).clip(1) ** 2
    a, steps = len(rngs), days * 24 * 60 // step_min
    every = np.arange(a)
    here = np.array([int(r.choice(homes)) for r in rngs], np.int64)
    # A step takes three numbers at most: to stay, to explore, to choose.
    drawn = np.stack([r.random(3 * steps) for r in rngs]) if a else np.empty((0, 3 * steps))
    used = np.zeros(a, np.int64)
    visits = np.zeros((a, len(names)))
    visits[every, here] = 1
    # Places in the order of their first visits, -1 beyond.
    order = np.full((a, len(names)), -1, np.int64)
    order[:, 0] = here
    known_n = np.ones(a, np.int64)
    at = np.empty((a, steps), np.int64)
    for k in range(steps):
        is_open = open_at[(start + k * step_min * 60) // 3600 % 24]
        asks = np.flatnonzero(is_open[here])
        stays = np.zeros(a, bool)
        stays[asks] = drawn[asks, used[asks]] < stay[here[asks]]
        used[asks] += 1
        go = np.flatnonzero(~stays)
        if len(go):
            width = known_n[go].max()
            seen = order[go, :width]
            known = (seen >= 0) & is_open[seen] & (seen != here[go, None])
            new = is_open & (visits[go] == 0)
            any_known, any_new = known.any(axis=1), new.any(axis=1)
            explores = any_new.copy()
            both = np.flatnonzero(any_known & any_new)
            chance = np.array([rho * n**-gamma for n in range(1, len(names) + 1)])
            explores[both] = drawn[go[both], used[go[both]]] < chance[known_n[go[both]] - 1]
            used[go[both]] += 1
            back = ~explores & any_known
            x, n = np.flatnonzero(explores), go[explores]
            if len(x):
                to = _picked(np.where(new[x], pull[here[n]], 0.0), drawn[n, used[n]])
                here[n], order[n, known_n[n]] = to, to
                known_n[n] += 1
            x, b = np.flatnonzero(back), go[back]
            if len(x):
                weights = np.where(known[x], visits[b[:, None], seen[x]], 0.0)
                here[b] = seen[x, _picked(weights, drawn[b, used[b]])]
            moved = go[explores | back]
            used[moved] += 1
            visits[go, here[go]] += 1
        at[:, k] = here
    for r, n in zip(rngs, used.tolist(), strict=True):
        r.bit_generator.advance(n - 3 * steps)
    first = np.ones((a, steps), bool)
    first[:, 1:] = at[:, 1:] != at[:, :-1]
    who, k = np.nonzero(first)
    last = np.ones(len(who), bool)
    last[:-1] = who[1:] != who[:-1]
    until = np.full(len(who), steps)
    until[:-1] = np.where(last[:-1], steps, k[1:])
    return who, start + k * step_min * 60, (until - k) * step_min, at[who, k], np.array(names, object)


def diary(city: City, rng: np.random.Generator, start: int, days: int, rho: float = 0.4, gamma: float = 0.3, step_min: int = 15) -> list[tuple[int, int, str]]:
    """(time, minutes, place): stay, or explore with rho * S ** -gamma by gravity, or return by past visits, among places open then."""
    _, times, minutes, places, names = diary_arrays(city, [rng], start, days, rho, gamma, step_min)
    return list(zip(times.tolist(), minutes.tolist(), names[places].tolist(), strict=True))


#: Normal numbers that a trajectory draws ahead.
AHEAD = 4096


class _Steps:
    """Pairs of normal numbers of a generator, drawn ahead; done() puts the generator where drawing them one by one would have left it."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.pairs = rng, iter(())
        self.n = 0

    def next(self) -> tuple[float, float]:
        for pair in self.pairs:
            self.n += 1
            return pair
        self.state, self.n = self.rng.bit_generator.state, 1
        drawn = self.rng.normal(0, 0.1, (AHEAD, 2))
        self.pairs = zip(drawn[:, 0].tolist(), drawn[:, 1].tolist(), strict=True)
        return next(self.pairs)

    def done(self) -> None:
        if self.n:
            self.rng.bit_generator.state = self.state
            self.rng.normal(0, 0.1, (self.n, 2))


class _Ways:
    """Shortest ways of a city, found once each."""

    def __init__(self, city: City):
        self.streets = list(city.streets)
        self.middle = np.array(self.streets, float).reshape(-1, 2) + 0.5
        self.blocks = {n: set(b.blocks) for n, b in city.buildings.items()}
        self.path = lru_cache(maxsize=100_000)(city.path)

    def nearest(self, x: float, y: float) -> tuple[int, int]:
        return self.streets[int((np.abs(self.middle[:, 0] - x) + np.abs(self.middle[:, 1] - y)).argmin())]


def trajectory(city: City, entries: list[tuple[int, int, str]], rng: np.random.Generator, step_s: int = 60, speed: float = 1.5, ways: _Ways | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Times and places in blocks: along shortest street ways to a door, then a walk within the building's blocks."""
    t, p = [], []
    ways, normal = ways or _Ways(city), _Steps(rng)
    x, y = (c + 0.5 for c in map(float, city.buildings[entries[0][2]].blocks[0]))
    for begin, minutes, name in entries:
        building, blocks = city.buildings[name], ways.blocks[name]
        way = []
        if (int(x), int(y)) not in blocks:
            first = building.blocks[0]
            way = [(a + 0.5, b + 0.5) for a, b in (*ways.path(ways.nearest(x, y), building.door), first)][::-1]
        for now in range(begin, begin + minutes * 60, step_s):
            left = speed
            while way and left > 0:
                a, b = way[-1]
                d = float(np.hypot(a - x, b - y))
                if d <= left:
                    (x, y), left = way.pop(), left - d
                else:
                    x, y, left = x + (a - x) * (left / d), y + (b - y) * (left / d), 0
            if not way:
                for _ in range(8):
                    a, b = normal.next()
                    a, b = x + a, y + b
                    if (a // 1, b // 1) in blocks:
                        x, y = a, b
                        break
            t.append(now)
            p.append((x, y))
    normal.done()
    return np.array(t), np.array(p)


def ping_times(rng: np.random.Generator, start: int, end: int, beta_start: float, beta_durations: float, beta_ping: float) -> np.ndarray:
    """Bursts begin, last and ping at exponential intervals, whose means are minutes."""
    out, now = [], float(start)
    while now < end:
        now += rng.exponential(beta_start * 60)
        stop, ping = min(now + rng.exponential(beta_durations * 60), end), now
        while ping < stop:
            out.append(int(ping))
            ping += rng.exponential(beta_ping * 60)
        now = max(stop, now)
    return np.unique(np.array(out, np.int64))


def thin(t: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Rows of a trajectory last at or before each time, repeats left out."""
    at = np.searchsorted(t, times, "right") - 1
    at = at[at >= 0]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def target_q(q: float, beta_start: float) -> float:
    """Mean burst minutes for a share q of time in bursts."""
    return q * beta_start


def diaries(agents: DataFrame, city: City, start: int = 1704067200, days: int = 7, seed: int = 0, **options) -> DataFrame:
    """agents: agent_id. The city is shipped with the function; it is small. Agents are dealt out by id."""

    def of(frames):
        for pdf in frames:
            for ids in _parts(pdf["agent_id"].to_numpy(np.int64)):
                who, times, minutes, places, names = diary_arrays(city, [_rng(a, seed) for a in ids.tolist()], start, days, **options)
                yield pd.DataFrame({"agent_id": ids[who], "timestamp": times, "duration": minutes, "location": names[places]})

    return spread(agents.select("agent_id"), "agent_id").mapInPandas(of, DIARY)


def _parts(ids: np.ndarray):
    return (ids[k : k + AGENTS] for k in range(0, len(ids), AGENTS))


def trajectories(agents: DataFrame, city: City, start: int = 1704067200, days: int = 1, seed: int = 0, sparse: tuple[float, float, float] | None = None, ha: float = 0.0, step_s: int = 60) -> DataFrame:
    """Full trajectories, or with sparse = (start, duration, ping) mean minutes only pings in bursts; ha: least accuracy of Pareto-distributed noise.

    Agents are dealt out by id.
    """

    def one(a, rng, entries, ways):
        t, p = trajectory(city, entries, rng, step_s, ways=ways)
        if sparse:
            keep = thin(t, ping_times(rng, start, start + days * 86400, *sparse))
            t, p = t[keep], p[keep]
        accuracy = ha * (1 + rng.pareto(3, len(t))) / 15 if ha else np.zeros(len(t))
        noise = rng.normal(0, 1, (len(t), 2)) * (accuracy / 1.515)[:, None]
        return np.full(len(t), a), t, p[:, 0] + noise[:, 0], p[:, 1] + noise[:, 1], accuracy * 15

    def of(frames):
        ways = _Ways(city)
        for pdf in frames:
            for ids in _parts(pdf["agent_id"].to_numpy(np.int64)):
                rngs = [_rng(a, seed) for a in ids.tolist()]
                who, times, minutes, places, names = diary_arrays(city, rngs, start, days)
                cut = np.searchsorted(who, np.arange(len(ids) + 1))
                entries = list(zip(times.tolist(), minutes.tolist(), names[places].tolist(), strict=True))
                rows, size = [], 0
                for k, (a, rng) in enumerate(zip(ids.tolist(), rngs, strict=True)):
                    rows.append(one(a, rng, entries[cut[k] : cut[k + 1]], ways))
                    size += len(rows[-1][0])
                    if size >= 100_000 or k + 1 == len(ids):
                        yield pd.DataFrame(dict(zip(("agent_id", "timestamp", "x", "y", "ha"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))
                        rows, size = [], 0

    return spread(agents.select("agent_id"), "agent_id").mapInPandas(of, PINGS)
