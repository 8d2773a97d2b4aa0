"""Recurrences over the rows of a symbol: exponential means and the parabolic stop.

Both are compositions of simple maps, y -> a y + b for a mean and
y -> min(a y + b, c) for the stop. Maps compose, so a recurrence runs over chunks of a
symbol's history at the same time, in three steps: every chunk's map is composed in its
own task, from an unknown state to another; the few maps of a symbol are applied one
after the other, which gives the state each chunk starts from; and every chunk is
solved from that state. Within a chunk, maps are composed by doubling in numpy.

A recurrence over another's values has to wait until that one's states are known, so
there is a round of composing for each level. The stop has two: how far it is pulled
depends on the highest high and the raises so far, which are known first.

Memory is a chunk, however long a history is, and a lost task starts its chunks again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bars import stored
from . import chunks
from .chunks import CHUNK, LATER, OWN, ROLE, WARM
from .kernels import SYMBOL, by_date, within


@dataclass(frozen=True)
class Ewm:
    """``out``: exponential mean of column ``of``, weight ``alpha`` for the new
    value. Starts at the first non-null; a null row carries the mean on and lets
    the old weight decay, and the next value is weighed against what is left. With
    ``ignore_na`` null rows let nothing decay (pandas has the same two forms)."""

    out: str
    of: str
    alpha: float
    ignore_na: bool = False


@dataclass(frozen=True)
class Minus:
    """``out`` = ``a`` - ``b``, of columns or earlier steps."""

    out: str
    a: str
    b: str


@dataclass(frozen=True)
class Over:
    """``out`` = ``a`` / ``b``, null where b is 0 or either is null."""

    out: str
    a: str
    b: str


@dataclass(frozen=True)
class Back:
    """``out``: ``of`` ``n`` rows ago."""

    out: str
    of: str
    n: int = 1


@dataclass(frozen=True)
class Sum:
    """``out``: sum of ``of`` over ``n`` rows, null unless all are there."""

    out: str
    of: str
    n: int


@dataclass(frozen=True)
class Stop:
    """Parabolic stop that rises towards the highest high and never passes the
    last two lows; so it never changes sides. Rows without high or low: null."""

    out: str
    high: str = "high"
    low: str = "low"
    step: float = 0.02
    most: float = 0.2

    @property
    def saturated(self) -> int:
        """Raises beyond which the pull no longer grows."""
        return int(np.ceil(self.most / self.step))


Step = Ewm | Minus | Over | Back | Sum | Stop
State = list[float]


def span(n: int) -> float:
    return 2.0 / (n + 1)


def _solve(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    """y[i] = min(a[i] y[i-1] + b[i], c[i]) with a[0] = 0."""
    a, b = a.copy(), b.copy()
    s = 1
    while s < len(a) and a[s:].any():
        if c is not None:
            c = np.concatenate((c[:s], np.minimum(a[s:] * c[:-s] + b[s:], c[s:])))
        b[s:] += a[s:] * b[:-s]
        a[s:] *= a[:-s]
        s *= 2
    return b if c is None else np.minimum(b, c)


def _compose(a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> tuple[float, float, float]:
    """The one map that all maps make, applied from the first to the last."""
    c = np.full(len(a), np.inf) if c is None else c
    if not len(a):
        return 1.0, 0.0, np.inf
    while len(a) > 1:
        odd = len(a) % 2
        first, second = slice(odd, None, 2), slice(odd + 1, None, 2)
        over = np.where(np.isinf(c[first]), np.inf, a[second] * np.where(np.isinf(c[first]), 0.0, c[first]) + b[second])
        c = np.concatenate((c[:odd], np.minimum(over, c[second])))
        b = np.concatenate((b[:odd], a[second] * b[first] + b[second]))
        a = np.concatenate((a[:odd], a[second] * a[first]))
    return float(a[0]), float(b[0]), float(c[0])


def _weights(alpha: float, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the old mean and of the new value, so many rows after the last value."""
    old = (1.0 - alpha) ** since
    return old / (old + alpha), alpha / (old + alpha)


class _Mean:
    """A mean's state: the last mean (NaN: none yet) and rows since its value."""

    none = [np.nan, 0.0]

    def __init__(self, step: Ewm) -> None:
        self.alpha, self.ignore_na = step.alpha, step.ignore_na

    def weights(self, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _weights(self.alpha, np.ones_like(since) if self.ignore_na else since)

    def solve(self, x: np.ndarray, state: State) -> np.ndarray:
        y0, age = state
        at = np.flatnonzero(~np.isnan(x))
        out = np.full(len(x), y0)
        if len(at):
            a, w = self.weights(np.diff(at, prepend=-1 - age))
            b = w * x[at]
            b[0] = x[at[0]] if np.isnan(y0) else a[0] * y0 + b[0]
            a[0] = 0.0
            out[at[0] :] = np.repeat(_solve(a, b), np.diff(at, append=len(x)))
        return out

    def summary(self, x: np.ndarray) -> State:
        """Rows, rows before the first value, that value, the map of those behind it,
        rows after the last."""
        at = np.flatnonzero(~np.isnan(x))
        if not len(at):
            return [len(x), len(x), np.nan, 1.0, 0.0, 0.0]
        a, w = self.weights(np.diff(at))
        return [len(x), at[0], x[at[0]], *_compose(a, w * x[at[1:]])[:2], len(x) - 1 - at[-1]]

    def after(self, state: State, made: State) -> State:
        (y, age), (rows, lead, x, a, b, trail) = state, made
        if np.isnan(x):
            return [y, age + rows] if not np.isnan(y) else state
        if not np.isnan(y):
            old, new = self.weights(np.array(lead + age + 1))
            x = old * y + new * x
        return [a * x + b, trail]


class _Peaks:
    """The first part of a stop's state: the highest high (NaN: none yet), raises, the
    last low."""

    none = [np.nan, 0.0, np.nan]

    def __init__(self, step: Stop) -> None:
        self.kept = step.saturated + 1

    def summary(self, high: np.ndarray, low: np.ndarray) -> State:
        """The last low, and the last few highs that topped all before them."""
        at = ~np.isnan(high) & ~np.isnan(low)
        h = high[at]
        peak = np.maximum.accumulate(h)
        tops = h[np.concatenate(([True], h[1:] > peak[:-1]))][-self.kept :] if len(h) else h
        return [low[at][-1] if len(h) else np.nan, *tops, *[np.nan] * (self.kept - len(tops))]

    def after(self, state: State, made: State) -> State:
        top, raises, _ = state
        low, tops = made[0], [t for t in made[1:] if not np.isnan(t)]
        if not tops:
            return state
        rises = len(tops) - 1 if np.isnan(top) else sum(t > top for t in tops)
        return [tops[-1] if np.isnan(top) else max(top, tops[-1]), min(raises + rises, self.kept), low]


class _Pulls:
    """The second part: the stop itself, once the first is known."""

    none = [np.nan]

    def __init__(self, step: Stop) -> None:
        self.step, self.most = step.step, step.most

    def maps(self, high: np.ndarray, low: np.ndarray, peaks: State) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(~np.isnan(high) & ~np.isnan(low))
        h, l = high[at], low[at]  # noqa: E741
        if not len(at):
            return at, h, h, h
        top, raises, before = peaks if not np.isnan(peaks[0]) else (h[0], 0, l[0])
        peak = np.maximum.accumulate(np.concatenate(([top], h)))
        rises = raises + np.cumsum(np.concatenate(([0], (peak[1:] > peak[:-1]))))
        pull = np.minimum(self.step * (1 + rises[:-1]), self.most)
        a, b = 1.0 - pull, pull * peak[:-1]
        if np.isnan(peaks[0]):  # the first row: the stop stands at its low
            a[0], b[0] = 0.0, l[0]
        return at, a, b, np.minimum(np.concatenate(([before], l[:-1])), l)

    def solve(self, high: np.ndarray, low: np.ndarray, state: State) -> np.ndarray:
        *peaks, y = state
        at, a, b, c = self.maps(high, low, peaks)
        out = np.full(len(high), np.nan)
        if len(at):
            if not np.isnan(peaks[0]):
                b[0] += a[0] * y
            a[0] = 0.0
            out[at] = _solve(a, b, c)
        return out

    def summary(self, high: np.ndarray, low: np.ndarray, peaks: State) -> State:
        return list(_compose(*self.maps(high, low, peaks)[1:]))

    def after(self, state: State, made: State) -> State:
        (y,), (a, b, c) = state, made
        if np.isnan(y):
            return [min(b, c)] if a == 0.0 else state
        return [min(a * y + b, c)]


class Steps:
    """Steps in an order that works, the rounds they take, and where each one's state
    lies among all states."""

    def __init__(self, steps: Sequence[Step]) -> None:
        self.steps = list(steps)
        self.outs = [s.out for s in self.steps]
        level: dict[str, int] = {}
        local: set[str] = set()  # made of rows before, which a chunk's start lacks
        rounds: dict[int, list[tuple[int, object]]] = {}
        for k, s in enumerate(self.steps):
            if isinstance(s, Stop):
                rounds.setdefault(0, []).append((k, _Peaks(s)))
                rounds.setdefault(1, []).append((k, _Pulls(s)))
                level[s.out] = 2
                continue
            used = [s.a, s.b] if isinstance(s, (Minus, Over)) else [s.of]
            now = max(level.get(c, 0) for c in used)
            if isinstance(s, Ewm):
                if local & set(used):
                    raise ValueError(f"{s.out}: a mean of what looks back over rows is not offered")
                rounds.setdefault(now, []).append((k, _Mean(s)))
                now += 1
            elif isinstance(s, (Back, Sum)) or local & set(used):
                local.add(s.out)
            level[s.out] = now
        self.rounds = [rounds[r] for r in sorted(rounds)]
        self.slots: list[dict[int, tuple[int, int]]] = []
        at = 0
        for parts in self.rounds:
            self.slots.append({})
            for k, part in parts:
                self.slots[-1][k] = (at, at + len(part.none))
                at += len(part.none)
        #: Rows that steps look back over.
        self.halo = sum(s.n for s in self.steps if isinstance(s, (Back, Sum)))
        self.none = [x for parts in self.rounds for _, part in parts for x in part.none]
        self.inputs = sorted({c for s in self.steps for c in ([s.high, s.low] if isinstance(s, Stop) else [s.a, s.b] if isinstance(s, (Minus, Over)) else [s.of])} - set(self.outs))

    def _state(self, k: int, state: State) -> State:
        return [x for slots in self.slots for i, (lo, hi) in slots.items() if i == k for x in state[lo:hi]]

    def solve(self, have: dict[str, np.ndarray], state: State, rounds: int | None = None) -> dict[str, np.ndarray]:
        """``have`` with the outs that need no more than the states of ``rounds``."""
        known = {k for parts in self.rounds[:rounds] for k, _ in parts} - {k for parts in self.rounds[rounds:] for k, _ in parts} if rounds is not None else set(range(len(self.steps)))
        have = dict(have)
        for k, s in enumerate(self.steps):
            if isinstance(s, Stop):
                if k in known:
                    have[s.out] = _Pulls(s).solve(have[s.high], have[s.low], self._state(k, state))
            elif isinstance(s, Ewm):
                if k in known and s.of in have:
                    have[s.out] = _Mean(s).solve(have[s.of], self._state(k, state))
            elif isinstance(s, (Minus, Over)):
                if s.a in have and s.b in have:
                    a, b = have[s.a], have[s.b]
                    have[s.out] = a - b if isinstance(s, Minus) else np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)
            elif s.of in have:
                x = have[s.of]
                if isinstance(s, Back):
                    have[s.out] = np.concatenate((np.full(min(s.n, len(x)), np.nan), x[: max(0, len(x) - s.n)]))
                else:
                    full = max(0, len(x) - s.n + 1)
                    total = reduce(np.add, [x[j : j + full] for j in range(s.n)])  # the oldest first, as a frame is added up
                    have[s.out] = np.concatenate((np.full(len(x) - full, np.nan), total))
        return have

    def summary(self, have: dict[str, np.ndarray], state: State, round_: int) -> State:
        have = self.solve(have, state, round_)
        out: State = []
        for k, part in self.rounds[round_]:
            s = self.steps[k]
            if isinstance(part, _Mean):
                out += part.summary(have[s.of])
            elif isinstance(part, _Peaks):
                out += part.summary(have[s.high], have[s.low])
            else:
                out += part.summary(have[s.high], have[s.low], self._state(k, state)[: len(_Peaks.none)])
        return [float(x) for x in out]

    def fold(self, state: State, made: State, round_: int) -> State:
        """The states of a round behind a chunk, from those before it and its maps."""
        out, at, read = [], 0, 0
        for _, part in self.rounds[round_]:
            size = {_Mean: 6, _Peaks: 1 + getattr(part, "kept", 0), _Pulls: 3}[type(part)]
            out += part.after(state[at : at + len(part.none)], made[read : read + size])
            at, read = at + len(part.none), read + size
        return [float(x) for x in out]


_LIST = pa.list_(pa.float64())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole chunks, and where in them chunks start: rows of ``_place`` 1."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_place")).to_numpy(zero_copy_only=False) == 1)
        if len(starts) and (rest or starts[-1]):
            ready = pa.Table.from_batches([*rest, batch.slice(0, starts[-1])])
            rest = [batch.slice(starts[-1])]
            if ready.num_rows:
                yield ready, np.flatnonzero(ready["_place"].to_numpy() == 1)
        elif batch.num_rows:
            rest.append(batch)
    if rest:
        ready = pa.Table.from_batches(rest)
        yield ready, np.flatnonzero(ready["_place"].to_numpy() == 1)


def _chunks(table: pa.Table, starts: np.ndarray, steps: Steps) -> Iterator[tuple[int, int, dict[str, np.ndarray], State]]:
    """(first warm row, end, inputs from there on, state) of every chunk."""
    columns = {c: table[c].cast(pa.float64()).to_numpy() for c in steps.inputs}
    role, ends = table[ROLE].to_numpy(), [*starts[1:].tolist(), table.num_rows]
    for start, end in zip(starts.tolist(), ends, strict=True):
        first = start + int(np.searchsorted(role[start:end], WARM))
        state = table["_state"][start].as_py()
        yield first, end, {c: x[first:end] for c, x in columns.items()}, (steps.none if state is None else state)


def _with_states(df: DataFrame, states: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with _place, its rows' order within a chunk, and at the first of them
    _state."""
    with within(*keys, CHUNK):
        df = df.withColumn("_place", F.row_number().over(by_date()))
    if states is None:
        return df.withColumn("_state", F.lit(None).cast("array<double>"))
    side = states.withColumnsRenamed({k: f"_key_{k}" for k in keys} | {CHUNK: "_key_chunk"})
    side = F.broadcast(side) if side.count() <= chunks.PLAN_ROWS // 4 else side  # of some hundred bytes each
    same = df[CHUNK] == side["_key_chunk"]
    for k in keys:
        same = same & df[k].eqNullSafe(side[f"_key_{k}"])
    joined = df.join(side, same, "left").select(*[df[c] for c in df.columns], F.when(F.col("_place") == 1, F.col("_state")).alias("_state"))
    with within(*keys, CHUNK):  # the order, should the join have lost it
        return joined.withColumn("_place", F.row_number().over(by_date()))


def entry_states(df: DataFrame, steps: Steps, keys: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """keys, _chunk, _state: what every chunk starts from, after a round per level."""
    states = None
    of_keys = [df.schema[k] for k in keys]
    for r in range(len(steps.rounds)):

        def compose(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            for table, starts in _groups(batches):
                later, made = table[LATER].to_numpy(), []
                for first, end, have, state in _chunks(table, starts, steps):
                    upto = int(np.searchsorted(later[first:end], True))
                    made.append(steps.summary({c: x[:upto] for c, x in have.items()}, state, r))
                held = table.select([*keys, CHUNK, "_state"]).take(pa.array(starts))
                yield from held.append_column("made", pa.array(made, _LIST)).combine_chunks().to_batches()

        def apply(batches: Iterator[pa.RecordBatch], r: int = r) -> Iterator[pa.RecordBatch]:
            none = [x for _, part in steps.rounds[r] for x in part.none]
            now = none
            for batch in batches:
                rows = batch.to_pydict()
                entry = []
                for chunk, before, made in zip(rows[CHUNK], rows["_state"], rows["made"], strict=True):
                    now = none if chunk == 0 else now
                    entry.append((before or []) + now)
                    now = steps.fold(now, made, r)
                yield batch.select([*keys, CHUNK]).append_column("_state", pa.array(entry, _LIST))

        need = [*keys, *[c for c in steps.inputs if c not in keys], CHUNK, ROLE, LATER, "_place", "_state"]
        rows = _with_states(df, states, keys).select(*need)
        numbers = T.ArrayType(T.DoubleType())
        fields = [*of_keys, T.StructField(CHUNK, T.LongType()), T.StructField("_state", numbers)]
        maps = rows.mapInArrow(compose, T.StructType([*fields, T.StructField("made", numbers)]))
        maps = maps.repartition(*keys).sortWithinPartitions(*keys, CHUNK)  # a row per chunk
        states = stored(maps.mapInArrow(apply, T.StructType(fields)))
    return states


def solved(df: DataFrame, steps: Steps, states: DataFrame | None, keys: tuple[str, ...] = (SYMBOL,)) -> DataFrame:
    """The own rows of chunks, with a column per step."""
    columns = [c for c in df.columns if c not in (CHUNK, ROLE, LATER)]
    schema = T.StructType([*[df.schema[c] for c in columns], *[T.StructField(o, T.DoubleType()) for o in steps.outs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _groups(batches):
            outs = {o: np.full(table.num_rows, np.nan) for o in steps.outs}
            for first, end, have, state in _chunks(table, starts, steps):
                made = steps.solve(have, state)
                for o in steps.outs:
                    outs[o][first:end] = made[o]
            added = [pa.array(x, from_pandas=True) for x in outs.values()]
            out = pa.table([*[table[c] for c in columns], *added], names=[*columns, *steps.outs])
            yield from out.filter(pc.equal(table[ROLE], OWN)).combine_chunks().to_batches()

    return _with_states(df, states, keys).mapInArrow(run, schema)


def scan(df: DataFrame, steps: Sequence[Step], size: int | None = None) -> DataFrame:
    """``df`` with a column per step, in chunks of about ``size`` rows of a symbol.
    Steps that look back over rows get a halo of as many."""
    known = Steps(steps)
    df = stored(df)
    placed, most = chunks.dealt(df, (SYMBOL,), size, warm=known.halo)
    return solved(placed, known, entry_states(placed, known) if most > 1 else None)
