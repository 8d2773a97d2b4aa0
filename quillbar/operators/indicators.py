"""Technical indicators over bars, built only as far as they are asked for.

A family is layers of columns made by windows, recurrences over them, and columns made
of a row's own values after them; a layer may use windows over the columns of the
layers before it. Rows are dealt by symbol and chunk of time with a halo of as many rows
as windows and steps look back over (see functions.chunks), so a symbol's history is not
one task's. All windows share that one shuffle and sort, and so do the recurrences.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunks
from ..functions.chunks import CHUNK, LATER, OWN, ROLE
from ..functions.kernels import SYMBOL, at_least, change, deviation, gap_days, highest, lowest, mean, prev, ratio, rsum, where, within
from ..functions.recurrences import Back, Ewm, Minus, Over, Step, Steps, Stop, Sum, entry_states, solved, span
from ..sources.bars import stored

Layer = dict[str, Column]


@dataclass(frozen=True)
class Params:
    """Periods and multipliers of every indicator."""

    # The usual periods.
    ema: tuple[int, ...] = (5, 10, 20, 60)
    boll: int = 20
    boll_width: float = 2.0
    sar_step: float = 0.02
    sar_most: float = 0.2
    kc: int = 20
    kc_width: float = 2.0
    macd: tuple[int, int, int] = (12, 26, 9)
    dmi: int = 14
    dma: tuple[int, int, int] = (10, 50, 10)
    adtm: int = 23
    cci: int = 14
    kdj: int = 9
    kdj_smooth: int = 3
    rsi: int = 14
    arbr: int = 26
    psy: int = 12
    vr: int = 26
    atr: int = 14
    ddi: int = 13
    dpo: int = 20
    osc: int = 20
    osc_signal: int = 6
    mi: tuple[int, int] = (9, 25)
    srmi: int = 14
    #: Whether exponential means pass over nulls without decay (see recurrences.Ewm).
    ignore_na: bool = False

    @property
    def reach(self) -> int:
        """Rows that the windows of any family look back over, all its layers together."""
        single = (self.boll, self.kc, self.arbr, self.psy, self.vr, self.atr, self.ddi, self.kdj, self.osc, self.srmi)
        return 2 + max(*single, 4 * self.dmi, 2 * self.adtm, 2 * self.cci, self.dpo + self.dpo // 2 + 1)


@dataclass
class Family:
    """``before``: layers that may use windows. ``after``: layers of a row's own values,
    behind the steps."""

    before: list[Layer] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    after: list[Layer] = field(default_factory=list)


def true_range() -> Column:
    """Of the first row: high - low, since greatest skips nulls."""
    c = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - c), F.abs(F.col("low") - c))


def families(p: Params, dialect: str) -> dict[str, Family]:
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))  # noqa: E741
    col = F.col
    ewm = partial(Ewm, ignore_na=p.ignore_na)
    tr = {"_tr": true_range()}
    fast, slow, signal = p.macd
    short, long, smooth = p.dma
    up, down, rise = change("high"), -change("low"), change("close")
    dh, dl = F.abs(change("high")), F.abs(change("low"))
    before_open = prev("open")
    made: dict[str, Family] = {}

    made["gap"] = Family(before=[{"gap_days": at_least(gap_days(), 0).cast("int") if dialect == "model" else gap_days()}])
    made["ret"] = Family(before=[{"ret": ratio(c, prev("close")) - 1}])
    made["ema"] = Family(
        steps=[s for n in p.ema for s in (ewm(f"ema_{n}", "close", span(n)), Back(f"_ema_{n}", f"ema_{n}"), Minus(f"ema_{n}_slope", f"ema_{n}", f"_ema_{n}"))],
    )
    made["boll"] = Family(
        before=[{"boll_mid": mean("close", p.boll), "_sd": deviation("close", p.boll)}, {"boll_up": col("boll_mid") + p.boll_width * col("_sd"), "boll_low": col("boll_mid") - p.boll_width * col("_sd")}],
    )
    made["tr"] = Family(before=[{"true_range": true_range()}])
    made["atr"] = Family(before=[tr, {"atr": mean("_tr", p.atr)}])
    made["sar"] = Family(steps=[Stop("sar", step=p.sar_step, most=p.sar_most)])
    made["kc"] = Family(
        before=[tr, {"_reach": p.kc_width * mean("_tr", p.kc)}],
        steps=[ewm("kc_mid", "close", span(p.kc))],
        after=[{"kc_up": col("kc_mid") + col("_reach"), "kc_low": col("kc_mid") - col("_reach")}],
    )
    made["macd"] = Family(
        steps=[ewm("_fast", "close", span(fast)), ewm("_slow", "close", span(slow)), Minus("macd_dif", "_fast", "_slow"), ewm("macd_dea", "macd_dif", span(signal))],
        after=[{"macd_hist": 2 * (col("macd_dif") - col("macd_dea"))}],
    )
    made["dmi"] = Family(
        before=[
            tr | {"_pdm": where((up > down) & (up > 0), up), "_mdm": where((down > up) & (down > 0), down)},
            {"pdi": 100 * ratio(rsum("_pdm", p.dmi), rsum("_tr", p.dmi)), "mdi": 100 * ratio(rsum("_mdm", p.dmi), rsum("_tr", p.dmi))},
            {"_dx": 100 * ratio(F.abs(col("pdi") - col("mdi")), col("pdi") + col("mdi"))},
            {"adx": mean("_dx", p.dmi)},
            {"adxr": (col("adx") + prev("adx", p.dmi)) / 2},
        ],
    )
    made["dma"] = Family(
        steps=[ewm("_short", "close", span(short)), ewm("_long", "close", span(long)), Minus("dma", "_short", "_long"), Sum("_dma", "dma", smooth)],
        after=[{"ama": col("_dma") / smooth}],
    )
    made["adtm"] = Family(
        before=[
            {"_dtm": where(o > before_open, F.greatest(h - o, o - before_open)), "_dbm": where(o < before_open, F.greatest(o - l, before_open - o))},
            {"_stm": rsum("_dtm", p.adtm), "_sbm": rsum("_dbm", p.adtm)},
            {"adtm": ratio(col("_stm") - col("_sbm"), F.greatest("_stm", "_sbm"))},
            {"adtmma": mean("adtm", p.adtm)},
        ],
    )
    typical = (h + l + c) / 3
    made["cci"] = Family(
        before=[{"_tp": typical}, {"_tpm": mean("_tp", p.cci)}, {"_md": mean(F.abs(col("_tp") - col("_tpm")), p.cci)}, {"cci": ratio(col("_tp") - col("_tpm"), 0.015 * col("_md"))}],
    )
    floor, roof = lowest("low", p.kdj), highest("high", p.kdj)
    made["kdj"] = Family(
        before=[{"_rsv": 100 * ratio(c - floor, roof - floor)}],
        steps=[ewm("kdj_k", "_rsv", 1 / p.kdj_smooth), ewm("kdj_d", "kdj_k", 1 / p.kdj_smooth)],
        after=[{"kdj_j": 3 * col("kdj_k") - 2 * col("kdj_d")}],
    )
    gain, loss = col("_gain"), col("_loss")
    made["rsi"] = Family(
        before=[{"_up": at_least(rise, 0.0), "_down": at_least(-rise, 0.0)}],
        steps=[ewm("_gain", "_up", 1 / p.rsi), ewm("_loss", "_down", 1 / p.rsi)],
        after=[{"rsi": F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))}],
    )
    made["arbr"] = Family(
        before=[
            {"_ho": h - o, "_ol": o - l, "_hc": h - prev("close"), "_cl": prev("close") - l},
            {"ar": 100 * ratio(rsum("_ho", p.arbr), rsum("_ol", p.arbr)), "br": 100 * ratio(rsum("_hc", p.arbr), rsum("_cl", p.arbr))},
        ],
    )
    made["psy"] = Family(before=[{"_rose": where(rise > 0, F.lit(1.0))}, {"psy": 100 * rsum("_rose", p.psy) / p.psy}])
    half_flat = 0.5 * rsum("_vflat", p.vr)
    made["vr"] = Family(
        before=[
            {"_vup": where(rise > 0, v), "_vdown": where(rise < 0, v), "_vflat": where(rise == 0, v)},
            {"vr": 100 * ratio(rsum("_vup", p.vr) + half_flat, rsum("_vdown", p.vr) + half_flat)},
        ],
    )
    made["ddi"] = Family(
        before=[
            {"_z": where((dh > dl) & (h > prev("high")), dh), "_f": where((dl > dh) & (l < prev("low")), dl)},
            {"ddi_dmz": rsum("_z", p.ddi), "ddi_dmf": rsum("_f", p.ddi)},
            {"ddi": ratio(col("ddi_dmz") - col("ddi_dmf"), col("ddi_dmz") + col("ddi_dmf"))},
        ],
    )
    made["dpo"] = Family(before=[{"_sma": mean("close", p.dpo)}, {"dpo": c - prev("_sma", p.dpo // 2 + 1)}])
    made["osc"] = Family(before=[{"osc": c - mean("close", p.osc)}], steps=[ewm("osc_signal", "osc", span(p.osc_signal))])
    made["mi"] = Family(
        before=[{"_hl": h - l}],
        steps=[ewm("_hl1", "_hl", span(p.mi[0])), ewm("_hl2", "_hl1", span(p.mi[0])), Over("_mass", "_hl1", "_hl2"), Sum("mi", "_mass", p.mi[1])],
    )
    made["srmi"] = Family(before=[{"srmi": 100 * ratio(c - lowest("close", p.srmi), highest("close", p.srmi) - lowest("close", p.srmi))}])
    return made


#: Columns of the families that have more than one, or other names than their own.
NAMES = {
    "boll": ["boll_mid", "boll_up", "boll_low"],
    "kc": ["kc_mid", "kc_up", "kc_low"],
    "macd": ["macd_dif", "macd_dea", "macd_hist"],
    "dmi": ["pdi", "mdi", "adx", "adxr"],
    "dma": ["dma", "ama"],
    "adtm": ["adtm", "adtmma"],
    "kdj": ["kdj_k", "kdj_d", "kdj_j"],
    "arbr": ["ar", "br"],
    "ddi": ["ddi", "ddi_dmz", "ddi_dmf"],
    "osc": ["osc", "osc_signal"],
}

#: The order of the indicator columns; "ret" is of the model dialect alone.
RAW = ("gap", "ema", "boll", "sar", "kc", "macd", "dmi", "dma", "adtm", "cci", "kdj", "rsi", "arbr", "psy", "vr", "atr", "ddi", "dpo", "osc", "mi", "srmi")
MODEL = ("ret", *RAW)


def _layers(df: DataFrame, each: Iterable[list[Layer]]) -> DataFrame:
    found = list(each)
    for k in range(max(map(len, found), default=0)):
        columns: Layer = {}
        for layers in found:
            if k < len(layers):
                columns |= layers[k]
        df = df.withColumns(columns)
    return df


def indicators(bars: DataFrame, which: Iterable[str] = RAW, params: Params | None = None, dialect: str = "raw", size: int | None = None) -> DataFrame:
    """``bars`` with the columns of the families ``which``. Dialects: ``raw`` keeps
    all rows; ``model`` clips gap_days at 0 (rows are cleaned by features()). Bars are
    written once, and chunks have ``size`` rows or more; a history of several is read
    again for each level of its recurrences."""
    if dialect not in ("raw", "model"):
        raise ValueError(f"no dialect {dialect}")
    which, params = list(which), params or Params()
    with within(SYMBOL, CHUNK):
        every = families(params, dialect)
        chosen = [every[k] for k in which]
        steps = Steps([s for f in chosen for s in f.steps])
        placed, most = chunks.dealt(stored(bars), (SYMBOL,), size, cold=params.reach, warm=steps.halo)
        df = _layers(placed, [f.before for f in chosen])
    if steps.steps:
        df = solved(df, steps, entry_states(df, steps) if most > 1 else None)
    else:
        df = df.where(F.col(ROLE) == OWN).drop(CHUNK, ROLE, LATER)
    return _layers(df, [f.after for f in chosen]).select(*bars.columns, *columns_of(which, params))


def columns_of(which: Iterable[str], params: Params | None = None) -> list[str]:
    """Names of the families' columns; needs no session."""
    fast = {"gap": ["gap_days"], "tr": ["true_range"]}
    fast["ema"] = [x for n in (params or Params()).ema for x in (f"ema_{n}", f"ema_{n}_slope")]
    return [c for k in which for c in fast.get(k, NAMES.get(k, [k]))]


def features(bars: DataFrame, params: Params | None = None) -> DataFrame:
    """The model's input: all indicators and the return, rows with any null gone
    (extra columns of the bars count, too)."""
    return indicators(bars, MODEL, params, "model").na.drop("any")


def feature_columns() -> list[str]:
    return ["open", "high", "low", "close", "volume", *columns_of(MODEL)]
