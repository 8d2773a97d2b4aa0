"""DuckDB SQL for the queries: bars, indicators, signals, labels and samples.

Written as one chain of common tables, each adding columns to the one before; a
query selects from the table it needs. Recurrences are recursive tables over a
running row number, labels are self-joins: other ways than the Spark plans take.
"""

from __future__ import annotations

PLACE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
S = "(partition by symbol order by dt)"


def over(n: int) -> str:
    return f"(partition by symbol order by dt rows between {n - 1} preceding and current row)"


def roll(f: str, x: str, n: int) -> str:
    return f"case when count({x}) over {over(n)} = {n} then {f}({x}) over {over(n)} end"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over {S}"


TABLES: list[tuple[str, str]] = [
    (
        "steps",
        f"""select l_returnflag as symbol, cast(l_shipdate as date) as dt, l_quantity as size, {PLACE},
            sum(cast(round(l_discount * 100) as integer) - 5) over (partition by l_returnflag order by {PLACE} rows unbounded preceding) as height
            from lineitem""",
    ),
    ("ticks", f"select symbol, dt, size, round(100 * exp(0.002 * height), 4) as price, row_number() over (partition by symbol order by {PLACE}) as k from steps"),
    (
        "bars",
        """select symbol, dt, arg_min(price, k) as open, max(price) as high, min(price) as low, arg_max(price, k) as close, cast(sum(size) as double) as volume
            from ticks where isodow(dt) < 6 group by symbol, dt""",
    ),
    (
        "t0",
        f"""select *, row_number() over {S} as rn, {lag("open")} as po, {lag("high")} as ph, {lag("low")} as pl, {lag("close")} as pc,
            date_diff('day', {lag("dt")}, dt) - 1 as gap_days from bars""",
    ),
    (
        "t1",
        f"""select *, close / nullif(pc, 0) - 1 as ret,
            greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) as true_range,
            case when high - ph > pl - low and high - ph > 0 then high - ph else 0 end as pdm,
            case when pl - low > high - ph and pl - low > 0 then pl - low else 0 end as mdm,
            case when open > po then greatest(high - open, open - po) else 0 end as dtm,
            case when open < po then greatest(open - low, po - open) else 0 end as dbm,
            (high + low + close) / 3 as tp,
            case when close > pc then close - pc when close <= pc then 0 end as gain,
            case when close < pc then pc - close when close >= pc then 0 end as loss,
            high - open as ho, open - low as ol, high - pc as hc, pc - low as cl,
            case when close > pc then 1.0 else 0.0 end as rose,
            case when close > pc then volume else 0 end as vup, case when close < pc then volume else 0 end as vdown, case when close = pc then volume else 0 end as vflat,
            case when abs(high - ph) > abs(low - pl) and high > ph then abs(high - ph) else 0 end as z,
            case when abs(low - pl) > abs(high - ph) and low < pl then abs(low - pl) else 0 end as f,
            high - low as hl,
            100 * ((close - ({roll("min", "low", 9)})) / nullif(({roll("max", "high", 9)}) - ({roll("min", "low", 9)}), 0)) as rsv,
            {roll("avg", "close", 20)} as sma20 from t0""",
    ),
    (
        "t2",
        f"""select *, sma20 as boll_mid, {roll("stddev_samp", "close", 20)} as sd20, {roll("avg", "true_range", 14)} as atr, {roll("avg", "true_range", 20)} as tr20,
            100 * (({roll("sum", "pdm", 14)}) / nullif({roll("sum", "true_range", 14)}, 0)) as pdi, 100 * (({roll("sum", "mdm", 14)}) / nullif({roll("sum", "true_range", 14)}, 0)) as mdi,
            {roll("sum", "dtm", 23)} as stm, {roll("sum", "dbm", 23)} as sbm, {roll("avg", "tp", 14)} as tpm,
            100 * (({roll("sum", "ho", 26)}) / nullif({roll("sum", "ol", 26)}, 0)) as ar, 100 * (({roll("sum", "hc", 26)}) / nullif({roll("sum", "cl", 26)}, 0)) as br,
            100 * ({roll("sum", "rose", 12)}) / 12 as psy,
            100 * ((({roll("sum", "vup", 26)}) + 0.5 * ({roll("sum", "vflat", 26)})) / nullif(({roll("sum", "vdown", 26)}) + 0.5 * ({roll("sum", "vflat", 26)}), 0)) as vr,
            {roll("sum", "z", 13)} as ddi_dmz, {roll("sum", "f", 13)} as ddi_dmf,
            close - {lag("sma20", 11)} as dpo, close - sma20 as osc,
            100 * ((close - ({roll("min", "close", 14)})) / nullif(({roll("max", "close", 14)}) - ({roll("min", "close", 14)}), 0)) as srmi from t1""",
    ),
    (
        "t3",
        f"""select *, boll_mid + 2 * sd20 as boll_up, boll_mid - 2 * sd20 as boll_low, 100 * (abs(pdi - mdi) / nullif(pdi + mdi, 0)) as dx,
            (stm - sbm) / nullif(greatest(stm, sbm), 0) as adtm, {roll("avg", "abs(tp - tpm)", 14)} as md,
            (ddi_dmz - ddi_dmf) / nullif(ddi_dmz + ddi_dmf, 0) as ddi from t2""",
    ),
    ("t4", f"""select *, {roll("avg", "dx", 14)} as adx, {roll("avg", "adtm", 23)} as adtmma, (tp - tpm) / nullif(0.015 * md, 0) as cci from t3"""),
    ("t5", f"""select *, (adx + {lag("adx", 14)}) / 2 as adxr from t4"""),
]

EMAS = (5, 10, 20, 60)
_ALL_EMAS = (5, 10, 12, 20, 26, 50, 60)


def _ewm(y: str, x: str, a: str) -> str:
    """A mean's next value; the fixture has no null between values."""
    return f"case when {x} is null then {y} when {y} is null then {x} else (1 - {a}) * {y} + {a} * {x} end"


def _recursive() -> list[tuple[str, str]]:
    """Two levels: means of columns, and means of those means."""
    source = "src as materialized (select symbol, rn, high, low, close, pl, gain, loss, hl, rsv, osc from t5)"
    first = ", ".join([*[f"close as e{n}" for n in _ALL_EMAS], "gain as eg", "loss as el", "hl as h1", "hl as h2", "rsv as k", "rsv as d", "osc as os", "close - close as dea", "low as sar", "high as ep", "0.02::double as af"])
    step = [_ewm(f"r.e{n}", "s.close", f"(2.0::double / {n + 1})") + f" as e{n}" for n in _ALL_EMAS]
    a9, h1, k = "(2.0::double / 10)", _ewm("r.h1", "s.hl", "(2.0::double / 10)"), _ewm("r.k", "s.rsv", "(1.0::double / 3)")
    dif = f"(({_ewm('r.e12', 's.close', '(2.0::double / 13)')}) - ({_ewm('r.e26', 's.close', '(2.0::double / 27)')}))"
    step += [_ewm("r.eg", "s.gain", "(1.0::double / 14)"), _ewm("r.el", "s.loss", "(1.0::double / 14)"), h1, _ewm("r.h2", f"({h1})", a9), k, _ewm("r.d", f"({k})", "(1.0::double / 3)"), _ewm("r.os", "s.osc", "(2.0::double / 7)"), _ewm("r.dea", dif, a9)]
    step += ["least(r.sar + r.af * (r.ep - r.sar), s.pl, s.low)", "greatest(r.ep, s.high)", "case when s.high > r.ep then least(r.af + 0.02, 0.2) else r.af end"]
    body = f"select symbol, rn, {first} from src where rn = 1 union all select s.symbol, s.rn, {', '.join(step)} from rec r join src s on s.symbol = r.symbol and s.rn = r.rn + 1"
    r1 = """select t.*, e5 as ema_5, e10 as ema_10, e20 as ema_20, e60 as ema_60, e20 as kc_mid, e20 + 2 * tr20 as kc_up, e20 - 2 * tr20 as kc_low,
        e12 - e26 as macd_dif, dea as macd_dea, 2 * (e12 - e26 - dea) as macd_hist, e10 - e50 as dma, k as kdj_k, d as kdj_d, 3 * k - 2 * d as kdj_j,
        case when el = 0 and eg > 0 then 100 else 100 - 100 / (1 + eg / nullif(el, 0)) end as rsi, os as osc_signal, h1 / nullif(h2, 0) as mass, r.sar
        from t5 t join rec r on t.symbol = r.symbol and t.rn = r.rn"""
    slopes = ", ".join(f"ema_{n} - {lag(f'ema_{n}')} as ema_{n}_slope" for n in EMAS)
    r2 = f"select *, {slopes}, {roll('avg', 'dma', 10)} as ama, {roll('sum', 'mass', 25)} as mi from r1"
    return [("", source), ("rec", body), ("r1", r1), ("r2", r2)]


def crossed(a: str, b: str) -> str:
    return f"coalesce({a} > {b} and {lag(a)} <= {lag(b)}, false)"


def turns(x: str) -> str:
    return f"coalesce({lag(x)} < 0 and lead({x}) over {S} > 0, false)"


SIGNAL_SQL = {
    "macd": f"({crossed('macd_dif', 'macd_dea')} and macd_hist > 0)",
    "kdj": f"({crossed('kdj_k', 'kdj_d')} and kdj_k <= 70)",
    "ema": f"coalesce(ema_20 > ema_60 and close > open and close >= ema_20 and open <= ema_20 and {lag('close')} <= {lag('ema_20')}, false)",
    "sar": f"coalesce({lag('sar')} > greatest({lag('open')}, {lag('close')}) and sar <= least(open, close), false)",
    "dmi": f"({crossed('pdi', 'mdi')} or {crossed('adx', 'adxr')})",
    "adtm": f"({crossed('adtm', 'adtmma')} and adtm < 0.5)",
    "ddi": turns("ddi"),
    "dpo": turns("dpo"),
    "osc": crossed("osc", "osc_signal"),
    "srmi": turns("srmi"),
}


def open_label(table: str, days: int, loss: float, gain: float) -> str:
    """(symbol, dt, label) of entries at the open."""
    hit = f"p.low <= e.open - {loss} * e.atr or p.high >= e.open + {gain} * e.atr"
    return f"""select e.symbol, e.dt,
        case when any_value(e.open) is null or any_value(e.atr) is null or count(*) <= 1 then null
             when min(case when {hit} then p.dt end) is null then 0.0::double
             when arg_min(p.low, p.dt) filter (where {hit}) <= any_value(e.open) - {loss} * any_value(e.atr) then -1.0::double else 1.0::double end as label
        from {table} e join {table} p on p.symbol = e.symbol and p.dt between e.dt and e.dt + {days} group by e.symbol, e.dt"""


def worst_label(table: str, days: int = 15, loss: float = 2.0, gain: float = 3.0) -> list[tuple[str, str]]:
    """Tables worst_path and worst (symbol, dt, label: the worse of two entries)."""
    ahead = f"""select symbol, dt, close as entry_a, atr as atr_a, lead(open) over {S} as entry_b, lead(atr) over {S} as atr_b, lead(dt) over {S} as d1 from {table}"""

    def outcome(e: str, a: str) -> str:
        hit = f"p.low <= {e} - {loss} * {a} or p.high >= {e} + {gain} * {a}"
        return f"""case when any_value({e}) is null or any_value({a}) is null then null when min(case when {hit} then p.dt end) is null then 0.0::double
            when arg_min(p.low, p.dt) filter (where {hit}) <= any_value({e}) - {loss} * any_value({a}) then -1.0::double else 1.0::double end"""

    worst = f"""select e.symbol, e.dt, case when any_value(e.d1) is null then null else least({outcome("e.entry_a", "e.atr_a")}, {outcome("e.entry_b", "e.atr_b")}) end as label
        from worst_entry e left join {table} p on p.symbol = e.symbol and p.dt between e.d1 and e.d1 + {days} group by e.symbol, e.dt"""
    return [("worst_entry", ahead), ("worst", worst)]


def chain(select: str, recurrences: bool = False, more: list[tuple[str, str]] | None = None) -> str:
    """WITH ... select, with the tables up to t5, the recurrences if asked for,
    and ``more``."""
    parts = list(TABLES)
    if recurrences:
        parts += _recursive()
    parts += more or []
    body = ",\n".join(f"{name} as ({text})" if name else text for name, text in parts)
    return f"with {'recursive ' if recurrences else ''}{body}\n{select}"


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)
