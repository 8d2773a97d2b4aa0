"""Hand-made bars and a comparison of a query with its SQL twin."""

from __future__ import annotations

import os
from datetime import date, timedelta

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def bars(spark, rows, symbol="X", start=date(2020, 1, 6)):
    """Bars of (open, high, low, close, volume) or close alone, on weekdays."""
    day, out = start, []
    for r in rows:
        while day.weekday() > 4:
            day += timedelta(days=1)
        o, h, l, c, v = r if isinstance(r, tuple) else (r, r, r, r, 1.0)  # noqa: E741
        out.append((symbol, day, *[None if x is None else float(x) for x in (o, h, l, c, v)]))
        day += timedelta(days=1)
    return spark.createDataFrame(out, "symbol string, dt date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[0] for r in df.orderBy("symbol", "dt").select(name).collect()]


def twin(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def agree(df, names, rows):
    order = sorted(names)
    assert sorted(df.columns) == order
    mine = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    theirs = sorted((tuple(r[i] for i in at) for r in rows), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs


def lines(folder, prices, symbol="A"):
    """A lineitem table of at least one row per (weekday, price) whose walk stands at that
    price, or near it, at the day's end; None: the price stays. Returns its folder."""
    import math

    import pyarrow as pa
    import pyarrow.parquet as pq

    rows, height, day = [], 0, date(1995, 1, 2)
    for n, price in enumerate(prices):
        while day.weekday() > 4:
            day += timedelta(days=1)
        target = height if price is None else round(math.log(price / 100) / 0.002)
        steps = []
        while height + sum(steps) != target:
            steps.append(max(-5, min(5, target - height - sum(steps))))
        for k, step in enumerate(steps or [0]):
            rows.append((n * 10_000 + k, 1, 1, 1, 1.0, 1.0, (step + 5) / 100, 0.0, symbol, "F", day))
        height = target
        day += timedelta(days=1)
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    types = [pa.int64()] * 3 + [pa.int32()] + [pa.float64()] * 4 + [pa.string()] * 2 + [pa.timestamp("us")]
    columns = [pa.array([r[i] for r in rows], t) if t != pa.timestamp("us") else pa.array([r[i] for r in rows], pa.date32()).cast(t) for i, t in enumerate(types)]
    pq.write_table(pa.table(columns, names=names), f"{folder}/lineitem.parquet")
    return str(folder)
