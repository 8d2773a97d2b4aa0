"""Every query of the library against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest

from quillbar.registry import ORACLE_SQL, QUERIES
from tests.helpers import DATA, agree, lines, twin


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    agree(QUERIES[name](spark, DATA), *twin(DATA, ORACLE_SQL[name]))


def test_classifier(spark):
    rows = QUERIES["classifier_eval"](spark, DATA).collect()
    assert rows and all(0 <= r["accuracy"] <= 1 and 0 <= r["macro_f1"] <= 1 for r in rows)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Prices that stand still for longer than a window, before and after they moved.
STILL = [100 + 7 * ((k * k) % 5) for k in range(70)] + [None] * 14 + [90, 104, 97, 110, 95, 101] + [None] * 12 + [100 + 3 * ((k * k) % 7) for k in range(30)]


@pytest.mark.parametrize("name", ["kdj", "indicators_all_raw", "indicators_in_chunks", "features_model_clean", "scaler_apply", "signal_kdj", "signals_all", "signal_counts", "signal_spans"])
def test_twin_over_still_prices(spark, tmp_path, name):
    """Nulls between values: the exponential means' one difference from plain means."""
    folder = lines(tmp_path, STILL)
    agree(QUERIES[name](spark, folder), *twin(folder, ORACLE_SQL[name]))


#: The walk falls to 0.0000, stays there and rises again.
FALLEN = [100 + 7 * ((k * k) % 5) for k in range(40)] + [0.00004] + [None] * 7 + [80 + 5 * ((k * k) % 7) for k in range(30)]


@pytest.mark.parametrize("name", ["rank_ic_by_date", "rank_ic_summary", "strategy_metrics"])
def test_twin_over_prices_of_nothing(spark, tmp_path, name):
    """Gains on a price of 0 are rows, too: NaN and infinite, as in the SQL."""
    folder = lines(tmp_path, FALLEN)
    names, rows = twin(folder, ORACLE_SQL[name])
    plain = lambda rows: sorted((["nan" if isinstance(v, float) and v != v else v for v in r] for r in rows), key=repr)
    assert plain([r[c] for c in names] for r in QUERIES[name](spark, folder).collect()) == plain(rows)
