"""A quick slice of the registered queries against their DuckDB oracle (sf0.001)."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["band_power", "zscore", "epoching", "time_features", "dwt_energy_entropy", "higuchi_fd", "dfa_exponent",
         "overall_metrics", "roc_auc_ovr", "stratified_folds", "select_k_best", "knn_classify", "xml_ratings",
         "early_stop_epoch", "tumbling_features", "notch", "bandpass", "clean_full", "evaluation_report",
         "ml_discriminant_2d"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = _norm(got), _norm(want)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and not pd.api.types.is_bool_dtype(a[c]):
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
