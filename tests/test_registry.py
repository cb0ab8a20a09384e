"""Registered queries against their SQL in DuckDB, on small tables."""

import duckdb
import numpy as np
import pytest

from cairnwork.plans import registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [("null" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v)) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = plain(registry.QUERIES[name](spark, DATA).toPandas()), plain(db.execute(registry.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


#: Queries without SQL that take long; their operators have tests of their own.
SLOW = {"model_save_load", "kernel_svm", "boosted_trees", "random_forest", "feature_importance", "grid_search_cv", "stacking_fit", "two_stage_classifier", "soft_label_fit", "gmm_effective_components"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
