"""Registered queries against their SQL twins. LENDFRAME_ALL=1 runs all of them; the default is a cross-section."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

duckdb = pytest.importorskip("duckdb")
SOME = """a1_column_profile a2_describe a3_top_values a6_histogram a9_box_numbers b0_rule_violations b0_rule_status d1_members
d2_keep_first d6_keep_best d7_field_agreement e1_one_hot e2_label e4_target_smoothed e5_target_out_of_fold f5_ratios f8_recipe_a f12_api_features
g2_hard_vote_ties g6_weight_search g9_diversity k6_threshold_sweep k7_ensemble_confidence k11_stream_windows l6_knn_classifier l11_explain
m1_impute_median m3_knn_impute m4_missing_summary n1_standard n6_quantile_uniform o4_local_outlier_factor o5_clip p2_stratified_split p5_time_splits
p6_group_kfold q3_consistency r2_correlated r4_mutual_information s4_json_sessions t1_to_integer t5_to_datetime u4_retention u9_early_stopping
v3_range_samples v10_validate_all w1_preprocess x1_classification x3_roc_auc x8_fairness""".split()
SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("LENDFRAME_ALL") else SOME


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def test_registry():
    q = entry.queries()
    assert set(SQL) <= set(q)
    assert len(q) > 180 and len(SQL) > 150


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
