"""The search tries the library's own default, and the bench has the slow queries."""

import sys

import __spark_entry__ as entry
import bench
from lendframe.plans import catalog_models


def test_search_grid_has_the_default_and_nothing_below_the_reference(spark, sf, monkeypatch):
    seen = {}

    def search(df, label, build, space, **kw):
        seen.update(space)
        return spark.range(1)
    monkeypatch.setattr(catalog_models, "_data", lambda t, split=True: None)
    monkeypatch.setattr(catalog_models.ml, "search", search)
    entry.queries()["p10_search"](spark, sf)
    assert 100 in seen["trees"] and min(seen["trees"]) >= 50


def test_bench_has_the_slow_queries():
    assert {"d4_fuzzy_leaders", "m3_knn_impute", "l6_knn_classifier", "g4_stacking", "p10_search"} <= set(bench.HEADLINE)
    # the corpus operators may be absent
    assert {n for n in bench.HEADLINE if not n.startswith("op") and n != "pipeline"} <= set(entry.queries())


def test_other_queries_stay_when_a_library_of_the_corpus_operators_is_missing(monkeypatch):
    names = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    for module in [m for m in sys.modules if m.startswith("lendframe.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, module)
    for module in ("ahocorasick", "tiktoken", "sentencepiece", "xxhash"):
        monkeypatch.setitem(sys.modules, module, None)  # importing it raises ImportError
    assert set(entry.queries()) == names
    assert not any(n.startswith("op") for n in entry.oracle_sql())
