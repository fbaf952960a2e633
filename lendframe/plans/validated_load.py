"""Validate, report, clean, preprocess and build features for one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lendframe.operators import validate
from lendframe.operators.rules import RuleBook
from lendframe.plans.feature_set import FeatureSet
from lendframe.plans.preprocess import PreprocessConfig, Preprocessing


@dataclass
class Loaded:
    violations: DataFrame
    score: float
    cleaned: DataFrame
    prepared: DataFrame
    features: DataFrame | None


def validated_load(df: DataFrame, id_col: str = "application_id", label: str = "loan_approved",
                   preprocess: PreprocessConfig | None = None, features: FeatureSet | None = None) -> Loaded:
    """Everything but the quality score and the fits stays lazy."""
    result = validate.validate_all(df, id_col, rule_book=RuleBook())
    if result.stopped:
        raise validate.ValidationError(f"missing required fields {result.schema.missing}")
    score = validate.quality_score(df).first()["score"]
    cleaned = validate.clean_by_schema(df)
    pre = Preprocessing(preprocess or PreprocessConfig(id_col=id_col, target=label, steps=("duplicates", "missing", "outliers")))
    prepared = pre.fit_transform(cleaned)
    out = features.fit(prepared).transform(prepared) if features else None
    return Loaded(result.violations, score, cleaned, prepared, out)


def row_counts(loaded: Loaded) -> DataFrame:
    """Rows per stage."""
    one = lambda name, d: d.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"))
    return one("cleaned", loaded.cleaned).unionByName(one("prepared", loaded.prepared)).unionByName(one("violations", loaded.violations))
