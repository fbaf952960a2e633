"""Preparation of the 28 model inputs, learnt from the training part."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendframe.operators import encode, scale
from lendframe.operators.impute import fit_imputer, impute
from lendframe.sources.loans import BOOLEAN, CATEGORICAL, NUMERIC

X = [*NUMERIC, *BOOLEAN, *CATEGORICAL]


class Preparation:
    """Imputation, category codes and standard scaling, all learnt from the training part."""

    def __init__(self, train: DataFrame):
        listed = self._plain(train)
        self.imputer = fit_imputer(listed.select(*X))
        filled = impute(listed, self.imputer)
        self.categories = encode.fit_categories(filled, CATEGORICAL)
        self.scaler = scale.fit_scaler(encode.label_codes(filled, self.categories), X)

    @staticmethod
    def _plain(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("int") for c in BOOLEAN})

    def __call__(self, df: DataFrame) -> DataFrame:
        d = encode.label_codes(impute(self._plain(df), self.imputer), self.categories)
        return scale.apply_scaler(d, self.scaler)
