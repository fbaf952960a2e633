"""The fixed loan schema: field constraints as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class FieldConstraint:
    name: str
    dtype: str
    required: bool = True
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: tuple | None = None
    #: Native predicate on the value; true means valid.
    check: Callable[[Column], Column] | None = None


def _num(name, dtype, lo, hi, **kw):
    return FieldConstraint(name, dtype, min_value=lo, max_value=hi, **kw)


def _cat(name, *allowed):
    return FieldConstraint(name, "categorical", allowed=allowed)


# Types, limits and domains of the loan application fields.
LOAN_SCHEMA: tuple[FieldConstraint, ...] = (
    _num("age", "integer", 18, 100),
    _cat("gender", "Male", "Female", "Other"),
    _cat("marital_status", "Single", "Married", "Divorced", "Widowed"),
    _cat("education", "High School", "Some College", "Bachelor's", "Advanced"),
    _cat("employment_status", "Employed", "Self-Employed", "Unemployed", "Retired", "Student"),
    _num("years_employed", "float", 0, 50),
    _num("annual_income", "float", 0, 10_000_000),
    _num("monthly_income", "float", 0, 1_000_000),
    _num("credit_score", "float", 300, 850),
    _num("credit_history_length", "float", 0, 50),
    _num("num_credit_accounts", "integer", 0, 50),
    _num("existing_debt", "float", 0, 10_000_000),
    _num("monthly_debt_payments", "float", 0, 100_000),
    _num("debt_to_income_ratio", "float", 0, 1),
    _num("loan_amount", "float", 1000, 10_000_000),
    _num("loan_term_months", "integer", 6, 480),
    _cat("loan_purpose", "Home Improvement", "Debt Consolidation", "Auto", "Personal", "Business", "Medical",
         "Education", "Other"),
    FieldConstraint("owns_property", "boolean"),
    _num("property_value", "float", 0, 100_000_000, nullable=True),
    FieldConstraint("has_bank_account", "boolean"),
    _num("years_with_bank", "float", 0, 50, nullable=True),
    _num("previous_loans", "integer", 0, 20),
    _num("previous_loan_defaults", "integer", 0, 10),
    _cat("state", "CA", "TX", "FL", "NY", "Other"),
    _cat("area_type", "Urban", "Suburban", "Rural"),
    FieldConstraint("has_coapplicant", "boolean"),
    _num("coapplicant_income", "float", 0, 10_000_000, nullable=True),
    _num("total_household_income", "float", 0, 20_000_000),
    FieldConstraint("loan_approved", "integer", required=False, allowed=(0, 1)),
    FieldConstraint("application_date", "datetime", required=False, nullable=True),
)
