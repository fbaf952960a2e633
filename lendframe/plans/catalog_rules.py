"""Queries: business rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lendframe.operators.rules import RuleBook, rule_violations
from lendframe.plans.registry import query

_CAP = ("case loan_purpose when 'Auto' then 1.0e0 when 'Personal' then 0.5e0 when 'Debt Consolidation' then 1.0e0 "
        "when 'Home Improvement' then 2.0e0 when 'Business' then 3.0e0 when 'Medical' then 0.5e0 "
        "when 'Education' then 2.0e0 else 1.0e0 end")
_TMIN = ("case loan_purpose when 'Auto' then 12 when 'Personal' then 12 when 'Debt Consolidation' then 24 "
         "when 'Home Improvement' then 12 when 'Business' then 12 when 'Medical' then 6 when 'Education' then 60 "
         "when 'Other' then 12 else 6 end")
_TMAX = ("case loan_purpose when 'Auto' then 84 when 'Personal' then 60 when 'Debt Consolidation' then 84 "
         "when 'Home Improvement' then 240 when 'Business' then 120 when 'Medical' then 60 when 'Education' then 240 "
         "when 'Other' then 60 else 480 end")
_PMT = "loan_amount * 0.005e0 * pow(1.005e0, loan_term_months) / (pow(1.005e0, loan_term_months) - 1e0)"
_DSR = f"(monthly_debt_payments + {_PMT}) / monthly_income"
_HH = "(annual_income + case when has_coapplicant then coalesce(coapplicant_income, 0e0) else 0e0 end)"
_NOCO = ("coapplicant_income_without_coapplicant", "not has_coapplicant and coapplicant_income > 0",
         "coapplicant_income", "0e0")

# rule -> [(violation type, where, actual, bound)] in plain SQL
EXPECTED = {
    "b1_income_consistency": [("income_inconsistency",
        "abs(monthly_income - annual_income / 12e0) > 0.15e0 * (annual_income / 12e0)", "monthly_income", "annual_income / 12e0")],
    "b2_debt_income_consistency": [("debt_ratio_inconsistency",
        "monthly_income > 0 and abs(monthly_debt_payments / monthly_income - debt_to_income_ratio) > 0.02e0",
        "debt_to_income_ratio", "monthly_debt_payments / monthly_income")],
    "b3_household_income_consistency": [_NOCO, ("household_income_inconsistency",
        f"abs(total_household_income - {_HH}) > {_HH} * 0.01e0", "total_household_income", _HH)],
    "b4_loan_to_income_ratio": [("excessive_loan_to_income",
        f"annual_income > 0 and loan_amount / annual_income > {_CAP}", "loan_amount / annual_income", _CAP)],
    "b5_debt_service_capacity": [("excessive_debt_service", f"monthly_income > 0 and {_DSR} > 0.43e0", _DSR, "0.43e0")],
    "b6_loan_term_reasonableness": [("unreasonable_loan_term",
        f"loan_term_months < {_TMIN} or loan_term_months > {_TMAX}", "loan_term_months",
        f"case when loan_term_months < {_TMIN} then {_TMIN} else {_TMAX} end")],
    "b7_credit_history_consistency": [
        ("impossible_credit_history", "credit_history_length > greatest(0, age - 18)", "credit_history_length", "greatest(0, age - 18)"),
        ("credit_history_account_mismatch", "credit_history_length > 2 and num_credit_accounts = 0", "credit_history_length", "2e0")],
    "b8_defaults_vs_credit_score": [
        ("credit_score_default_mismatch", "credit_score >= 700 and previous_loan_defaults >= 2", "credit_score", "previous_loan_defaults"),
        ("low_score_no_defaults", "credit_score < 500 and previous_loan_defaults = 0", "credit_score", "previous_loan_defaults")],
    "b9_property_loan_alignment": [
        ("missing_property_value", "owns_property and (property_value is null or property_value <= 0)", "property_value", "0e0"),
        ("home_improvement_non_owner", "loan_purpose = 'Home Improvement' and not owns_property", "property_value", "0e0")],
    "b10_collateral_adequacy": [("excessive_loan_to_value",
        "owns_property and loan_purpose = 'Home Improvement' and loan_amount / property_value > 0.8e0",
        "loan_amount / property_value", "0.8e0")],
    "b11_employment_income_alignment": [
        ("unemployed_high_income", "employment_status = 'Unemployed' and annual_income > 10000", "annual_income", "10000e0"),
        ("student_high_income", "employment_status = 'Student' and annual_income > 50000", "annual_income", "50000e0")],
    "b12_employment_stability": [("impossible_employment_duration", "years_employed > greatest(0, age - 16)",
        "years_employed", "greatest(0, age - 16)")],
    "b13_banking_relationship_consistency": [
        ("missing_banking_tenure", "has_bank_account and (years_with_bank is null or years_with_bank < 0)", "years_with_bank", "0e0"),
        ("impossible_banking_tenure", "years_with_bank > age", "years_with_bank", "age")],
    "b14_age_loan_term_alignment": [("loan_extends_past_retirement", "age + loan_term_months / 12e0 > 75",
        "age + loan_term_months / 12e0", "75e0")],
    "b15_coapplicant_data_consistency": [_NOCO, ("missing_coapplicant_income",
        "has_coapplicant and (coapplicant_income is null or coapplicant_income <= 0)", "coapplicant_income", "0e0")],
}


def _rows(rule: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT application_id, {extra}'{vt}' AS violation_type, round(cast({act} as double), 6) AS actual, "
        f"round(cast({bnd} as double), 6) AS bound FROM loan_applications WHERE {pred}"
        for vt, pred, act, bnd in EXPECTED[rule])


_ALL = " UNION ALL ".join(_rows(k, f"'{k.split('_', 1)[1]}' AS rule, ") for k in EXPECTED)


@query("b0_rule_violations",
       f"SELECT rule, violation_type, count(*) AS violations, count(distinct application_id) AS applications "
       f"FROM ({_ALL}) GROUP BY rule, violation_type")
def _(t):
    return RuleBook().summary(t.loans).orderBy("rule", "violation_type")


@query("b0_rule_status",
       "WITH names AS (" + " UNION ALL ".join(f"SELECT '{k.split('_', 1)[1]}' AS rule" for k in EXPECTED)
       + f"), v AS (SELECT rule, count(*) AS n FROM ({_ALL}) GROUP BY rule) "
       "SELECT names.rule, coalesce(n, 0) AS violations, coalesce(n, 0) = 0 AS passed FROM names LEFT JOIN v ON names.rule = v.rule")
def _(t):
    return RuleBook().status(t.loans)


def _one(key: str):
    @query(key, _rows(key))
    def _(t):
        return rule_violations(t.loans, key.split("_", 1)[1]).select(
            "application_id", "violation_type", F.round("actual", 6).alias("actual"),
            F.round("bound", 6).alias("bound"))


for _key in EXPECTED:
    _one(_key)
