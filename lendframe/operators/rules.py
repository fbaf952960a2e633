"""Business rules on loan applications: one projection finds every violation of a row.

A rule is data: predicates and reported values are Spark SQL expressions, so
all rules run in one code-generated scan without a shuffle. A null in a
needed field makes a predicate null, which counts as "not violated".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Largest loan / annual income per purpose (1.0 for any other purpose).
LOAN_TO_INCOME_CAP = {
    "Auto": 1.0, "Personal": 0.5, "Debt Consolidation": 1.0, "Home Improvement": 2.0,
    "Business": 3.0, "Medical": 0.5, "Education": 2.0, "Other": 1.0,
}
# Term limits in months per purpose (6 to 480 for any other purpose).
TERM_LIMITS = {
    "Auto": (12, 84), "Personal": (12, 60), "Debt Consolidation": (24, 84),
    "Home Improvement": (12, 240), "Business": (12, 120), "Medical": (6, 60),
    "Education": (60, 240), "Other": (12, 60),
}


@dataclass(frozen=True)
class Check:
    """One violation output of a rule."""

    violation_type: str
    predicate: str
    actual: str
    bound: str


@dataclass(frozen=True)
class Rule:
    name: str
    checks: tuple[Check, ...]


def _by_purpose(table: dict[str, float], default: float) -> str:
    pairs = ", ".join(f"'{k}', {v}D" for k, v in table.items())
    return f"coalesce(try_element_at(map({pairs}), loan_purpose), {default}D)"


_LTI = _by_purpose(LOAN_TO_INCOME_CAP, 1.0)
_TERM_MIN = _by_purpose({k: float(v[0]) for k, v in TERM_LIMITS.items()}, 6.0)
_TERM_MAX = _by_purpose({k: float(v[1]) for k, v in TERM_LIMITS.items()}, 480.0)
_GROWTH = "pow(1.005D, loan_term_months)"
_PAYMENT = f"(loan_amount * 0.005D * {_GROWTH} / ({_GROWTH} - 1D))"
_SERVICE = f"((coalesce(monthly_debt_payments, 0D) + {_PAYMENT}) / monthly_income)"
_EXPECTED_HOUSEHOLD = "(annual_income + if(has_coapplicant, coalesce(coapplicant_income, 0D), 0D))"
_ORPHAN_INCOME = Check("coapplicant_income_without_coapplicant",
                       "not has_coapplicant and coapplicant_income > 0", "coapplicant_income", "0D")

RULES: tuple[Rule, ...] = (
    Rule("income_consistency", (
        Check("income_inconsistency", "abs(monthly_income - annual_income / 12D) > annual_income / 12D * 0.15D",
              "monthly_income", "annual_income / 12D"),)),
    Rule("debt_income_consistency", (
        Check("debt_ratio_inconsistency",
              "monthly_income > 0 and abs(try_divide(monthly_debt_payments, monthly_income) "
              "- debt_to_income_ratio) > 0.02D",
              "debt_to_income_ratio", "try_divide(monthly_debt_payments, monthly_income)"),)),
    Rule("household_income_consistency", (
        Check(_ORPHAN_INCOME.violation_type, f"total_household_income is not null and {_ORPHAN_INCOME.predicate}",
              _ORPHAN_INCOME.actual, _ORPHAN_INCOME.bound),
        Check("household_income_inconsistency",
              f"abs(total_household_income - {_EXPECTED_HOUSEHOLD}) > {_EXPECTED_HOUSEHOLD} * 0.01D",
              "total_household_income", _EXPECTED_HOUSEHOLD),)),
    Rule("loan_to_income_ratio", (
        Check("excessive_loan_to_income",
              f"annual_income > 0 and try_divide(loan_amount, annual_income) > {_LTI}",
              "try_divide(loan_amount, annual_income)", _LTI),)),
    Rule("debt_service_capacity", (
        Check("excessive_debt_service", f"monthly_income > 0 and loan_term_months > 0 and {_SERVICE} > 0.43D",
              _SERVICE, "0.43D"),)),
    Rule("loan_term_reasonableness", (
        Check("unreasonable_loan_term",
              f"loan_purpose is not null and not (loan_term_months between {_TERM_MIN} and {_TERM_MAX})",
              "cast(loan_term_months as double)",
              f"if(loan_term_months < {_TERM_MIN}, {_TERM_MIN}, {_TERM_MAX})"),)),
    Rule("credit_history_consistency", (
        Check("impossible_credit_history",
              "age is not null and credit_history_length > greatest(0, age - 18)",
              "credit_history_length", "cast(greatest(0, age - 18) as double)"),
        Check("credit_history_account_mismatch",
              "age is not null and credit_history_length > 2 and num_credit_accounts = 0",
              "credit_history_length", "2D"),)),
    Rule("defaults_vs_credit_score", (
        Check("credit_score_default_mismatch", "credit_score >= 700 and previous_loan_defaults >= 2",
              "credit_score", "cast(previous_loan_defaults as double)"),
        Check("low_score_no_defaults", "credit_score < 500 and previous_loan_defaults = 0",
              "credit_score", "cast(previous_loan_defaults as double)"),)),
    Rule("property_loan_alignment", (
        Check("missing_property_value", "owns_property and coalesce(property_value, 0D) <= 0",
              "property_value", "0D"),
        Check("home_improvement_non_owner", "loan_purpose = 'Home Improvement' and not owns_property",
              "property_value", "0D"),)),
    Rule("collateral_adequacy", (
        Check("excessive_loan_to_value",
              "owns_property and loan_purpose = 'Home Improvement' "
              "and try_divide(loan_amount, property_value) > 0.8D",
              "try_divide(loan_amount, property_value)", "0.8D"),)),
    Rule("employment_income_alignment", (
        Check("unemployed_high_income", "employment_status = 'Unemployed' and annual_income > 10000",
              "annual_income", "10000D"),
        Check("student_high_income", "employment_status = 'Student' and annual_income > 50000",
              "annual_income", "50000D"),)),
    Rule("employment_stability", (
        Check("impossible_employment_duration",
              "employment_status is not null and age is not null and years_employed > greatest(0, age - 16)",
              "years_employed", "cast(greatest(0, age - 16) as double)"),)),
    Rule("banking_relationship_consistency", (
        Check("missing_banking_tenure", "has_bank_account and coalesce(years_with_bank, -1D) < 0",
              "years_with_bank", "0D"),
        Check("impossible_banking_tenure", "has_bank_account is not null and years_with_bank > age",
              "years_with_bank", "cast(age as double)"),)),
    Rule("age_loan_term_alignment", (
        Check("loan_extends_past_retirement", "age + loan_term_months / 12D > 75D",
              "age + loan_term_months / 12D", "75D"),)),
    Rule("coapplicant_data_consistency", (
        _ORPHAN_INCOME,
        Check("missing_coapplicant_income", "has_coapplicant and coalesce(coapplicant_income, 0D) <= 0",
              "coapplicant_income", "0D"),)),
)


class RuleBook:
    """A set of rules that can be extended, switched off and run in one scan."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self._rules = {r.name: r for r in rules}
        self._off: set[str] = set()

    def register(self, rule: Rule) -> None:
        self._rules[rule.name] = rule

    def disable(self, name: str) -> None:
        self._off.add(name)

    def enable(self, name: str) -> None:
        self._off.discard(name)

    @property
    def active(self) -> list[Rule]:
        return [r for n, r in self._rules.items() if n not in self._off]

    def violations_column(self, names: list[str] | None = None) -> Column:
        """Array of ``(rule, violation_type, actual, bound)`` for one row."""
        checks = [
            F.when(F.coalesce(F.expr(c.predicate), F.lit(False)),
                   F.struct(F.lit(r.name).alias("rule"), F.lit(c.violation_type).alias("violation_type"),
                            F.expr(c.actual).cast("double").alias("actual"),
                            F.expr(c.bound).cast("double").alias("bound")))
            for r in self.active if names is None or r.name in names for c in r.checks]
        return F.filter(F.array(*checks), lambda v: v.isNotNull())

    def violations(self, df: DataFrame, id_col: str = "application_id",
                   names: list[str] | None = None) -> DataFrame:
        """Long table of violations; lazy, works on batch and streaming frames."""
        return df.select(F.col(id_col), F.explode(self.violations_column(names)).alias("v")).select(id_col, "v.*")

    def summary(self, df: DataFrame, id_col: str = "application_id") -> DataFrame:
        return self.violations(df, id_col).groupBy("rule", "violation_type").agg(
            F.count(F.lit(1)).alias("violations"), F.count_distinct(id_col).alias("applications"))

    def status(self, df: DataFrame) -> DataFrame:
        """One row per active rule: violations and whether the rule passed."""
        counts = df.agg(F.array(*[
            F.struct(F.lit(r.name).alias("rule"),
                     sum((F.count_if(F.coalesce(F.expr(c.predicate), F.lit(False))) for c in r.checks),
                         F.lit(0).cast("bigint")).alias("violations"))
            for r in self.active]).alias("r")).selectExpr("inline(r)")
        return counts.withColumn("passed", F.col("violations") == 0)


def rule_violations(df: DataFrame, rule: str, id_col: str = "application_id") -> DataFrame:
    """Violations of one named rule."""
    return RuleBook().violations(df, id_col, [rule]).drop("rule")
