"""The ``loan_applications`` view over the orders and customer tables.

One SQL text serves both Spark and the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS: list[tuple[str, str]] = [
    ("application_id", "o.o_orderkey"),
    ("age", "cast(18 + (o.o_orderkey * 7 + c.c_custkey) % 63 as int)"),
    ("gender", "case when o.o_orderkey % 9 < 5 then 'Male' else 'Female' end"),
    ("marital_status",
     "case when o.o_orderkey % 20 < 9 then 'Single' when o.o_orderkey % 20 < 16 then 'Married' "
     "when o.o_orderkey % 20 < 19 then 'Divorced' else 'Widowed' end"),
    ("education",
     "case when c.c_custkey % 20 < 3 then 'High School' when c.c_custkey % 20 < 8 then 'Some College' "
     "when c.c_custkey % 20 < 15 then 'Bachelor''s' else 'Advanced' end"),
    ("employment_status",
     "case when o.o_orderkey % 25 < 18 then 'Employed' when o.o_orderkey % 25 < 21 then 'Self-Employed' "
     "when o.o_orderkey % 25 < 22 then 'Self-employed' when o.o_orderkey % 25 < 23 then 'Unemployed' "
     "when o.o_orderkey % 25 < 24 then 'Retired' else 'Student' end"),
    ("years_employed",
     "case when o.o_orderkey % 33 = 0 then null else ((o.o_orderkey * 13) % 401) / 10e0 end"),
    ("annual_income",
     "(12000e0 + o.o_totalprice * 0.2e0) * (case when o.o_orderkey % 97 = 0 then 8e0 else 1e0 end)"),
    ("monthly_income",
     "annual_income / 12e0 * (case when o.o_orderkey % 17 = 0 then 0.7e0 else 1e0 end)"),
    ("credit_score",
     "case when o.o_orderkey % 50 = 0 then null "
     "else cast(300 + (o.o_orderkey * 37 + c.c_custkey * 11) % 551 as double) end"),
    ("credit_history_length", "((o.o_orderkey * 29) % 301) / 10e0"),
    ("num_credit_accounts", "cast((o.o_orderkey * 3) % 12 as int)"),
    ("existing_debt", "5e0 * (c.c_acctbal + 1000e0)"),
    ("monthly_debt_payments", "existing_debt * 0.03e0"),
    ("debt_to_income_ratio",
     "least(2e0, monthly_debt_payments / monthly_income "
     "+ (case when o.o_orderkey % 19 = 0 then 0.1e0 else 0e0 end))"),
    ("loan_amount", "1000e0 + o.o_totalprice / 8e0"),
    ("loan_term_months", "cast(12 * (1 + o.o_orderkey % 8) as int)"),
    ("loan_purpose",
     "case o.o_orderkey % 8 when 0 then 'Auto' when 1 then 'Home Improvement' "
     "when 2 then 'Debt Consolidation' when 3 then 'Medical' when 4 then 'Education' "
     "when 5 then 'Business' when 6 then 'Personal' else 'Other' end"),
    ("owns_property", "(o.o_orderkey % 20) < 13"),
    ("property_value",
     "case when o.o_orderkey % 51 = 1 then null when (o.o_orderkey % 20) < 13 "
     "then 50000e0 + o.o_totalprice / 2e0 else 0e0 end"),
    ("has_bank_account", "(o.o_orderkey % 20) <> 7"),
    ("years_with_bank",
     "case when (o.o_orderkey % 20) <> 7 then ((o.o_orderkey * 17) % 251) / 10e0 else 0e0 end"),
    ("previous_loans", "cast(o.o_orderkey % 4 as int)"),
    ("previous_loan_defaults",
     "cast(case when o.o_orderkey % 13 = 0 then 2 when o.o_orderkey % 11 = 0 then 1 else 0 end as int)"),
    ("state",
     "case c.c_nationkey when 0 then 'CA' when 1 then 'TX' when 2 then 'FL' when 3 then 'NY' "
     "when 4 then 'PA' else 'Other' end"),
    ("area_type",
     "case when o.o_orderkey % 20 < 8 then 'Urban' when o.o_orderkey % 20 < 17 then 'Suburban' "
     "else 'Rural' end"),
    ("has_coapplicant", "(o.o_orderkey % 10) < 3"),
    ("coapplicant_income",
     "case when o.o_orderkey % 71 = 0 then 5000e0 when (o.o_orderkey % 10) < 3 "
     "then cast(20000 + (o.o_orderkey * 331) % 40000 as double) else 0e0 end"),
    ("total_household_income",
     "(annual_income + coapplicant_income) * (case when o.o_orderkey % 83 = 0 then 1.2e0 else 1e0 end)"),
    ("application_date", "o.o_orderdate"),
]

LABEL = (
    "cast(case when (coalesce(credit_score, 650e0) - 300e0) / 550e0 * 0.4e0 "
    "+ (1e0 - least(debt_to_income_ratio, 1e0)) * 0.35e0 "
    "+ (case when owns_property then 0.1e0 else 0e0 end) "
    "+ ((application_id * 53) % 100) / 500e0 > 0.42e0 then 1 else 0 end as int)"
)

NUMERIC = [
    "age", "years_employed", "annual_income", "monthly_income", "credit_score",
    "credit_history_length", "num_credit_accounts", "existing_debt", "monthly_debt_payments",
    "debt_to_income_ratio", "loan_amount", "loan_term_months", "property_value",
    "years_with_bank", "previous_loans", "previous_loan_defaults", "coapplicant_income",
    "total_household_income",
]
CATEGORICAL = [
    "gender", "marital_status", "education", "employment_status", "loan_purpose", "state", "area_type",
]
BOOLEAN = ["owns_property", "has_bank_account", "has_coapplicant"]
FIELDS = [name for name, _ in COLUMNS]

_BASE = (
    "SELECT " + ",\n  ".join(f"{e} AS {n}" for n, e in COLUMNS)
    + "\nFROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
)
#: CTE text: ``lab`` (one row per application) and ``loan_applications`` (with 1 % exact copies).
LOANS_CTE = (
    f"WITH base AS ({_BASE}),\nlab AS (SELECT *, {LABEL} AS loan_approved FROM base),\n"
    "loan_applications AS (SELECT * FROM lab UNION ALL SELECT * FROM lab WHERE application_id % 100 = 0)"
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows over all cores when the files give fewer splits than cores; otherwise leave the scan as it is.

    Large inputs have more splits than cores, so they are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _register(spark: SparkSession, sf_dir: str) -> None:
    spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").createOrReplaceTempView("orders")
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")


def loan_applications(spark: SparkSession, sf_dir: str, copies: bool = True) -> DataFrame:
    """The view as a lazy DataFrame; ``copies=False`` leaves the exact copies out."""
    _register(spark, sf_dir)
    lab = spark.sql(f"SELECT *, {LABEL} AS loan_approved FROM ({_BASE})")
    if not copies:
        return lab
    # One scan and one join: the copies come from a generator, not from a second read of both tables.
    return lab.selectExpr(
        *lab.columns,
        "explode(if(application_id % 100 = 0, array(0, 1), array(0))) AS _copy",
    ).drop("_copy")
