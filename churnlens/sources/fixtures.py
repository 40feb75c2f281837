"""Deterministic inputs derived from the driver tables with md5 uniforms (no RNG state).

* ``accounts``        - a raw 21-column text table, one row per ``customer`` row.
* ``accounts_dirty``  - the same with planted contract violations.
* ``scored_lines``    - (key, y, p, attributes) per ``lineitem`` row, for evaluation/audit at scale.

Every column is a pure function of the source row, so the tables are computed in one narrow
stage and grow with the inputs. The account columns are made from a few bytes of key, which the reader
packs into one or two splits at any size here: the keys are dealt over tasks first (``spread``). The row-order key ``_row`` stands in for file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import md5_below, md5_of, md5_uniform
from churnlens.sources.tables import table

ROW = "_row"
TASK_ROWS = 10_000


def _money_text(cents: Column) -> Column:
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def customer_id(k: Column) -> Column:
    """Four digits and five letters: the key's last four digits, and the rest in base 26."""
    rest = F.floor(k / 10000).cast("bigint")
    letters = [F.chr(F.lit(65) + F.floor(rest / 26 ** i).cast("bigint") % 26) for i in range(4, -1, -1)]
    return F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-"), *letters)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over a task for each ``TASK_ROWS`` of them, for narrow rows that cost much each."""
    tasks = rows.count() // TASK_ROWS + 1
    return rows.repartition(tasks) if tasks > 1 else rows


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-style account table (all text) built from ``customer``; ``_row`` = c_custkey."""
    cust = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    kk = F.when(F.col("k") % 50 == 49, F.col("k") - 1).otherwise(F.col("k"))
    # hashes that several comparisons read are made once
    base = cust.select("k", kk.alias("kk")).select("k", "kk", *[md5_of(c, "kk").alias(f"_{c}") for c in ("internet", "contract", "pay")])

    def u(salt: str) -> Column:
        return md5_uniform(salt, F.col("kk"))

    def yes(salt: str) -> Column:
        return F.when(md5_below(md5_of(salt, "kk"), 0.5), "Yes").otherwise("No")

    t = F.floor(u("tenure") * 73).cast("bigint")
    mc = (F.lit(2000) + F.floor(u("monthly") * 9000)).cast("bigint")
    inet, contract, pay = F.col("_internet"), F.col("_contract"), F.col("_pay")
    stage = base.select(
        "k", "kk", "_pay", t.alias("t"), mc.alias("mc"),
        F.when(md5_below(inet, 0.35), "DSL").when(md5_below(inet, 0.80), "Fiber optic").otherwise("No").alias("inet"),
        F.when(md5_below(md5_of("phone", "kk"), 0.9), "Yes").otherwise("No").alias("phone"),
        F.when(md5_below(contract, 0.55), "Month-to-month").when(md5_below(contract, 0.80), "One year")
        .otherwise("Two year").alias("contract"),
    )
    tc = ((F.col("t") * F.col("mc") * (F.lit(90) + F.floor(u("drift") * 21))) / 100).cast("bigint")
    lg = (F.lit(-1.2) + F.lit(1.8) * (F.col("contract") == "Month-to-month").cast("double")
          - F.lit(0.04) * F.col("t") + F.lit(0.015) * (F.col("mc") / 100.0 - 65))
    addons = [
        F.when(F.col("inet") == "No", "No internet service").otherwise(yes(c)).alias(c)
        for c in cs.INTERNET_ADDONS_RAW
    ]
    method = (F.when(md5_below(pay, 0.25), "Bank transfer (automatic)").when(md5_below(pay, 0.5), "Credit card (automatic)")
              .when(md5_below(pay, 0.75), "Electronic check").otherwise("Mailed check"))
    out = stage.select(
        customer_id(F.col("k")).alias("customerID"),
        F.when(md5_below(md5_of("gender", "kk"), 0.5), "Female").otherwise("Male").alias("gender"),
        F.when(md5_below(md5_of("senior", "kk"), 0.16), "1").otherwise("0").alias("SeniorCitizen"),
        yes("partner").alias("Partner"),
        yes("dependents").alias("Dependents"),
        F.col("t").cast("string").alias("tenure"),
        F.col("phone").alias("PhoneService"),
        F.when(F.col("phone") == "No", "No phone service").otherwise(yes("lines")).alias("MultipleLines"),
        F.col("inet").alias("InternetService"),
        *addons,
        F.col("contract").alias("Contract"),
        yes("paperless").alias("PaperlessBilling"),
        method.alias("PaymentMethod"),
        _money_text(F.col("mc")).alias("MonthlyCharges"),
        F.when(F.col("t") == 0, F.lit(" ")).otherwise(_money_text(tc)).alias("TotalCharges"),
        F.when(u("churn") < F.lit(1.0) / (F.lit(1.0) + F.exp(-lg)), "Yes").otherwise("No").alias("Churn"),
        F.col("k").alias(ROW),
    )
    return out.select(*cs.RAW_COLUMNS, ROW)


# Planted violations, keyed on k % 101 (fixed table of the dirty fixture).
def accounts_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = accounts(spark, sf_dir)
    m = F.col(ROW) % 101
    k = F.col(ROW)

    def put(c: str, rules: list[tuple[int, Column | str]]) -> Column:
        expr = None
        for key, value in rules:
            v = F.lit(value) if isinstance(value, str) else value
            expr = F.when(m == key, v) if expr is None else expr.when(m == key, v)
        return expr.otherwise(F.col(c)).alias(c)

    prev_id = customer_id(k - 1)
    total_cents = (F.regexp_replace(F.col("TotalCharges"), r"\.", "").try_cast("bigint"))
    replaced = {
        "customerID": put("customerID", [(3, F.concat(F.lit("bad-id-"), k.cast("string"))), (31, prev_id), (43, "")]),
        "tenure": put("tenure", [(7, "2.5"), (8, "abc"), (9, "-1"), (10, "130"), (19, "5"), (22, "0"), (24, "4")]),
        "MonthlyCharges": put("MonthlyCharges", [(11, "0"), (12, "free")]),
        "PaymentMethod": put("PaymentMethod", [(13, "Cash")]),
        "MultipleLines": put("MultipleLines", [(17, "No")]),
        "PhoneService": put("PhoneService", [(17, "No")]),
        "InternetService": put("InternetService", [(18, "No")]),
        "TotalCharges": put("TotalCharges", [
            (19, " "), (20, "-5"), (21, "n/a"), (22, "50.00"), (24, "0"),
            (26, F.when(F.col("TotalCharges") == " ", F.col("TotalCharges"))
             .otherwise(_money_text(total_cents * 10))),
        ]),
        "gender": put("gender", [(23, " Male")]),
        "Churn": put("Churn", [(29, "Maybe")]),
        "SeniorCitizen": put("SeniorCitizen", [(37, "2")]),
        "Contract": put("Contract", [(41, " ")]),
    }
    return a.select(*[replaced.get(c, F.col(c)) for c in cs.RAW_COLUMNS], ROW)


def scored_lines(spark: SparkSession, sf_dir: str, with_region: bool = True) -> DataFrame:
    """One scored row per lineitem: calibrated-by-construction (y, p) with audit attributes."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice",
    )
    z = F.lit(-1.0) + F.lit(0.06) * (F.col("l_quantity") - 25) + F.lit(12.0) * (F.col("l_discount") - 0.05)
    p = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    ykey = F.concat_ws(":", F.lit("y"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    h = F.conv(F.substring(F.md5(ykey), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    out = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice",
        "l_returnflag", "l_linestatus", p.alias("p"),
    ).withColumn("y", (h < F.col("p")).cast("bigint"))
    if with_region:
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        # supplier/nation/region are dimension tables (bounded by the number of suppliers and
        # 25 nations); the planner broadcasts them by size (AQE), the lineitem side never moves.
        dims = sup.join(nat, sup.s_nationkey == nat.n_nationkey).join(reg, nat.n_regionkey == reg.r_regionkey)
        out = out.join(dims.select("s_suppkey", F.col("r_name").alias("region")),
                       out.l_suppkey == dims.s_suppkey, "left").drop("s_suppkey")
    return out


LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
