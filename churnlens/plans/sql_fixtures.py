"""DuckDB SQL text for the derived fixtures and shared CTEs (used by the oracle only).

The expressions mirror ``churnlens.sources.fixtures`` / the cleaning rules; every literal is cast
to DOUBLE so both engines do the same IEEE arithmetic.
"""

from __future__ import annotations

from churnlens.functions import contract_spec as cs


def D(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def U(salt: str, key: str = "kk") -> str:
    return f"(CAST(('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0)"


def _yes(u: str, p: float = 0.5) -> str:
    return f"CASE WHEN {u} < {p} THEN 'Yes' ELSE 'No' END"


def money(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


def cust_id(k: str) -> str:
    letters = " || ".join(f"chr(CAST(65 + (({k}) // {10000 * 26 ** i}) % 26 AS INTEGER))" for i in range(4, -1, -1))
    return f"(lpad(CAST(({k}) % 10000 AS VARCHAR), 4, '0') || '-' || {letters})"


def accounts_sql() -> str:
    addons = ",\n".join(
        f"  CASE WHEN inet = 'No' THEN 'No internet service' ELSE {_yes(U(c))} END AS {c}" for c in cs.INTERNET_ADDONS_RAW
    )
    lg = (f"({D(-1.2)} + {D(1.8)} * (CASE WHEN contract = 'Month-to-month' THEN 1.0 ELSE 0.0 END)::DOUBLE"
          f" - {D(0.04)} * t + {D(0.015)} * (mc / {D(100.0)} - 65))")
    return f"""(
SELECT {cust_id('k')} AS customerID,
  CASE WHEN {U('gender')} < 0.5 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN {U('senior')} < 0.16 THEN '1' ELSE '0' END AS SeniorCitizen,
  {_yes(U('partner'))} AS Partner,
  {_yes(U('dependents'))} AS Dependents,
  CAST(t AS VARCHAR) AS tenure,
  phone AS PhoneService,
  CASE WHEN phone = 'No' THEN 'No phone service' ELSE {_yes(U('lines'))} END AS MultipleLines,
  inet AS InternetService,
{addons},
  contract AS Contract,
  {_yes(U('paperless'))} AS PaperlessBilling,
  CASE WHEN {U('pay')} < 0.25 THEN 'Bank transfer (automatic)' WHEN {U('pay')} < 0.5 THEN 'Credit card (automatic)'
       WHEN {U('pay')} < 0.75 THEN 'Electronic check' ELSE 'Mailed check' END AS PaymentMethod,
  {money('mc')} AS MonthlyCharges,
  CASE WHEN t = 0 THEN ' ' ELSE {money(f"(t * mc * (90 + CAST(floor({U('drift')} * 21) AS BIGINT))) // 100")} END AS TotalCharges,
  CASE WHEN {U('churn')} < 1.0 / (1.0 + exp(-{lg})) THEN 'Yes' ELSE 'No' END AS Churn,
  k AS _row
FROM (
  SELECT k, kk, CAST(floor({U('tenure')} * 73) AS BIGINT) AS t,
    CAST(2000 + floor({U('monthly')} * 9000) AS BIGINT) AS mc,
    CASE WHEN {U('internet')} < 0.35 THEN 'DSL' WHEN {U('internet')} < 0.80 THEN 'Fiber optic' ELSE 'No' END AS inet,
    CASE WHEN {U('phone')} < 0.9 THEN 'Yes' ELSE 'No' END AS phone,
    CASE WHEN {U('contract')} < 0.55 THEN 'Month-to-month' WHEN {U('contract')} < 0.80 THEN 'One year' ELSE 'Two year' END AS contract
  FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 ELSE c_custkey END AS kk FROM customer) b
) s)"""


def accounts_dirty_sql() -> str:
    def put(c: str, rules: list[tuple[int, str]]) -> str:
        whens = " ".join(f"WHEN _row % 101 = {k} THEN {v}" for k, v in rules)
        return f"CASE {whens} ELSE {c} END AS {c}"

    total_cents = "TRY_CAST(replace(TotalCharges, '.', '') AS BIGINT)"
    rules = {
        "customerID": [(3, "'bad-id-' || CAST(_row AS VARCHAR)"), (31, cust_id("_row - 1")), (43, "''")],
        "tenure": [(7, "'2.5'"), (8, "'abc'"), (9, "'-1'"), (10, "'130'"), (19, "'5'"), (22, "'0'"), (24, "'4'")],
        "MonthlyCharges": [(11, "'0'"), (12, "'free'")],
        "PaymentMethod": [(13, "'Cash'")],
        "MultipleLines": [(17, "'No'")],
        "PhoneService": [(17, "'No'")],
        "InternetService": [(18, "'No'")],
        "TotalCharges": [(19, "' '"), (20, "'-5'"), (21, "'n/a'"), (22, "'50.00'"), (24, "'0'"),
                         (26, f"CASE WHEN TotalCharges = ' ' THEN TotalCharges ELSE {money(total_cents + ' * 10')} END")],
        "gender": [(23, "' Male'")],
        "Churn": [(29, "'Maybe'")],
        "SeniorCitizen": [(37, "'2'")],
        "Contract": [(41, "' '")],
    }
    cols = [put(c, rules[c]) if c in rules else c for c in cs.RAW_COLUMNS]
    return f"(SELECT {', '.join(cols)}, _row FROM {accounts_sql()} a)"


STRIP = "regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def strip(c: str) -> str:
    return STRIP.format(c=c)


def num(c: str) -> str:
    return f"TRY_CAST({strip(c)} AS DOUBLE)"


def cleaned_sql(raw: str | None = None) -> str:
    raw = raw or accounts_sql()
    non_id = [c for c in cs.RAW_COLUMNS if c != cs.RAW_ID]
    keys = ", ".join(non_id)
    on = " AND ".join(f"r.{c} = g.{c}" for c in non_id)
    sel = []
    for c in cs.RAW_COLUMNS:
        n = cs.RAW_TO_CLEAN[c]
        if c == "tenure":
            sel.append(f"CAST({num('r.tenure')} AS BIGINT) AS {n}")
        elif c == "MonthlyCharges":
            sel.append(f"{num('r.MonthlyCharges')} AS {n}")
        elif c == "TotalCharges":
            sel.append(f"CASE WHEN {strip('r.TotalCharges')} = '' THEN 0.0::DOUBLE ELSE {num('r.TotalCharges')} END AS {n}")
        elif c == "SeniorCitizen":
            sel.append(f"CAST({num('r.SeniorCitizen')} AS BIGINT) AS {n}")
        elif c == "Churn":
            sel.append(f"CAST(CASE r.Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS BIGINT) AS {n}")
        else:
            sel.append(f"r.{c} AS {n}")
    term = "CASE r.Contract WHEN 'Month-to-month' THEN 1 WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 END"
    sel += [
        f"({strip('r.TotalCharges')} = '') AS total_charges_was_blank",
        "g.duplicate_group_id", "g.duplicate_group_size",
        f"coalesce({term} > 1 AND CAST({num('r.tenure')} AS BIGINT) < {term}, false) AS contract_term_exceeds_tenure",
        "r._row",
    ]
    return f"""(
WITH r AS (SELECT * FROM {raw} x),
g AS (SELECT {keys}, CAST(dense_rank() OVER (ORDER BY first_row) - 1 AS BIGINT) AS duplicate_group_id,
             duplicate_group_size
      FROM (SELECT {keys}, min(_row) AS first_row, CAST(count(*) AS BIGINT) AS duplicate_group_size FROM r GROUP BY {keys}) q)
SELECT {', '.join(sel)} FROM r JOIN g ON {on})"""


def features_sql(cleaned: str | None = None) -> str:
    cleaned = cleaned or cleaned_sql()
    bins = ", ".join(f"CAST(({c} = 'Yes') AS INTEGER) AS {c}" for c in cs.YES_NO_BINARY)
    addons = " + ".join(f"CAST(({c} = 'Yes') AS BIGINT)" for c in cs.ADDON_COLUMNS)
    return f"""(SELECT customer_id, tenure_months, monthly_charges, total_charges, {bins},
  CAST({addons} AS BIGINT) AS num_addon_services, internet_service, contract, payment_method, gender,
  CAST(senior_citizen AS INTEGER) AS senior_citizen, churn, duplicate_group_id, _row
FROM {cleaned} c)"""


def band_sql(score: str) -> str:
    m, h = cs.RISK_BAND_CUTOFFS["MEDIUM"], cs.RISK_BAND_CUTOFFS["HIGH"]
    return f"CASE WHEN {score} >= {h} THEN 'HIGH' WHEN {score} >= {m} THEN 'MEDIUM' WHEN {score} >= 0 THEN 'LOW' END"


def scored_accounts_sql() -> str:
    from churnlens.operators.scoring import fixed_account_model

    z = fixed_account_model().sql_decision()
    return f"""(SELECT *, {band_sql('risk_score')} AS risk_band FROM (
  SELECT *, round(1.0 / (1.0 + exp(-({z}))), 6) AS risk_score FROM {features_sql()} f) s)"""


def scored_lines_sql() -> str:
    z = f"({D(-1.0)} + {D(0.06)} * (l_quantity - 25) + {D(12.0)} * (l_discount - {D(0.05)}))"
    y = ("CAST(('0x' || substr(md5('y:' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' "
         "|| CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0")
    return f"""(SELECT l.*, CAST(({y}) < p AS BIGINT) AS y, r.r_name AS region FROM (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_returnflag, l_linestatus,
         round(1.0 / (1.0 + exp(-{z})), 6) AS p
  FROM lineitem) l
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""
