from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

def account_id(k: int) -> str:
    return f"{k:04d}-" + "".join(chr(65 + (k // 26**i) % 26) for i in range(5))


def account(k: int, **changes: str) -> dict[str, str]:
    """Valid row k of an endless table: each categorical column walks through its domain at its own pace,
    phone and internet columns agree, and the total is tenure times monthly charge (blank at tenure 0)."""
    from churnlens.functions import contract_spec as cs

    row = {c: domain[k // (i + 1) % len(domain)] for i, (c, domain) in enumerate(cs.CATEGORICAL_DOMAINS.items())}
    row["PhoneService"] = "No" if k % 5 == 4 else "Yes"
    row["InternetService"] = "No" if k % 3 == 2 else ("DSL", "Fiber optic")[k % 2]
    row["MultipleLines"] = "No phone service" if row["PhoneService"] == "No" else ("No", "Yes")[k % 2]
    for i, c in enumerate(cs.INTERNET_ADDONS_RAW):
        row[c] = "No internet service" if row["InternetService"] == "No" else ("Yes", "No")[(k >> i) % 2]
    tenure, monthly = 11 * k % 61, 2500 + 730 * k % 6100
    total = f"{tenure * monthly / 100:.2f}" if tenure else ""
    row |= {"customerID": account_id(k), "SeniorCitizen": str(int(k % 7 == 3)), "tenure": str(tenure), "MonthlyCharges": f"{monthly / 100:.2f}",
            "TotalCharges": total, "Churn": ("No", "Yes", "No")[k % 3]}
    return row | changes


#: rows 1 to 9 and one at tenure 0
TABLE = (*range(1, 10), 61)


def accounts_table() -> list[dict[str, str]]:
    return [account(k) for k in TABLE]


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="churnlens-tests")
    yield s


@pytest.fixture
def raw_df(spark):
    from churnlens.functions import contract_spec as cs

    def build(rows):
        data = [tuple(r[c] for c in cs.RAW_COLUMNS) + (i,) for i, r in enumerate(rows)]
        schema = ", ".join(f"{c} string" for c in cs.RAW_COLUMNS) + ", _row bigint"
        return spark.createDataFrame(data, schema)
    return build
