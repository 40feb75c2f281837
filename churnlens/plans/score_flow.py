"""The scoring flow: raw table + saved model -> checked risk records -> sinks.

The records are stored once: the output contract is asserted on the stored rows, and nothing is written
to the caller's folder unless it holds.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import clean as cl
from churnlens.operators import explain as ex
from churnlens.operators import features as ft
from churnlens.operators import scoring as sc
from churnlens.operators.contract import validate
from churnlens.session import stored
from churnlens.sources import files as io
from churnlens.sources import registry as rg

_CONTRIBUTION = "_c__"


def content(raw: DataFrame) -> DataFrame:
    """Fingerprint of a raw table's contract columns, label included where there is one."""
    return io.table_fingerprint(raw, [c for c in cs.RAW_COLUMNS if c in raw.columns])


def score_saved(raw: DataFrame, model_path: str, top_k: int = 3, row_key: str = "_row", scored_at: datetime | None = None) -> DataFrame:
    """Risk records of a raw table, labelled or not, under the linear model saved in ``model_path``.

    Errors: no model there (FileNotFoundError), a model without exact contributions
    (NotImplementedError), a table that breaks the input contract (DataContractError), records that
    break the output contract (ValueError). An empty table breaks the input contract.
    """
    spark = raw.sparkSession
    model, meta = rg.load_model(spark, model_path)
    explainer = ex.LinearExplainer(model, json.loads(meta["explanation_reference"]))
    labelled = cs.RAW_TARGET in raw.columns
    checked = validate(raw, require_target=labelled, row_key=row_key)
    checked.raise_on_error()
    features = ft.derive_features(cl.clean(raw, checked, labelled, row_key, check=False, groups=False))
    stamp = (scored_at or datetime.now(UTC)).isoformat(timespec="seconds")
    records = stored(sc.score_table(
        explainer.with_contributions(features, _CONTRIBUTION), model, meta["model_version"], rg.in_sample(content(raw), meta),
        reasons=explainer.reasons(top_k, prefix=_CONTRIBUTION), timestamp=F.lit(stamp)), "records")
    sc.assert_output_contract(records)
    return records


def write_records(records: DataFrame, out_dir: str) -> dict[str, str]:
    """Parquet and JSON with nested reasons, CSV with the reasons as one JSON text; the paths by format."""
    base = out_dir.rstrip("/")
    return {"parquet": io.write_parquet(records, f"{base}/records"), "json": io.write_json(records, f"{base}/records_json"),
            "csv": io.write_csv(sc.records_to_frame(records), f"{base}/records_csv")}
