"""Model persistence, provenance metadata and the ``prepare`` sinks.

* A logistic ``LinearModel`` is stored as data: a one-row JSON table with the preprocessor
  statistics, category levels, coefficients and intercept (no pickles); a forest is a JSON row and the
  table of its subtrees; Spark ML tree models use their own ``PipelineModel`` writer. A missing model gives a clear error.
* ``model_metadata`` is a one-row DataFrame (version, parameters, timestamp, seed, dataset
  fingerprint, feature pipeline, library versions, explanation reference profile).
* ``prepare`` writes the cleaned and model-ready tables only after the contract passes.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.operators import clean as cl
from churnlens.operators import features as ft
from churnlens.operators.contract import validate
from churnlens.operators.forest import ForestModel
from churnlens.operators.models import TreeModel
from churnlens.operators.scoring import LinearModel
from churnlens.sources.files import write_parquet

MODEL_DIR = "model"
META_DIR = "metadata"


def _pre_payload(pre: ft.Preprocessor) -> dict:
    return {"spec": {"numeric": list(pre.spec.numeric), "binary": list(pre.spec.binary),
                     "categorical": list(pre.spec.categorical)},
            "means": pre.means, "stds": pre.stds, "levels": {k: list(v) for k, v in pre.levels.items()}}


def _linear_payload(m: LinearModel) -> dict:
    return {"kind": "linear", "name": m.name, "intercept": m.intercept, "coef": m.coef, **_pre_payload(m.pre)}


def save_model(spark: SparkSession, model, metadata: dict, path: str) -> str:
    base = path.rstrip("/")
    if isinstance(model, LinearModel):
        payload = json.dumps(_linear_payload(model), sort_keys=True)
        spark.createDataFrame([(payload,)], "payload string").coalesce(1).write.mode("overwrite").json(f"{base}/{MODEL_DIR}")
    elif isinstance(model, ForestModel):
        payload = {"kind": "forest", "name": model.name, "edges": model.edges,
                   "top": [[[k, *map(int, v)] for k, v in t.items()] for t in model.top], **_pre_payload(model.pre)}
        spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "payload string").coalesce(1).write.mode("overwrite").json(f"{base}/{MODEL_DIR}")
        write_parquet(model.nodes, f"{base}/{MODEL_DIR}_nodes")
    elif isinstance(model, TreeModel):
        model.model.write().overwrite().save(f"{base}/{MODEL_DIR}")
        spark.createDataFrame([(json.dumps({"kind": "tree", "name": model.name}),)], "payload string") \
            .coalesce(1).write.mode("overwrite").json(f"{base}/{MODEL_DIR}_kind")
    else:
        raise TypeError(f"cannot save {type(model).__name__}")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "metadata string") \
        .coalesce(1).write.mode("overwrite").json(f"{base}/{META_DIR}")
    return base


def load_model(spark: SparkSession, path: str):
    base = path.rstrip("/")
    try:
        meta = json.loads(spark.read.json(f"{base}/{META_DIR}").first()["metadata"])
    except Exception as exc:  # noqa: BLE001 - any missing part means "no trained model here"
        raise FileNotFoundError(f"no trained model in {base}; train one first") from exc
    try:
        payload = json.loads(spark.read.json(f"{base}/{MODEL_DIR}").first()["payload"])
    except Exception:  # noqa: BLE001 - not a linear model table: a Spark ML pipeline
        kind = json.loads(spark.read.json(f"{base}/{MODEL_DIR}_kind").first()["payload"])
        return TreeModel(PipelineModel.load(f"{base}/{MODEL_DIR}"), kind["name"]), meta
    spec = ft.FeatureSpec.of(**payload["spec"])
    pre = ft.Preprocessor(spec, payload["means"], payload["stds"], {k: tuple(v) for k, v in payload["levels"].items()})
    if payload["kind"] == "forest":
        top = [{k: (place, cut) for k, place, cut in t} for t in payload["top"]]
        return ForestModel(pre, payload["edges"], top, spark.read.parquet(f"{base}/{MODEL_DIR}_nodes"), payload["name"]), meta
    return LinearModel(pre, payload["coef"], payload["intercept"], payload["name"]), meta


def model_metadata(spark: SparkSession, model_version: str, model_type: str, params: dict, seed: int,
                   dataset_fingerprint: str, n_rows: int, spec: ft.FeatureSpec, reference: dict[str, float],
                   evaluation: dict | None = None, trained_at: datetime | None = None) -> DataFrame:
    """One-row provenance record; nested parts are sorted-key JSON strings."""
    stamp = (trained_at or datetime.now(UTC)).isoformat(timespec="seconds")
    row = {
        "model_version": model_version, "model_type": model_type,
        "hyperparameters": json.dumps(params, sort_keys=True), "training_timestamp_utc": stamp,
        "trained_on": "all rows (final refit); evaluation metrics describe dev-fitted models", "seed": seed,
        "dataset": json.dumps({"fingerprint": dataset_fingerprint, "provenance_label": cs.PROVENANCE_LABEL,
                               "n_rows": n_rows}, sort_keys=True),
        "feature_pipeline": json.dumps({"version": spec.fingerprint(), "numeric": list(spec.numeric),
                                        "binary": list(spec.binary), "categorical": list(spec.categorical),
                                        "protected_attributes_excluded_from_model": list(cs.PROTECTED_ATTRIBUTES)},
                                       sort_keys=True),
        "evaluation": json.dumps(evaluation or {}, sort_keys=True, default=str),
        "libraries": json.dumps({"pyspark": pyspark.__version__}, sort_keys=True),
        "explanation_method": "linear_exact_contributions",
        "explanation_reference": json.dumps(reference, sort_keys=True),
    }
    return spark.createDataFrame([row])


def prepare(raw: DataFrame, out_dir: str, row_key: str = "_row") -> tuple[str, str]:
    """Validate, clean and write the cleaned and model-ready tables (only when the contract passes)."""
    v = validate(raw, row_key=row_key)
    cleaned = cl.clean(raw, v, row_key=row_key)  # raises DataContractError on ERROR checks
    base = out_dir.rstrip("/")
    c_path = write_parquet(cleaned, f"{base}/cleaned")
    f_path = write_parquet(ft.model_ready(ft.derive_features(cleaned)), f"{base}/model_ready")
    return c_path, f_path


def in_sample(scoring_fp: DataFrame, metadata: dict) -> bool:
    """True when the scored table has the training table's content fingerprint."""
    fp = scoring_fp.select(F.col("fingerprint")).first()["fingerprint"]
    return fp == json.loads(metadata.get("dataset", "{}")).get("fingerprint") if isinstance(metadata.get("dataset"), str) \
        else fp == metadata.get("dataset", {}).get("fingerprint")
