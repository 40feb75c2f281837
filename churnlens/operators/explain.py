"""Exact per-feature log-odds contributions of a logistic model, relative to a reference profile.

contribution(feature) = sum over its encoded columns of coef * (encoded - reference). The sum of
contributions plus the reference logit equals the model's decision value. Everything is a Column
expression; ``top_reasons`` builds an array<struct> per row with filter / sort / slice (higher-
order functions): no explode, no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import contract_spec as cs
from churnlens.functions.exprs import cond_count, signed_hundredths
from churnlens.operators.features import Preprocessor
from churnlens.operators.scoring import LinearModel

REASON_TYPE = ("struct<feature:string,value:string,contribution_log_odds:double,direction:string,"
               "evidence_type:string,causal_claim:boolean,statement:string>")


def reference_means(train: DataFrame, pre: Preprocessor) -> DataFrame:
    """Mean of each encoded column over the training rows: one aggregate, unpivoted to rows."""
    agg = train.agg(*[F.avg(pre.column(n)).alias(n) for n in pre.names])
    stack = ", ".join(f"'{n}', `{n}`" for n in pre.names)
    return agg.selectExpr(f"stack({len(pre.names)}, {stack}) as (encoded_column, mean)")


def collect_reference(train: DataFrame, pre: Preprocessor) -> dict[str, float]:
    return {r.encoded_column: float(r["mean"]) for r in reference_means(train, pre).collect()}


@dataclass
class LinearExplainer:
    model: LinearModel
    reference: dict[str, float]

    def __post_init__(self) -> None:
        if not isinstance(self.model, LinearModel):
            raise NotImplementedError(
                f"exact contributions are only implemented for logistic models; got {type(self.model).__name__}")
        missing = [n for n in self.model.pre.names if n not in self.reference]
        if missing:
            raise ValueError(f"reference profile is missing encoded columns: {missing[:3]}")

    @property
    def features(self) -> list[str]:
        return list(self.model.pre.spec.all)

    @property
    def reference_logit(self) -> float:
        return self.model.intercept + sum(self.model.coef[n] * self.reference[n] for n in self.model.pre.names)

    def _members(self, feature: str) -> list[str]:
        return [n for n, src, _ in self.model.pre.encoded if src == feature]

    def contribution(self, feature: str) -> Column:
        pre, coef = self.model.pre, self.model.coef
        total: Column | None = None
        for n in self._members(feature):
            term = F.lit(coef[n]) * (pre.column(n) - F.lit(self.reference[n]))
            total = term if total is None else total + term
        return total if total is not None else F.lit(0.0)

    def sql_contribution(self, feature: str) -> str:
        pre, coef = self.model.pre, self.model.coef
        total = None
        for n in self._members(feature):
            term = f"(({coef[n]!r}) * ({pre.sql(n)} - ({self.reference[n]!r})))"
            total = term if total is None else f"({total} + {term})"
        return total or "0.0"

    def contributions(self, df: DataFrame, keep: tuple[str, ...] = (cs.CLEAN_ID,)) -> DataFrame:
        return df.select(*keep, *[self.contribution(f).alias(f) for f in self.features])

    def additivity_gap(self, df: DataFrame) -> DataFrame:
        """max |sum(contributions) + reference logit - decision| over all rows (should be ~1e-15)."""
        total = F.lit(self.reference_logit)
        for f in self.features:
            total = total + self.contribution(f)
        return df.agg(F.max(F.abs(total - self.model.decision())).alias("max_abs_gap"),
                      F.count(F.lit(1)).cast("bigint").alias("n_rows"))

    def global_importance(self, df: DataFrame) -> DataFrame:
        """Mean |contribution| and mean signed contribution per feature (one aggregate, then rows)."""
        aggs = []
        for f in self.features:
            c = self.contribution(f)
            aggs += [F.avg(F.abs(c)).alias(f"a__{f}"), F.avg(c).alias(f"s__{f}")]
        agg = df.agg(*aggs)
        stack = ", ".join(f"'{f}', `a__{f}`, `s__{f}`" for f in self.features)
        return agg.selectExpr(
            f"stack({len(self.features)}, {stack}) as (feature, mean_abs_contribution, mean_signed_contribution)")

    def with_contributions(self, df: DataFrame, prefix: str = "_c__") -> DataFrame:
        """Append one contribution column per feature (computed once, referenced by ``reasons``)."""
        return df.select("*", *[self.contribution(f).alias(f"{prefix}{f}") for f in self.features])

    def _top(self, top_k: int, direction: str, prefix: str | None, values: bool) -> Column:
        """array<struct> of the ``top_k`` strongest contributions; features differ, so ``value`` orders nothing."""
        if direction not in ("increases_risk", "decreases_risk"):
            raise ValueError(direction)
        sign = 1.0 if direction == "increases_risk" else -1.0
        binary = set(self.model.pre.spec.binary)
        entries = []
        for f in self.features:
            c = self.contribution(f) if prefix is None else F.col(f"{prefix}{f}")
            entries.append(F.struct(
                (F.lit(-sign) * c).alias("key"), F.lit(f).alias("feature"), c.alias("c"),
                *([_display_value(f, binary).alias("value")] if values else []),
            ))
        arr = F.filter(F.array(*entries), lambda e: F.lit(sign) * e["c"] > F.lit(1e-12))
        return F.slice(F.sort_array(arr), 1, top_k)

    def reasons(self, top_k: int = 3, direction: str = "increases_risk", prefix: str | None = None) -> Column:
        """array<struct> of up to ``top_k`` features pushing the score in ``direction``. With
        ``prefix`` the contributions are read from columns made by ``with_contributions``."""
        top = self._top(top_k, direction, prefix, values=True)
        verb = "raises" if direction == "increases_risk" else "lowers"
        return F.transform(top, lambda e: F.struct(
            e["feature"].alias("feature"),
            e["value"].alias("value"),
            F.round(e["c"], 6).alias("contribution_log_odds"),
            F.lit(direction).alias("direction"),
            F.lit(cs.EVIDENCE_TYPE).alias("evidence_type"),
            F.lit(False).alias("causal_claim"),
            F.concat(_label_of(e["feature"]), F.lit(" = "), e["value"], F.lit(f" {verb} the model's risk estimate (log-odds "),
                     signed_hundredths(e["c"]),
                     F.lit(f") relative to the average customer profile. {cs.CAVEAT}")).alias("statement"),
        ))

    def reason_rows(self, df: DataFrame, top_k: int = 3, direction: str = "increases_risk") -> DataFrame:
        """Exploded form: customer_id, reason_rank (1-based), feature, contribution (6 dp). Contributions are
        made once a row, and the texts of ``reasons`` not at all."""
        made = self.contributions(df)
        ex = made.select(cs.CLEAN_ID, F.posexplode(self._top(top_k, direction, "", values=False)).alias("pos", "x"))
        return ex.select(cs.CLEAN_ID, (F.col("pos") + 1).cast("bigint").alias("reason_rank"),
                         F.col("x.feature").alias("feature"), F.round("x.c", 6).alias("contribution"))


def _label_of(feature: Column) -> Column:
    text = F.regexp_replace(feature, "_", " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 10_000)))


def _display_value(feature: str, binary: set[str]) -> Column:
    x = F.col(feature)
    if feature in binary:
        return F.when(x.cast("int") == 1, "Yes").otherwise("No")
    if feature in ("monthly_charges", "total_charges"):
        # float features show 2 decimals without scientific notation (Python round(x, 2) repr)
        r = F.round(x.cast("double"), 2)
        return F.regexp_replace(F.format_string("%.2f", r), r"(\.\d)0$", "$1")
    return x.cast("string")
