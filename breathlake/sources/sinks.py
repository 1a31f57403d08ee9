"""Results as CSV, workbooks and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breathlake.sources.xlsx import write_workbook


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header, replacing what is there. ``single`` is for result tables, not for data."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    (flat.coalesce(1) if single else flat).write.mode("overwrite").csv(path, header=True)


def export_results(path: str, features: DataFrame | None = None, statistics: DataFrame | None = None, models: DataFrame | None = None, labels: DataFrame | None = None, metadata: DataFrame | None = None) -> None:
    """One workbook with a sheet for each result that is given."""
    sheets = {"Features": features, "Statistical_Results": statistics, "Model_Performance": models, "Labels": labels, "Metadata": metadata}
    write_workbook(path, {k: v for k, v in sheets.items() if v is not None})


def statistics_report(results: DataFrame, alpha: float = 0.05, most: int = 100) -> str:
    """Counts, and the significant features by corrected p: at most ``most`` lines."""
    p = "p_adjusted" if "p_adjusted" in results.columns else "p_value"
    n, hits = results.agg(F.count("*"), F.count(F.when(F.col(p) < alpha, 1))).first()
    lines = [f"Features tested: {n}", f"Significant at {alpha:g}: {hits}", ""]
    for r in results.filter(F.col(p) < alpha).orderBy(p, "feature").limit(most).collect():
        lines.append(f"{r['feature']}: p = {r[p]:.4g}, effect = {r['effect_size']:.3f}")
    return "\n".join(lines)


def label_summary(labels: DataFrame, outcomes: list[str]) -> DataFrame:
    """Valid and missing labels of each outcome."""
    row = labels.agg(*[F.count(c).alias(c) for c in outcomes], F.count("*").alias("_n"))
    long = row.unpivot(["_n"], outcomes, "outcome", "valid")
    return long.select("outcome", "valid", (F.col("_n") - F.col("valid")).alias("missing"), F.try_divide(100.0 * F.col("valid"), F.col("_n")).alias("percent_valid"))
