"""Error measures as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gapwise.operators.joins import enrich
from gapwise.spec import HIGH_POLLUTION, HISTOGRAM_BINS


def regression_metrics(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """MAE, RMSE, R2 and rows, overall or per group.

    Rows with a null on either side are left out. R2 of constant actual values is 1
    for a perfect fit and 0 otherwise; below two rows it is null.
    """
    known = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    error = F.col(actual) - F.col(predicted)
    spread = F.col("__spread")
    r2 = (F.when(F.col("n_rows") < 2, None)
          .when(spread > 0, 1 - F.col("__square") / spread)
          .otherwise(F.when(F.col("__square") == 0, 1.0).otherwise(0.0)))
    return (
        known.groupBy(*by)
        .agg(F.avg(F.abs(error)).alias("mae"),
             F.sqrt(F.avg(error * error)).alias("rmse"),
             F.sum(error * error).alias("__square"),
             (F.var_pop(actual) * F.count("*")).alias("__spread"),
             F.count("*").alias("n_rows"))
        .filter(F.col("n_rows") > 0)
        .withColumn("r2", r2)
        .select(*by, "mae", "rmse", "r2", "n_rows")
    )


def metrics_by_entity(df: DataFrame, actual: str, predicted: str, entity: str,
                      names: DataFrame | None = None) -> DataFrame:
    """Metrics per entity, smallest MAE first; ``names`` adds its columns by entity."""
    out = regression_metrics(df, actual, predicted, [entity])
    if names is not None:
        out = enrich(out, names, entity)
    return out.orderBy("mae", entity)


def metrics_by_stratum(df: DataFrame, actual: str, predicted: str,
                       threshold: float = HIGH_POLLUTION) -> DataFrame:
    """Metrics for high actual values and for the rest."""
    stratum = F.when(F.col(actual) >= threshold, "high").otherwise("normal")
    return regression_metrics(df.withColumn("stratum", stratum), actual, predicted, ["stratum"])


def add_residual(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value, the largest
    included in the last bin. Bins without values give no row."""
    value = F.col(column)
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    placed = df.filter(value.isNotNull()).select(
        value.alias("v"), ends["low"].alias("low"),
        ((ends["high"] - ends["low"]) / F.lit(bins)).alias("width"))
    number = F.when(F.col("width") == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1)))
    return (
        placed.groupBy(number.cast("int").alias("bin"), "low", "width")
        .agg(F.count("*").alias("n_rows"))
        .select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), "n_rows")
    )


def select_model(comparison: DataFrame, split: str = "valid") -> DataFrame:
    """The model with the smallest MAE on ``split``; the earlier one on a tie.
    Expects model, position, split and mae."""
    best = F.struct("mae", "position")
    return (comparison.filter(F.col("split") == split)
            .agg(F.min_by("model", best).alias("selected_model"),
                 F.min("mae").alias("mae")))
