"""Reports of runs: averages, pivots, accuracy of a cost model, statistics of counter intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def averages(runs: DataFrame, by: list[str], metrics: dict[str, str], ratios: dict[str, tuple[str, str]] | None = None, digits: int = 6) -> DataFrame:
    """Rows and mean metrics for each group, metrics as {name: column}; ratios of sums as {name: (above, below)}. A mean of nothing is 0."""
    means = [F.coalesce(F.round(F.avg(column), digits), F.lit(0.0)).alias(name) for name, column in metrics.items()]
    shares = [F.round(F.sum(a) / F.sum(b), 9).alias(name) for name, (a, b) in (ratios or {}).items()]
    return runs.groupBy(*by).agg(F.count("*").alias("n"), *means, *shares)


def rolled_up(runs: DataFrame, by: list[str], metrics: dict[str, str], digits: int = 6) -> DataFrame:
    """The averages of each group, of each leading part of ``by``, and of all."""
    return runs.rollup(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(name) for name, c in metrics.items()])


def wide(runs: DataFrame, by: list[str], kind: str, kinds: list[str], metrics: dict[str, str], digits: int = 6) -> DataFrame:
    """A row for each group, a column ``<kind>_<metric>`` for each kind and metric, and the number of rows."""
    cells = [F.round(F.avg(F.when(F.col(kind) == k, F.col(c))), digits).alias(f"{k.lower()}_{name}") for k in kinds for name, c in metrics.items()]
    return runs.groupBy(*by).agg(*cells, F.count("*").alias("n"))


def over_runs(results: DataFrame, run: str, by: list[str], metrics: list[str], digits: int = 6) -> DataFrame:
    """Mean over runs of each run's own mean, so that a run counts once however many rows it has; and the runs."""
    each = results.groupBy(run, *by).agg(*[F.avg(m).alias(m) for m in metrics])
    return each.groupBy(*by).agg(F.count("*").alias("runs"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def accuracy(rows: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """Root mean square error, mean relative error, relative error of the sums, and how often the prediction is above or below."""
    p, a = F.col(predicted), F.col(actual)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg((p - a) * (p - a))), 6).alias("rmse"), F.round(F.avg(F.abs(p - a) / F.greatest(F.abs(a), F.lit(1e-9))), 9).alias("mape"),
        F.round(F.abs(F.sum(p) - F.sum(a)) / F.sum(a), 9).alias("overall"), share(p > a).alias("over_share"), share(p < a).alias("under_share"),
    )


def level_accuracy(rows: DataFrame, by: list[str], pattern: str, level: str, predicted: str, actual: str) -> DataFrame:
    """How often the level of the least predicted cost is the best one, one beside it, or within one; and what it costs.

    rows: predicted and actual cost for each pattern and level. Of equal costs the first level counts.
    gain: mean actual cost at level 0 less that at the predicted level.
    """
    best = rows.groupBy(*by, pattern).agg(
        F.min(F.struct(F.col(predicted).alias("cost"), F.col(level).alias("level"), F.col(actual).alias("real"))).alias("said"),
        F.min(F.struct(F.col(actual).alias("cost"), F.col(level).alias("level"))).alias("true"), F.min(F.when(F.col(level) == 0, F.col(actual))).alias("root"),
    )
    off = F.abs(F.col("said.level") - F.col("true.level"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return best.groupBy(*by).agg(
        F.count("*").alias("patterns"), count(off == 0).alias("exact"), count(off == 1).alias("beside"), count(off <= 1).alias("within"),
        F.round(F.avg(F.col("said.real") - F.col("true.cost")), 6).alias("excess"), F.round(F.avg(F.col("root") - F.col("said.real")), 6).alias("gain"),
    )


def intervals(rows: DataFrame, by: list[str], order: list[str], value: Column, weights: tuple[str, str], skip: int = 0, trim: int = 0) -> DataFrame:
    """Statistics of a ratio over the intervals of each group.

    The first ``skip`` intervals by ``order`` are left out as warm-up, then the ``trim`` least and greatest by value
    (none where that would leave nothing). Percentiles are by nearest rank, the deviation is the population's;
    ratio: the sum of the first weight over that of the second.
    """
    warm = Window.partitionBy(*by).orderBy(*order)
    used = rows.withColumn("_at", F.row_number().over(warm)).where(F.col("_at") > skip).withColumn("_value", value.cast("double")).where("_value is not null")
    ranked = used.withColumns({"_rank": F.row_number().over(Window.partitionBy(*by).orderBy("_value", *order)), "_size": F.count("*").over(Window.partitionBy(*by))})
    kept = ranked.where((F.col("_size") <= 2 * trim) | ((F.col("_rank") > trim) & (F.col("_rank") <= F.col("_size") - trim)))
    again = kept.withColumns({"_rank": F.row_number().over(Window.partitionBy(*by).orderBy("_value", *order)), "_size": F.count("*").over(Window.partitionBy(*by))})
    nearest = lambda q: F.round(F.min(F.when(F.col("_rank") == F.greatest(F.ceil(F.lit(q) * F.col("_size") / 100), F.lit(1)), F.col("_value"))), 6)
    return again.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("_value"), 6).alias("mean"), F.round(F.stddev_pop("_value"), 6).alias("sd"), F.round(F.min("_value"), 6).alias("least"),
        nearest(50).alias("median"), nearest(90).alias("p90"), nearest(99).alias("p99"), F.round(F.sum(weights[0]) / F.sum(weights[1]), 9).alias("ratio"),
    )


def across(summaries: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over the repetitions of a configuration."""
    cells = [c for m in metrics for c in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_sd"))]
    return summaries.groupBy(*by).agg(F.count("*").alias("reps"), *cells)


def counters(rows: DataFrame, by: list[str], event: str, value: str, names: dict[str, str]) -> DataFrame:
    """One column for each counter: names {column: pattern}; the sum of a group's values whose event matches."""
    return rows.groupBy(*by).agg(*[F.sum(F.when(F.col(event).rlike(pattern), F.col(value))).alias(name) for name, pattern in names.items()])


def trials(results: DataFrame, by: list[str], value: str, flags: list[str]) -> DataFrame:
    """Trials of each configuration, the mean value, and how often each flag holds."""
    each = [F.round(F.avg(F.when(F.col(f), 1.0).otherwise(0.0)), 6).alias(f"{f}_rate") for f in flags]
    return results.groupBy(*by).agg(F.count("*").alias("trials"), F.round(F.avg(value), 6).alias(f"mean_{value}"), *each)


def filled(columns: list[Column]) -> Column:
    """The sum of columns, null counting as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])
