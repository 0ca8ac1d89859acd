"""Model-ready tables: imputation, log and standard scaling, one-hot with fixed domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import BINARY, CATEGORIES, CONTINUOUS, CYCLICAL, DISCRETE, GENERATIVE_CATEGORICAL, GENERATIVE_CONTINUOUS, MODEL_INPUT, SKEWED, ContractError, require_columns
from ..sources.scratch import Scratch
from .quantiles import quantiles_wide

#: Values of a column that are made columns of their own.
MAX_DOMAIN = 1000


def fit_medians(df: DataFrame, columns: list[str] = CONTINUOUS, stored: bool = False) -> dict[str, float]:
    """Exact medians; 0.0 where all values are null. A ``stored`` table is not written again."""
    row = quantiles_wide(df, [], columns, {0.5: "m"}, stored=stored).first()
    return {c: float(row[f"m_{c}" if len(columns) > 1 else "m"] or 0.0) if row else 0.0 for c in columns}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def log_skewed(df: DataFrame, columns: list[str] = SKEWED) -> DataFrame:
    """log1p of values clipped at zero; null stays null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c), F.lit(0.0)))) for c in columns})


def fit_scaler(df: DataFrame, columns: list[str] = CONTINUOUS) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of zero counts as one."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (float(row[f"m_{c}"] or 0.0), float(row[f"s_{c}"] or 0.0) or 1.0) for c in columns}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def one_hot(df: DataFrame, domains: dict[str, list[str]] = CATEGORIES) -> DataFrame:
    """0/1 columns ``<column>_<value>`` in place of each column; a value outside its domain has zeros only."""
    new = {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0).cast("byte") for c, values in domains.items() for v in values}
    return df.withColumns(new).drop(*domains)


def free_domains(frames: list[DataFrame], columns: list[str]) -> dict[str, list[str]]:
    """All values, as text, that the columns take in any of the frames, in order; over ``MAX_DOMAIN`` of them are an error."""
    both = frames[0].select(*columns)
    for f in frames[1:]:
        both = both.unionByName(f.select(*columns))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("e")
    with Scratch(both.sparkSession) as own:
        values = own.write(both.select(cells).select("e.*").where("v is not null").distinct(), "domains")
        wide = values.groupBy("c").count().where(F.col("count") > MAX_DOMAIN).first()
        if wide:
            raise ContractError(f"{wide.c} has {wide['count']} values, more than {MAX_DOMAIN} columns can stand for")
        found: dict[str, list[str]] = {c: [] for c in columns}
        for r in values.orderBy("c", "v").collect():  # at most MAX_DOMAIN a column
            found[r.c].append(r.v)
        return found


def fit_scaling(trips: DataFrame, stored: bool = False) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Medians, and mean and deviation after imputation and logarithms, from one written copy of the continuous columns or a ``stored`` table."""
    with Scratch(trips.sparkSession) as own:
        slim = trips.select(*CONTINUOUS)
        slim = slim if stored else own.write(slim, "continuous-columns")
        medians = fit_medians(slim, stored=True)
        return medians, fit_scaler(log_skewed(impute(slim, medians)))


def model_input(trips: DataFrame, stored: bool = False) -> tuple[DataFrame, dict]:
    """The 22 model columns and the parameters they were made with; trips are computed twice unless they are a ``stored`` table."""
    require_columns(trips, [*CATEGORIES, *DISCRETE, *BINARY, *CYCLICAL, *CONTINUOUS], "model input")
    medians, scaler = fit_scaling(trips, stored)
    coded = one_hot(scale(log_skewed(impute(trips, medians)), scaler))
    small, real = [*DISCRETE, *BINARY], [*CYCLICAL, *CONTINUOUS]
    coded = coded.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("byte") for c in small} | {c: F.col(c).cast("float") for c in real})
    return coded.select(*MODEL_INPUT), {"medians": medians, "scaler": scaler, "features": MODEL_INPUT}


def generative_table(trips: DataFrame) -> DataFrame:
    """The 16 columns of the generative table."""
    require_columns(trips, [*GENERATIVE_CATEGORICAL, *GENERATIVE_CONTINUOUS], "generative table")
    return trips.select(*GENERATIVE_CATEGORICAL, *[F.col(c).try_cast("float").alias(c) for c in GENERATIVE_CONTINUOUS])
