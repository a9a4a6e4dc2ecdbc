"""Standard scaling with the population standard deviation, and feature vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_zero


@dataclass(frozen=True)
class Scaler:
    """Mean and standard deviation per column, in column order."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def scaled(self, prefix: str = "") -> list:
        """(x − mean)/std per column, non-finite values 0 before and after."""
        out = []
        for c, m, s in zip(self.columns, self.mean, self.std):
            z = (finite_or_zero(c) - F.lit(m)) / F.lit(s)
            out.append(finite_or_zero(z).alias(prefix + c))
        return out

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        rest = [c for c in df.columns if prefix or c not in self.columns]
        return df.select(*rest, *self.scaled(prefix))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, m, s) for i, (c, m, s) in enumerate(zip(self.columns, self.mean, self.std))]
        return spark.createDataFrame(rows, "idx int, column string, mean double, std double")

    @classmethod
    def from_frame(cls, frame: DataFrame) -> "Scaler":
        rows = sorted(frame.collect(), key=lambda r: r["idx"])
        return cls(
            tuple(r["column"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows)
        )


def scaler_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One aggregate row: mean and population std of every column; std 0 becomes 1."""
    cells = []
    for c in columns:
        v = finite_or_zero(c)
        cells += [F.avg(v).alias(f"mean_{c}"), F.stddev_pop(v).alias(f"std_{c}")]
    row = df.agg(*cells)
    return row.select(
        *[
            x
            for c in columns
            for x in (
                F.col(f"mean_{c}"),
                F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(F.lit(1.0)).alias(f"std_{c}"),
            )
        ]
    )


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    row = scaler_statistics(train, columns).first()
    return Scaler(
        tuple(columns),
        tuple(float(row[f"mean_{c}"] or 0.0) for c in columns),
        tuple(float(row[f"std_{c}"]) for c in columns),
    )


def assemble(df: DataFrame, before: Sequence[str], block: str | None, after: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector in fixed order: scalars, optional vector column, scalars.

    NULL, NaN and ±Inf become 0. The assembler stores whichever of the dense and sparse
    forms is smaller.
    """
    clean = {f"_v_{c}": finite_or_zero(c) for c in [*before, *after]}
    inputs = [*(f"_v_{c}" for c in before), *([block] if block else []), *(f"_v_{c}" for c in after)]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(df.withColumns(clean)).drop(*clean)


@dataclass(frozen=True)
class VectorScaler:
    """Mean and population standard deviation of every vector component."""

    mean: tuple[float, ...]
    std: tuple[float, ...]

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        """(x − mean)/std per component, non-finite results 0; row-local."""
        parts = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(self.mean, self.std)])
        scaled = F.zip_with(vector_to_array(column), parts, lambda x, p: finite_or_zero((x - p["m"]) / p["s"]))
        return df.withColumn(column, array_to_vector(scaled))


    def scale_only(self, df: DataFrame, column: str = "features") -> DataFrame:
        """x/std per component, so that zeros of a sparse vector take no place.

        The shift by the mean changes no order within a component, hence no split of a tree, and is part of a linear model's
        intercept.
        """
        factors = Vectors.dense([1.0 / s for s in self.std])
        scaled = ElementwiseProduct(scalingVec=factors, inputCol=column, outputCol="_scaled").transform(df)
        return scaled.withColumn(column, F.col("_scaled")).drop("_scaled")


def fit_vector_scaler(train: DataFrame, column: str = "features") -> VectorScaler:
    """One mergeable aggregate over the whole vector, however wide; zero std becomes 1."""
    s = train.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s")).first()["s"]
    n = float(s["count"])
    shrink = (n - 1) / n if n > 1 else 0.0  # the summarizer reports the sample variance
    std = [(float(v) * shrink) ** 0.5 or 1.0 for v in s["variance"]]
    return VectorScaler(tuple(float(m) for m in s["mean"]), tuple(std))


def check_length(scaler: VectorScaler, size: int) -> None:
    """A vector of another length than the fitted one is an error, not a silent misalignment."""
    if len(scaler.mean) != size:
        raise ValueError(f"scaler was fitted on {len(scaler.mean)} components, vectors have {size}")
