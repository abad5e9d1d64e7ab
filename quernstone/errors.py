"""Errors and fail-closed checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QuernstoneError(RuntimeError):
    """Base of all errors of this package."""


class ContractError(QuernstoneError):
    """A table broke a contract."""


class ProvenanceError(QuernstoneError):
    """Files differ from what a manifest says."""


class ArtifactError(ProvenanceError):
    """A file that is written once would change."""


class PocketError(ContractError):
    """A pocket cannot be defined or mapped."""


class ViewError(ContractError):
    """A structure view breaks its contract."""


class ServiceError(QuernstoneError):
    """A remote service answered otherwise than agreed, or not at all."""


class EncoderError(QuernstoneError):
    """An encoder, its files or its output break the contract."""


class LigandError(QuernstoneError):
    """A molecule or its atom mapping is outside of the contract."""


def require_none(bad: DataFrame, message: str, show: int = 5) -> None:
    """Fail if there is any row, and name the first ones."""
    rows = bad.limit(show).collect()
    if rows:
        raise ContractError(f"{message}: {[r.asDict() for r in rows]}")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    require_none(df.groupBy(*keys).count().where("count > 1"), f"{keys} must be unique")
    return df


def mandatory(df: DataFrame, other: DataFrame, on: list[str], message: str) -> DataFrame:
    """A left join in which a missing partner fails the query instead of dropping the row."""
    mark = "__found"
    joined = df.join(other.withColumn(mark, F.lit(True)), on, "left")
    found: Column = F.when(F.col(mark).isNull(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return joined.withColumn(mark, found).where(mark).drop(mark)


def labelled(*labels: str) -> Column:
    """Whether a row carries any label; "0" counts as one."""
    any_label = F.lit(False)
    for c in labels:
        any_label = any_label | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return any_label


def no_labels(df: DataFrame, *labels: str) -> None:
    """References must carry no label; every row is looked at."""
    require_none(df.where(labelled(*labels)), "labels on reference rows")


def disjoint(left: DataFrame, right: DataFrame, on: list[str], message: str) -> None:
    require_none(left.join(right, on, "left_semi").select(*on), message)


def _not_finite(columns: list[str]) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return bad


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail now if a value is null, not a number or infinite."""
    require_none(df.where(_not_finite(columns)), "values must be finite")
    return df


def finite_rows(df: DataFrame, columns: list[str], names: tuple[str, ...] | None = None) -> DataFrame:
    """The same inside the plan: the query that reads such a row fails. names: the columns must be these, in order."""
    if names is not None and tuple(columns) != tuple(names):
        raise ContractError("columns differ from their schema")
    return df.where(F.when(_not_finite(columns), F.raise_error(F.lit("values must be finite")).cast("boolean")).otherwise(F.lit(True)))


def finite_array(column: str, size: int) -> Column:
    """An array of so many finite values; anything else fails the query."""
    c = F.col(column)
    good = (F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), c).otherwise(F.raise_error(F.lit(f"{column} must hold {size} finite values")).cast("array<double>"))
