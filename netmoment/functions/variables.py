"""Constrained variables: a domain that is checked, transforms to the real line and back, and arithmetic of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, NumericType, ShortType

from . import expr as E


@dataclass(frozen=True)
class Constraint:
    """Bounds of a number; soft: by ln(exp(x) - 1) rather than ln(x); whole: integers only."""

    lower: float | None = None
    upper: float | None = None
    soft: bool = False
    whole: bool = False

    def __post_init__(self) -> None:
        if self.lower is not None and self.upper is not None and self.lower >= self.upper:
            raise ValueError(f"the lower bound {self.lower} must be below the upper one {self.upper}")

    def check_type(self, kind: DataType) -> None:
        """An error if a column of this type can't hold the variable."""
        if not isinstance(kind, NumericType) or (self.whole and not isinstance(kind, (ByteType, ShortType, IntegerType, LongType))):
            raise TypeError(f"expected {'an integer' if self.whole else 'a number'}, got {kind.simpleString()}")

    def inside(self, x: Column) -> Column:
        """Whether a number is within the bounds; null for null."""
        out = ~F.isnan(x.cast("double"))
        if self.lower is not None:
            out = out & (x >= self.lower)
        if self.upper is not None:
            out = out & (x <= self.upper)
        return F.when(x.isNotNull(), out)

    def check(self, x: Column) -> Column:
        """The number, or an error if it is out of bounds; null stays null."""
        wrong = F.raise_error(F.concat(F.lit(f"out of bounds [{self.lower}, {self.upper}]: "), x.cast("string"))).cast("double")
        return F.when(F.coalesce(self.inside(x), F.lit(True)), x).otherwise(wrong)

    def free(self, x: Column) -> Column:
        """The real number that stands for a value."""
        return E.constrain_free(x, self.lower, self.upper, self.soft)

    def back(self, y: Column) -> Column:
        return E.constrain_back(y, self.lower, self.upper, self.soft)


@dataclass(frozen=True)
class Variable:
    """A named column with its constraint; arithmetic gives plain columns."""

    name: str
    constraint: Constraint = Constraint()

    @property
    def column(self) -> Column:
        return F.col(self.name)

    def checked(self) -> Column:
        return self.constraint.check(self.column).alias(self.name)

    def free(self) -> Column:
        return self.constraint.free(self.column)

    def __add__(self, other: Column | float) -> Column:
        return self.column + other

    __radd__ = __add__

    def __sub__(self, other: Column | float) -> Column:
        return self.column - other

    def __rsub__(self, other: Column | float) -> Column:
        return F.lit(other) - self.column

    def __mul__(self, other: Column | float) -> Column:
        return self.column * other

    __rmul__ = __mul__

    def __truediv__(self, other: Column | float) -> Column:
        return self.column / other

    def __rtruediv__(self, other: Column | float) -> Column:
        return F.lit(other) / self.column

    def __pow__(self, other: Column | float) -> Column:
        return F.pow(self.column, other if isinstance(other, Column) else F.lit(other))

    def __neg__(self) -> Column:
        return -self.column

    def __pos__(self) -> Column:
        return self.column

    def __getitem__(self, index: int) -> Column:
        return self.column[index]

    def astype(self, kind: str) -> Column:
        return self.column.cast(kind)
