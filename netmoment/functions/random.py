"""Random numbers as columns: hashes of a seed and of what identifies a row, turned into distributions."""

from __future__ import annotations

import hashlib
import math
import secrets
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import hash_uniform


@dataclass(frozen=True)
class RandomGenerator:
    """A seed; the same seed and parts give the same numbers, wherever they are computed."""

    seed: int

    @classmethod
    def of(cls, seed: RandomGenerator | int | None = None) -> RandomGenerator:
        """From a seed, another generator, or the system's entropy."""
        return seed if isinstance(seed, RandomGenerator) else cls(secrets.randbits(31) if seed is None else int(seed))

    def child(self, tag: object) -> RandomGenerator:
        """An independent generator for a purpose."""
        return RandomGenerator(int.from_bytes(hashlib.md5(f"{self.seed}/{tag}".encode()).digest()[:7], "big"))

    def split(self, n: int) -> list[RandomGenerator]:
        return [self.child(k) for k in range(n)]

    def uniform(self, *parts: Column | int | str, low: float = 0.0, high: float = 1.0) -> Column:
        u = hash_uniform(self.seed, *parts)
        return u if (low, high) == (0.0, 1.0) else low + (high - low) * u

    def normal(self, *parts: Column | int | str, mean: float = 0.0, sd: float = 1.0) -> Column:
        """By Box and Muller's transform of two uniforms."""
        r = F.sqrt(-2 * F.log1p(-hash_uniform(self.seed, *parts, "r")))
        return mean + sd * r * F.cos(2 * math.pi * hash_uniform(self.seed, *parts, "t"))

    def exponential(self, *parts: Column | int | str, rate: float = 1.0) -> Column:
        return -F.log1p(-hash_uniform(self.seed, *parts)) / rate

    def bernoulli(self, p: Column | float, *parts: Column | int | str) -> Column:
        return hash_uniform(self.seed, *parts) < p

    def choice(self, n: Column | int, *parts: Column | int | str) -> Column:
        """A number from 0 to n - 1."""
        return F.floor(hash_uniform(self.seed, *parts) * n).cast("long")

    def randint(self, low: int, high: int, *parts: Column | int | str) -> Column:
        """A whole number from low to high - 1."""
        return self.choice(high - low, *parts) + low

    def logistic(self, *parts: Column | int | str, mean: float = 0.0, scale: float = 1.0) -> Column:
        u = hash_uniform(self.seed, *parts)
        return mean + scale * (F.ln(u) - F.log1p(-u))

    def laplace(self, *parts: Column | int | str, mean: float = 0.0, scale: float = 1.0) -> Column:
        v = hash_uniform(self.seed, *parts) - 0.5
        return mean - scale * F.signum(v) * F.log1p(-2 * F.abs(v))

    def gumbel(self, *parts: Column | int | str, mean: float = 0.0, scale: float = 1.0) -> Column:
        return mean - scale * F.ln(-F.ln(hash_uniform(self.seed, *parts)))

    def cauchy(self, *parts: Column | int | str, mean: float = 0.0, scale: float = 1.0) -> Column:
        return mean + scale * F.tan(math.pi * (hash_uniform(self.seed, *parts) - 0.5))

    def geometric(self, p: float, *parts: Column | int | str) -> Column:
        """Tries up to the first success of chance p."""
        return F.floor(F.log1p(-hash_uniform(self.seed, *parts)) / math.log1p(-p)).cast("long") + 1

    def pareto(self, *parts: Column | int | str, shape: float = 1.0, scale: float = 1.0) -> Column:
        return scale * F.pow(1 - hash_uniform(self.seed, *parts), F.lit(-1 / shape))

    def weibull(self, *parts: Column | int | str, shape: float = 1.0, scale: float = 1.0) -> Column:
        return scale * F.pow(-F.log1p(-hash_uniform(self.seed, *parts)), F.lit(1 / shape))
