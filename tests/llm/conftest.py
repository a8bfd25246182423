"""Small tables with everything that must not break an operator."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows():
    """Nulls, empties, long texts, copies, near copies, repeated rows and clashing ids."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    line = "a line that is repeated in many documents"
    texts = [
        None, "", "   \n\t ", "one", "One", "two words", "three little words", base, base, near, base.upper(), prose(rng, 3000), "x " * 500, "é" * 30 + "\n" + line, f"  {line.upper()}\t\nother words here",
        f"{line}\n\n{line}", "\n", prose(rng, 50), "tab\tand\x0bvertical\x0cfeed\rreturn", "名前 は ない です",
    ]
    rows = [(i, t, "en", [None, "b", "a", "c"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, base, None, None, None), (None, "no id here", "en", "a", 10), (7, "another text with an id that is taken", "en", "a", 38)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "n size row rows label labels body place h bytes shard whole depth starts kept score media hash bits set group dropped lines pos a b key keep target cell deep salt number other own rank lost winner text_ _gone _d _b _c _w _shard _text _row".split()
    return odd.select("*", *[F.lit(1).alias(c) for c in names])
