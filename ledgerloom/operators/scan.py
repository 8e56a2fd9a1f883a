"""Pattern scans over a text column. Whole texts are read; nothing leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.shapes import expand

# Shapes that give a secret away.
SECRET_SHAPES = {
    "api_key": r"(?i)sk-[A-Za-z0-9_-]{20}",
    "private_key": r"(?i)BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY",
    "chat_token": r"(?i)xox[baprs]-[A-Za-z0-9-]{10}",
    "cloud_key": r"(?i)AKIA[0-9A-Z]{16}",
}


def flag_shapes(df: DataFrame, column: str, shapes: Mapping[str, str] = SECRET_SHAPES) -> DataFrame:
    """One boolean column per shape."""
    return df.withColumns({f"has_{name}": F.coalesce(F.col(column).rlike(p), F.lit(False))
                           for name, p in shapes.items()})


def scan_shapes(df: DataFrame, column: str, shapes: Mapping[str, str] = SECRET_SHAPES) -> DataFrame:
    """Per shape: texts it occurs in and occurrences. One pass, one partly aggregated row per task."""
    text = F.coalesce(F.col(column), F.lit(""))
    counts = [(name, F.regexp_count(text, F.lit(p))) for name, p in shapes.items()]
    wide = df.select(*[c.alias(name) for name, c in counts]).agg(*[
        agg for name, _ in counts
        for agg in (F.count_if(F.col(name) > 0).alias(f"t_{name}"),
                    F.coalesce(F.sum(name), F.lit(0)).alias(f"n_{name}"))
    ])
    return expand(wide, [], [
        {"shape": F.lit(name), "texts": F.col(f"t_{name}"), "matches": F.col(f"n_{name}")}
        for name in shapes
    ])


def usable_patterns(lines: list[str]) -> list[str]:
    """Pattern lines without comments and blanks."""
    return [line for line in lines if line.strip() and not line.lstrip().startswith("#")]


def scan_patterns(df: DataFrame, column: str, lines: list[str]) -> DataFrame:
    """Rows whose text contains any listed pattern, in any case; with no usable pattern, none."""
    patterns = usable_patterns(lines)
    if not patterns:
        return df.filter(F.lit(False))
    for pattern in patterns:
        re.compile(pattern)
    return df.filter(F.col(column).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def redact(df: DataFrame, column: str, values: list[str], mask: str = "***") -> DataFrame:
    """Replace every occurrence of the given values; empty values are ignored."""
    text = F.col(column)
    for value in filter(None, values):
        text = F.replace(text, F.lit(value), F.lit(mask))
    return df.withColumn(column, text)
