"""Parsing of the small textual arguments of experiments."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_csv(text: str, keep_empty: bool = False) -> list[str]:
    parts = [p.strip() for p in text.split(",")]
    return parts if keep_empty else [p for p in parts if p]


def parse_bool(text: str) -> bool:
    t = text.strip().lower()
    if t in ("1", "true", "yes", "on"):
        return True
    if t in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"not a boolean: {text!r}")


def sanitize_filename(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", text)


def target_name(points: int) -> str:
    """500000 -> 500k, 1000000 -> 1M, others as they are."""
    if points % 1_000_000 == 0:
        return f"{points // 1_000_000}M"
    return f"{points // 1000}k" if points % 1000 == 0 else str(points)


def target_name_column(c: str) -> Column:
    n = F.col(c)
    return F.when(n % 1_000_000 == 0, F.concat((n / 1_000_000).cast("long").cast("string"), F.lit("M"))).when(n % 1000 == 0, F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def parse_targets(text: str) -> list[int]:
    """``a,b,c`` or ``range:start:end:step`` (end included), sorted and distinct."""
    if text.startswith("range:"):
        start, end, step = map(int, text.split(":")[1:4])
        if step <= 0:
            raise ValueError("step must be positive")
        values: Iterable[int] = range(start, end + 1, step)
    else:
        values = map(int, split_csv(text))
    return sorted(set(values))
