"""Source choice: the first candidate source that has rows, preferring one that carries blank/void counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_usable_source(candidates: Sequence[Callable[[], DataFrame]], *, counts_col: str = "blancs") -> DataFrame:
    """Try the candidates in order (each a lazy reader). A non-empty source with a non-null
    ``counts_col`` wins at once; otherwise the first non-empty one is kept. Each test is a one-row job."""
    first_nonempty = None
    for make in candidates:
        try:
            df = make()
        except Exception:  # noqa: BLE001 - a missing source is skipped, as in the original
            continue
        if df.limit(1).count() == 0:
            continue
        if counts_col not in df.columns or df.where(F.col(counts_col).isNotNull()).limit(1).count() > 0:
            return df
        first_nonempty = first_nonempty or df
    if first_nonempty is None:
        raise FileNotFoundError("no candidate source has rows")
    return first_nonempty
