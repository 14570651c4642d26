"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(labelled: DataFrame, key: str, rows: int, seed: int, most_bytes: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``labelled`` (all, if there are fewer), chosen by a hash of ``key``.

    The share kept follows from a count of the rows, which reads narrow columns only; the expected
    size never grows with the table. With ``most_bytes`` it is so small that texts of about so many bytes are kept.
    """
    if most_bytes is None:
        n, total = labelled.count(), 0
    else:
        n, total = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(rows / n if n else 1.0, most_bytes / total if total else 1.0)
    if share >= 1:
        return labelled
    return labelled.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))
