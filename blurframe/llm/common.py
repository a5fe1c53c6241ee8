"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import broadcast_if_small, drop_scratch, materialize, n_shuffle, scratch_path, ship, table

__all__ = ["WORD", "broadcast_if_small", "drop_scratch", "lower_ascii", "materialize", "n_shuffle", "packed", "scratch_path", "ship", "table"]

#: Words between spaces and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(df: DataFrame) -> Column:
    """A whole row as one struct, so that its columns cannot clash with those of an operator; ``select("<name>.*")`` unpacks it."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
