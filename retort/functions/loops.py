"""Detection of a pattern repeated at the end of a token sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_loop(tokens: Column, min_len: int = 5, max_len: int = 200, repeats: int = 3) -> Column:
    """True if some pattern of ``min_len..max_len`` tokens ends the sequence ``repeats`` times.

    The last ``p * repeats`` tokens repeat with period ``p`` exactly when that tail
    without its last ``p`` tokens equals it without its first ``p``.
    """
    if min_len < 1 or max_len < 1:
        raise ValueError("pattern lengths must be at least 1")
    if repeats < 2:
        raise ValueError("at least 2 repeats are needed")
    size = F.size(tokens)
    longest = F.least(F.lit(max_len), F.floor(size / F.lit(repeats)).cast("int"))

    def periodic(p: Column) -> Column:
        kept = p * F.lit(repeats - 1)
        start = size - p * F.lit(repeats) + F.lit(1)
        same_last = F.get(tokens, size - 1) == F.get(tokens, size - 1 - p)
        return same_last & (F.slice(tokens, start, kept) == F.slice(tokens, start + p, kept))

    lengths = F.sequence(F.lit(min_len), longest)
    return F.coalesce(
        F.when(longest >= F.lit(min_len), F.exists(lengths, periodic)), F.lit(False)
    )
