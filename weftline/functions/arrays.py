"""Token arrays: padding, truncation, masks and positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    """At least `length` items, with pad ids in front or behind."""
    filler = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(filler, ids) if left else F.concat(ids, filler)


def truncated(ids: Column, length: int, side: str = "right") -> Column:
    """At most `length` items: from the right, the left or the middle; side "error" fails the job for longer ones."""
    n = F.size(ids)
    if side == "right":
        return F.slice(ids, 1, length)
    if side == "left":
        return F.slice(ids, F.greatest(n - length + 1, F.lit(1)), length)
    if side == "middle":
        half = length // 2
        return F.when(n <= length, ids).otherwise(F.concat(F.slice(ids, 1, half), F.slice(ids, n - (length - half) + 1, length - half)))
    if side == "error":
        return F.when(n <= length, ids).otherwise(F.raise_error(F.concat(F.lit(f"longer than {length}: "), n.cast("string"))))
    raise ValueError(f"unknown side {side}")


def fitted(ids: Column, length: int, pad: int, left_pad: bool = True, side: str = "error") -> Column:
    return padded(truncated(ids, length, side), length, pad, left_pad)


def response_mask(ids: Column, end: int) -> Column:
    """1 up to the first end id and on it, 0 after."""
    at = F.array_position(ids, F.lit(end).cast("bigint"))
    return F.transform(ids, lambda x, i: ((at == 0) | (i < at)).cast("int"))


def positions(mask: Column) -> Column:
    """Running count of the mask less one, at least 0."""

    @F.pandas_udf("array<int>")
    def run(column):
        import numpy as np

        return column.map(lambda m: None if m is None else np.maximum(np.cumsum(np.asarray(m, dtype=np.int64)) - 1, 0).astype(np.int32))

    return run(mask)


def without_padding(ids: Column, mask: Column) -> Column:
    """The last sum(mask) items."""
    n = F.aggregate(mask, F.lit(0), lambda a, y: a + y.cast("int"))
    return F.when(n > 0, F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)).otherwise(F.slice(ids, 1, 0))


def aligned_logprobs(values: Column, length: int, fill: float = -1.0) -> Column:
    """Cut to a length and filled up behind."""
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(values), F.lit(0))))


def entropy(logits: Column) -> Column:
    """logsumexp(x) - sum(p x), with the largest logit taken out first."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * x) / total
    return top + F.log(total) - mean


def let(value: Column, use) -> Column:
    """use(value), with the value made once: an expression that names it often would otherwise grow with every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
