"""Running values over long ordered sequences without one task per sequence.

A plain window over a file, host or log puts the whole of it in one task, and one file may
hold a third of all rows. Here every sequence is cut into chunks by a column that never
decreases along the order (a byte range, a block of positions). Chunks are summarised, the
short list of summaries is accumulated per sequence, and rows inside a chunk add their own
part. Rows are shuffled once, by (sequence, chunk); results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Prior:
    """A value taken over all rows before the current one in its sequence.

    kind: "sum" (0 at the start), "max", "last" (previous row), "first" (first non-null).
    """

    kind: str
    value: Column

    def summarise(self, order: Column) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        if self.kind == "last":
            return F.max_by(self.value, order)
        if self.kind == "first":
            return F.min_by(self.value, F.when(self.value.isNotNull(), order))
        raise ValueError(f"unknown kind {self.kind!r}")

    def over(self, value: Column, window) -> Column:
        if self.kind == "sum":
            return F.coalesce(F.sum(value).over(window), F.lit(0).cast("bigint"))
        if self.kind == "max":
            return F.max(value).over(window)
        if self.kind == "last":
            return F.last(value).over(window)
        return F.first(value, ignorenulls=True).over(window)

    def combine(self, carried: Column, local: Column, at_chunk_start: Column) -> Column:
        if self.kind == "sum":
            return carried + local
        if self.kind == "max":
            return F.greatest(carried, local)
        if self.kind == "last":
            return F.when(at_chunk_start, carried).otherwise(local)
        return F.coalesce(carried, local)


def with_prior(
    df: DataFrame,
    keys: list[str],
    chunk: list[str],
    order: list[str],
    priors: dict[str, Prior],
    coarse: list[str] | None = None,
) -> DataFrame:
    """Add one column per prior. Rows are ordered by (coarse, chunk, order) within keys.

    Keys, chunk and order columns must not be null and (keys, coarse, chunk, order) must be
    unique. The summaries come from a second scan of the few columns they need,
    pre-aggregated before their shuffle. Where a sequence can have very many chunks, such as
    a host with millions of small files, `coarse` groups them, and the summaries are
    accumulated in the same two steps.
    """
    if coarse:
        chunk = [*coarse, *chunk]
    position = F.struct(*order)
    summaries = df.groupBy(*keys, *chunk).agg(
        *[prior.summarise(position).alias(f"_s_{name}") for name, prior in priors.items()]
    )
    if coarse:
        accumulated = with_prior(
            summaries,
            keys,
            chunk=coarse,
            order=chunk[len(coarse):],
            priors={f"_c_{n}": Prior(p.kind, F.col(f"_s_{n}")) for n, p in priors.items()},
        )
        carried = accumulated.select(*keys, *chunk, *[f"_c_{name}" for name in priors])
    else:
        earlier_chunks = (
            Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = summaries.select(
            *keys,
            *chunk,
            *[
                prior.over(F.col(f"_s_{name}"), earlier_chunks).alias(f"_c_{name}")
                for name, prior in priors.items()
            ],
        )
    joined = df.join(carried, [*keys, *chunk])
    within = Window.partitionBy(*keys, *chunk).orderBy(*order)
    earlier_rows = within.rowsBetween(Window.unboundedPreceding, -1)
    local = joined.select(
        *[F.col(c) for c in df.columns],
        *[F.col(f"_c_{name}") for name in priors],
        *[prior.over(prior.value, earlier_rows).alias(f"_l_{name}") for name, prior in priors.items()],
        (F.row_number().over(within) == 1).alias("_chunk_start"),
    )
    return local.select(
        *df.columns,
        *[
            prior.combine(F.col(f"_c_{name}"), F.col(f"_l_{name}"), F.col("_chunk_start")).alias(name)
            for name, prior in priors.items()
        ],
    )
