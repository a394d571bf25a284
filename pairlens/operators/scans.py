"""Running values of groups of any size: two levels, blocks of the order and what each block hands on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 128
#: Rows of the order that are looked at for each block's end; they place the ends and never change a result.
SAMPLED = 64


def _sortable(column: str, kind: str) -> Column:
    """A column that has a literal in every time zone, in the same order; years 0 to 9999."""
    if kind == "timestamp":
        return F.unix_micros(column)
    return F.col(column).cast("string") if kind in ("timestamp_ntz", "date") else F.col(column)


def _block(place: Sequence[Column], cuts: list, kinds: list[str]) -> Column:
    """Number of cuts at or below a place, by halving."""

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        cut = F.struct(*[F.lit(v).cast(k) for v, k in zip(cuts[mid], kinds, strict=True)])
        return F.when(F.struct(*place) < cut, below(low, mid)).otherwise(below(mid + 1, high))

    return below(0, len(cuts))


def in_blocks(rows: DataFrame, order: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """Adds ``_block``, which rises with the order columns (nulls first) and splits all rows into about equal blocks.

    The order is counted and sampled when this is called, by jobs that read its
    columns only; about ``blocks * SAMPLED`` rows come to the driver. Rows equal in
    the whole order share a block, so name enough columns to tell most rows apart.
    """
    kinds = dict(rows.dtypes)
    place = [_sortable(c, kinds[c]) for c in order]
    only = rows.select(*[p.alias(f"o{i}") for i, p in enumerate(place)])
    n = only.count()
    few = only if n <= blocks * SAMPLED else only.sample(blocks * SAMPLED / n, seed=7)
    sample = few.repartition(1).sortWithinPartitions(*only.columns).collect()  # so few that a global sort would only read them once more
    step = max(1, len(sample) // blocks)
    cuts = list(dict.fromkeys(tuple(r) for r in sample[step::step]))
    return rows.withColumn("_block", _block(place, cuts, [k for _, k in only.dtypes]))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], blocks: int = BLOCKS) -> DataFrame:
    """Adds running values of each group in order (nulls first), the row itself included; ``rows`` must give the same rows each time.

    ``values`` names columns with a kind (sum, min, max, or last: the latest that is
    not null) and what it runs over. A value is null until the first that is not
    null. Rows that are equal in ``by`` and ``order`` come in any order. A task holds
    one block of a group, at most about 1 / ``blocks`` of all rows, and what blocks
    hand on is a row for each block of a group. Double sums are added up by block,
    so their last digits can differ from those of one window. No column of
    ``rows`` may be named _key, _block or _v, _t, _c with a number.
    """
    inner = {f"_v{i}": v.alias(f"_v{i}") for i, (_, v) in enumerate(values.values())}
    placed = in_blocks(rows, order, blocks).select("*", F.struct(*by).alias("_key"), *inner.values())
    here = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "min": F.min, "max": F.max}
    whole, carry, out = [], [], []
    for (name, (kind, _)), v in zip(values.items(), inner, strict=True):
        x, t, c = F.col(v), F.col(f"_t{v[2:]}"), F.col(f"_c{v[2:]}")
        if kind == "last":
            whole.append(F.max_by(x, F.when(x.isNotNull(), F.struct(*order))).alias(f"_t{v[2:]}"))
            carry.append(F.last(t, ignorenulls=True).over(before).alias(f"_c{v[2:]}"))
            out.append(F.coalesce(F.last(x, ignorenulls=True).over(here), c).alias(name))
            continue
        of = plain[kind]
        now = of(x).over(here)
        whole.append(of(x).alias(f"_t{v[2:]}"))
        carry.append(of(t).over(before).alias(f"_c{v[2:]}"))
        both = {"sum": now + c, "min": F.least(now, c), "max": F.greatest(now, c)}[kind]
        out.append(F.coalesce(both, now, c).alias(name))
    handed = placed.groupBy("_key", "_block").agg(*whole).select("_key", "_block", *carry)
    return placed.join(handed, ["_key", "_block"]).select(*rows.columns, *out)
