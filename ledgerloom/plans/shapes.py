"""Plan shapes shared by the operators: running totals, top-n, fixed-size expansion, exact medians.

Each keeps the work of one task bounded even when a single key owns a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20
HOT_ROWS = 1 << 22
SLOTS = 1 << 20


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """Number of the block a row position falls into."""
    return F.call_function("div", position, F.lit(rows))


def running_totals(df: DataFrame, by: list[str], block: list[str], order: list[str],
                   totals: Mapping[str, Column], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Running sums inside `by`, row included, without sending a hot group to one task.

    Groups are hashed to a fixed number of slots and the rows per slot counted, mostly map-side. That
    table has at most SLOTS rows however large the data, so it is safe to broadcast. Groups in a slot
    of up to `hot_rows` rows are summed by one window over one shuffle. Groups in a fuller slot are cut
    along `block`, columns that divide a group into consecutive pieces along `order`: each piece is a
    window of its own, and the sums of the pieces before it, one aggregated row per piece, go through the
    same shuffle as the rows and come first in the window of their piece, so rows are shuffled once and joined with nothing.
    Without hot groups that side is empty and the adaptive planner drops it. Nulls in `by` and `block` are values like any
    other: they group and sort first. With `hot_rows` None no group is cut, as for a table whose buckets hold whole groups
    already: it is then one window, for which such a table needs no exchange.
    """
    if hot_rows is None:
        whole = Window.partitionBy(*by).orderBy(*block, *order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(value).over(whole).alias(name) for name, value in totals.items()])
    slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*by), F.lit(SLOTS)))
    hot = (
        slotted.groupBy("_slot").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
        .select("_slot", F.lit(True).alias("_hot"))
    )
    pieces = [f"_piece{i}" for i in range(len(block))]
    rows = slotted.join(F.broadcast(hot), "_slot", "left").withColumns(
        {piece: F.when(F.col("_hot"), F.col(column)) for piece, column in zip(pieces, block)})
    before = {name: f"{name}__before" for name in totals}
    earlier = Window.partitionBy(*by).orderBy(*pieces).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.filter("_hot").groupBy(*by, *pieces)
        .agg(*[F.sum(value).alias(name) for name, value in totals.items()])
        .select(*by, *pieces, *[F.sum(n).over(earlier).alias(b) for n, b in before.items()])
        .filter(reduce(Column.__or__, (F.col(b).isNotNull() for b in before.values())))
    )
    within = (
        Window.partitionBy(*by, *pieces).orderBy("_is_row", *block, *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = rows.select(*df.columns, *pieces, F.lit(True).alias("_is_row")).unionByName(
        offsets.withColumn("_is_row", F.lit(False)), allowMissingColumns=True)
    return both.select("*", *[
        (F.sum(F.when(F.col("_is_row"), value)).over(within)
         + F.coalesce(F.first(before[name], ignorenulls=True).over(within), F.lit(0))).alias(name)
        for name, value in totals.items()
    ]).filter("_is_row").select(*df.columns, *totals)


def same(left: DataFrame, right: DataFrame, columns: Mapping[str, str]) -> Column:
    """Join condition: the columns of `left` equal the named ones of `right`, null equal to null."""
    return reduce(Column.__and__, (left[a].eqNullSafe(right[b]) for a, b in columns.items()))


def not_stored(new: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `new` whose key is not in `stored`.

    Of a large store only the keys that the new rows ask for get past its scan: with few new rows the store is
    filtered by a broadcast and never shuffled. Which way is taken is left to Spark's size check.
    """
    asked = new.select(*on).distinct()
    held = stored.select(*on).join(asked, list(on), "left_semi").distinct()
    return new.join(held, list(on), "left_anti").select(*new.columns)


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in `order`. Spark prunes each map task to one row per key first."""
    return top_per_key(df, key, order, 1).drop("rank")


def top_per_key(df: DataFrame, key: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first `n` rows per key with their `rank`.

    The rank filter is pushed below the shuffle as a per-task group limit; without a key it is a
    plain sort with limit, ranked after the cut.
    """
    if not key:
        df = df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank", place).filter(F.col("rank") <= n)


def expand(df: DataFrame, carry: Iterable[str], rows: Iterable[Mapping[str, Column]]) -> DataFrame:
    """Turn one wide row into a fixed list of narrow rows, in the same task."""
    items = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return df.select(*carry, F.inline(F.array(*items)))


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add costly columns so that they are worked out once per row.

    The optimizer copies plain expressions into every filter and column that uses them. Columns that
    come out of a generator stay where they are, so text is parsed once however often the result is
    tested later. Filters on these columns are therefore not pushed into the scan.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_accounts(sums: DataFrame, accounts: DataFrame | None, keys: Iterable[str]) -> DataFrame:
    """Add the accounts that have no row in `sums`, with zero in every number.

    Without a table of accounts, or without keys, `sums` stays as it is. Accounts missing in the table are kept.
    """
    keys = list(keys)
    if accounts is None or not keys:
        return sums
    return accounts.select(*keys).distinct().join(sums, keys, "full").fillna(
        0, [c for c in sums.columns if c not in keys])


def with_total(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the per-key total of `value`; the totals are aggregated map-side and joined on the keys."""
    if not keys:
        return df.withColumn(name, df.select(F.coalesce(F.sum(value), F.lit(0))).scalar())
    return df.join(df.groupBy(*keys).agg(F.sum(value).alias(name)), keys)


def at_rank_with_repeats(ordered: Column, repeated: Column, copies: Column, rank: Column) -> Column:
    """Element `rank` (from 1) of a sorted array merged with `copies` of the value `repeated`."""
    below = F.size(F.filter(ordered, lambda x: x < repeated))
    return (
        F.when(rank <= below, F.get(ordered, rank - 1))
        .when(rank <= below + copies, repeated)
        .otherwise(F.get(ordered, rank - copies - 1))
    )
