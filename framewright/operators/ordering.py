"""Order-dependent computations that stay parallel when one key holds most of the rows.

A SQL window puts all rows of a key into one task. ``KeyedScan`` keeps that plan for ordinary
keys (one shuffle, no extra pass over the rows) and cuts only the *hot* keys, found by a counting
pre-pass, into contiguous ordered chunks by a range partitioning on (key, order). An operator
then runs the same window expression per (key, chunk) and corrects it with what the earlier
chunks of the key contribute, which is one row per (hot key, chunk). Hot keys and these rows stay
tables of any size; Catalyst decides from their size how to join them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framewright.session import pin

HOT_ROWS = 2_000_000

_CHUNK = "_chunk"
_POSITION_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: position in the partition


def hot_row_limit(df: DataFrame) -> int:
    """Rows above which a key is split; ``spark.framewright.hotRows`` overrides the default."""
    return int(df.sparkSession.conf.get("spark.framewright.hotRows", str(HOT_ROWS)))


def sorted_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of a key together in one partition and in order, to be read as a stream.

    The partition count is fixed, because what follows is Python work, which adaptive coalescing
    by bytes would squeeze into too few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def _same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _range_chunks(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    """Number the range partitions of ``df`` from 1 and pin that numbering."""
    return pin(df.repartitionByRange(n, *by).withColumn(_CHUNK, F.spark_partition_id() + 1))


@dataclass
class HotKeys:
    """Keys that hold more rows than one task should take: a pinned table of them, and how many chunks they fill."""

    table: DataFrame
    chunks: int

    def renamed(self, **names: Column) -> HotKeys:
        """The same keys under other names or forms."""
        return HotKeys(self.table.select(*[c.alias(n) for n, c in names.items()]), self.chunks)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> HotKeys | None:
    """The keys holding more rows than one task should take; None, as a rule, if there is none.

    Counts combine map-side. A compound key can only be hot when its first part is, so that is
    counted first and usually ends the search.
    """
    limit = hot_rows or hot_row_limit(df)
    if len(keys) > 1:
        coarse = hot_keys(df, keys[:1], limit)
        if coarse is None:
            return None
        df = df.join(coarse.table, _same_keys(df, coarse.table, keys[:1]), "left_semi")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    found, rows = counts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    return HotKeys(pin(counts.select(*keys)), 1 + rows // limit) if found else None


def lookup_join(
    rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner", hot: HotKeys | None = None
) -> DataFrame:
    """Join rows to a table with one row per key, so that the rows of a hot key spread over tasks.

    Rows of ``hot`` keys are salted, and just those keys' entries are repeated for every salt; all others join as usual.
    """
    if hot is None:
        return rows.join(per_key, key, how)
    salts = F.lit(hot.chunks)
    few = per_key.join(hot.table, key, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = rows.join(hot.table, key, "left_semi").withColumn("_salt", F.pmod(F.hash(*rows.columns), salts))
    return salted.join(few, [key, "_salt"], how).drop("_salt").unionByName(
        rows.join(hot.table, key, "left_anti").join(per_key, key, how)
    )


class KeyedScan:
    """Rows of ``df`` prepared for running computations per ``keys`` in ``order``.

    ``rows`` is the input (plus a chunk column when some key was split), ``window`` the ordered
    window to compute over and ``running`` its frame up to the current row. ``order`` must be
    unique within a key. Keys are counted in ``counted``, where given: a cheaper table ``df`` is
    made from, with at least about as many rows per key.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot_rows: int | None = None,
        counted: DataFrame | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        limit = hot_rows or hot_row_limit(df)
        hot = hot_keys(df if counted is None else counted, self.keys, limit)
        self.split = hot is not None
        if not self.split:
            self.rows = df
            self.window = Window.partitionBy(*self.keys).orderBy(*self.order)
            self.running = self.window.rowsBetween(Window.unboundedPreceding, 0)
            return
        table = hot.table
        same = _same_keys(df, table, self.keys)
        chunked = _range_chunks(
            df.join(table, same, "left_semi"), [F.col(c) for c in self.keys + self.order], hot.chunks
        )
        self.rows = df.join(table, same, "left_anti").withColumn(_CHUNK, F.lit(0)).unionByName(chunked)
        self.window = Window.partitionBy(*self.keys, _CHUNK).orderBy(*self.order)
        self.running = self.window.rowsBetween(Window.unboundedPreceding, 0)

    def carry(
        self,
        rows: DataFrame,
        summary: Sequence[Column],
        fold: Callable[[DataFrame, WindowSpec], DataFrame],
        defaults: dict[str, Column],
    ) -> DataFrame:
        """Add to each row what the earlier chunks of its key contribute.

        ``summary`` are aggregates over one chunk; ``fold`` gets the table of them and a window
        over the strictly earlier chunks of a key and adds the columns named in ``defaults``.
        Rows without earlier chunks take the default.
        """
        if not self.split:
            return rows.select("*", *[c.alias(name) for name, c in defaults.items()])
        per_chunk = rows.where(F.col(_CHUNK) > 0).groupBy(*self.keys, _CHUNK).agg(*summary)
        earlier = (
            Window.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        )
        by = [*self.keys, _CHUNK]
        # pinned, so that the next carry's plan does not contain this one's twice
        carried = pin(
            fold(per_chunk, earlier).select(
                *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
                *[F.col(name).alias(f"_v_{name}") for name in defaults],
            )
        )
        condition = F.lit(True)
        for i, name in enumerate(by):
            condition = condition & F.col(name).eqNullSafe(F.col(f"_k{i}"))
        joined = rows.join(carried, condition, "left")
        return joined.select(
            *rows.columns,
            *[F.coalesce(F.col(f"_v_{name}"), default).alias(name) for name, default in defaults.items()],
        )

    def finish(self, rows: DataFrame) -> DataFrame:
        """Drop the chunk column."""
        return rows.drop(_CHUNK)


def with_group_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "idx",
    hot_rows: int | None = None,
    weight: str | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row within its ``keys`` group in ``order``.

    A ``weight`` column lets one row stand for several earlier ones (a count carried over).
    """
    scan = KeyedScan(df, keys, order, hot_rows, counted)
    step = F.col(weight) if weight else F.lit(1)
    rows = scan.rows.withColumn(name, F.sum(step).over(scan.running).cast("bigint") - 1)
    rows = scan.carry(
        rows,
        [F.sum(step).alias("_n")],
        lambda chunks, earlier: chunks.withColumn("_before", F.sum("_n").over(earlier)),
        {"_before": F.lit(0).cast("bigint")},
    )
    return scan.finish(rows.withColumn(name, F.col(name) + F.col("_before")).drop("_before"))


def with_global_index(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """0-based position of each row of the whole table in ``order``, without a one-task window.

    Range partition, sort inside, pin, then add each partition's offset. The offset table has one
    row per partition. ``order`` must be unique.
    """
    by = [F.col(c) for c in order]
    rows = pin(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(_POSITION_BITS))
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_pos") + F.col("_offset")).cast("bigint"))
        .drop("_part", "_pos", "_offset")
    )


def seeded_order(seed: int, id_col: str) -> Column:
    """A pseudo-random but reproducible sort key per row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
