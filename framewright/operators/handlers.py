"""User handlers over message rows: the four shapes row/rows to row/rows.

Handlers get pandas data. Ordered handlers read a key's rows as a stream of batches, so a key of
any size fits; a fold that can be merged runs on every input partition first and shuffles only
its partial results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.operators.ordering import sorted_by_key

#: Stands for a null key where pandas would not tell it from others.
NO_KEY = "\0"


def handler_signal(rows: DataFrame, handler: Callable[..., pd.Series], inputs: Sequence[str], output: str,
                   type_name: str) -> DataFrame:
    """Row to row."""
    return rows.withColumn(output, F.pandas_udf(handler, type_name)(*inputs))


def handler_produce_stream(rows: DataFrame, handler: Callable[..., pd.Series], inputs: Sequence[str],
                           element_type: str) -> DataFrame:
    """Row to rows: the handler returns a list per row; ``pos`` keeps the order."""
    others = [c for c in rows.columns]
    items = F.pandas_udf(handler, f"array<{element_type}>")(*inputs)
    return rows.withColumn("_items", items).select(*others, F.posexplode("_items").alias("pos", "item"))


def handler_produce_table(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    handler: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.Table]]],
    schema: str,
) -> DataFrame:
    """Row to rows, in the order of a key's rows, by a table function over ``rows`` partitioned by ``keys``.

    ``handler()`` is called once a key and returns what turns a batch of the key's rows, which come in ``order``, into
    tables; it may keep state from batch to batch. A key of any size is a stream of batches. An empty table gives no rows.
    """

    class Produce:
        def __init__(self):
            self.produce = handler()

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            yield from self.produce(batch)

    table = rows.asTable().partitionBy(*keys).orderBy(*order)
    return F.arrow_udtf(Produce, returnType=schema)(table)


def handler_consume_stream(
    rows: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Rows to one row per key, by a fold in two steps.

    ``partial`` folds a batch of rows to one row per key in it, ``merge`` folds partial rows the
    same way. Every input partition is folded before the shuffle, so a key arrives as one row per
    partition whatever its size; those rows are merged batch by batch in key order. Both see integer
    keys as text and a null key as NO_KEY, for pandas would round large integers beside a null.
    """
    out = T.StructType.fromDDL(schema)
    texts = [k for k in keys if isinstance(rows.schema[k].dataType, (T.IntegralType, T.StringType))]
    inside = T.StructType([T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in out])
    keyed = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(NO_KEY)) for k in texts})
    folded = keyed.mapInPandas(_FoldPartition(partial, merge), inside)
    merged = sorted_by_key(folded, keys).mapInPandas(_MergeSorted(list(keys), merge), inside)
    back = {f.name: F.nullif(F.col(f.name), F.lit(NO_KEY)).cast(f.dataType) for f in out if f.name in texts}
    return merged.withColumns(back)


class _FoldPartition:
    """Fold batches into partial rows, passing them on when they become too many to hold.

    ``MAX_HELD`` bounds memory only: rows passed on early meet again after the shuffle, so the result is the same.
    """

    MAX_HELD = 100_000

    def __init__(self, partial, merge):
        self.partial = partial
        self.merge = merge

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            part = self.partial(batch)
            held = part if held is None else self.merge(pd.concat([held, part], ignore_index=True))
            if len(held) > self.MAX_HELD:
                yield held
                held = None
        if held is not None:
            yield held


class _MergeSorted:
    """Merge partial rows sorted by key; the last key of a batch waits for the next one."""

    def __init__(self, keys: list[str], merge):
        self.keys = keys
        self.merge = merge

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            merged = self.merge(batch)
            last = (merged[self.keys] == batch[self.keys].iloc[-1]).all(axis=1)
            held = merged[last]
            yield merged[~last]
        if held is not None:
            yield held


def handler_process_stream(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    handler: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Rows to rows per key in order: ``handler(key, batches)`` sees a key's rows as sorted batches.

    The handler is arbitrary and ordered, so a key's rows are in one task, as a stream. Integer keys cross to
    Python as text and reach the handler as whole numbers, null as None.
    """
    whole = [k for k in keys if isinstance(rows.schema[k].dataType, T.IntegralType)]
    in_order = sorted_by_key(rows, keys, order).withColumns({k: F.col(k).cast("string") for k in whole})
    return in_order.mapInPandas(_PerKey(list(keys), handler, whole), schema)


class _PerKey:
    """Cuts a partition sorted by key into one batch stream per key."""

    def __init__(self, keys: list[str], handler, whole: Sequence[str] = ()):
        self.keys = keys
        self.handler = handler
        self.whole = set(whole)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = self._pieces(batches)
        held = next(pieces, None)
        while held is not None:
            key, rest = held[0], [held]

            def of_key(key=key, rest=rest):
                piece = rest.pop()
                while piece is not None and piece[0] == key:
                    yield piece[1]
                    piece = next(pieces, None)
                rest.append(piece)

            stream = of_key()
            yield from self.handler(key, stream)
            for _ in stream:  # rows the handler left unread
                pass
            held = rest[0]

    def _pieces(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for batch in batches:
            if not len(batch):
                continue
            known = batch[self.keys].astype(object).where(batch[self.keys].notna(), NO_KEY)
            run = (known != known.shift()).any(axis=1).cumsum()
            for _, piece in batch.groupby(run, sort=False):
                key = tuple(self._value(k, piece[k].iloc[0]) for k in self.keys)
                restored = {k: pd.array([v] * len(piece), "Int64") for k, v in zip(self.keys, key, strict=True) if k in self.whole}
                yield key, piece.assign(**restored)

    def _value(self, name: str, value):
        if pd.isna(value):
            return None
        return int(value) if name in self.whole else value
