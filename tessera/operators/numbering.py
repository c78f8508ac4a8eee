"""Row numbers and first rows by key without one task a key.

A window over a hot key sorts all its rows in one task. Here rows are dealt by
range over key and order, so a hot key lies in many tasks, each with a stretch
of it; only a count by task and key is gathered, and its prefix sums lift the
places that rows have in their own task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Rows of starts (one by task and key) up to which they are sent to every task.
MOST_SENT = 200_000
#: Rows that a task holds before it cuts them to the first of each key.
HELD = 50_000


def numbers(df: DataFrame, by: list[str], order: list[Column | str], out: str = "n") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... by ``order`` among the rows of a key (of all rows without a key).

    As ``row_number`` over the same window: ``order`` (names or expressions)
    ascends, nulls first; null keys are a key of their own. ``order`` should end
    in a unique key: rows that are equal in it lie in one task and are numbered
    as they come. The dealt rows are settled before they
    are counted, so numbers stay the same if a task is run again; pass only the
    columns that are needed. An empty frame stays empty.
    """
    keys, places = [f"_key{i}" for i in range(len(by))], [f"_order{i}" for i in range(len(order))]
    laid = df.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)} | {p: F.col(o) if isinstance(o, str) else o for p, o in zip(places, order, strict=True)})
    laid = settled(laid.repartitionByRange(*keys, *places).sortWithinPartitions(*keys, *places).drop(*places))
    id_ = F.monotonically_increasing_id()
    laid = laid.select("*", F.shiftright(id_, 33).alias("_task"), id_.bitwiseAND((1 << 33) - 1).alias("_at"))
    starts = laid.groupBy("_task", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row by task
    lift = settled(starts.select("_task", *keys, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_lift")))
    lift = lift.withColumnsRenamed({c: f"{c}_" for c in ("_task", *keys)})
    if lift.limit(MOST_SENT + 1).count() <= MOST_SENT:
        lift = F.broadcast(lift)
    same = [F.col("_task") == F.col("_task_"), *(F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)]
    return laid.join(lift, same).select(*df.columns, (F.col("_at") + F.col("_lift")).alias(out))


def first_rows(df: DataFrame, by: str, order: list[str], limits: DataFrame, limit: str = "limit") -> DataFrame:
    """Of each key the first rows by ``order``, as many as ``limits(by, limit)`` says; keys without a limit go.

    Each task cuts its rows to the limit of each key before they are shuffled,
    so at most a limit's rows by key and task meet; what they give is cut again.
    A task holds some ``HELD`` rows: if the first rows of its keys are more than
    half of that, it passes them on and begins anew.
    """
    rows = df.join(limits.select(by, limit), by)
    columns = rows.columns
    key, most = columns.index(by), columns.index(limit)
    keys = [(c, "ascending") for c in (by, *order)]

    def cut(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        rank = np.arange(len(codes)) - np.repeat(new, np.diff(np.concatenate([new, [len(codes)]])))
        return table.filter(pa.array(rank < table.column(most).to_numpy()))

    def partial(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                kept = cut(pa.Table.from_batches(held))
                held, n = kept.to_batches(), kept.num_rows
                if n > HELD // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from cut(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)

    few = rows.mapInArrow(partial, rows.schema)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= F.col(limit)).select(*df.columns)
