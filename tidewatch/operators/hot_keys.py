"""Totals per key where a few keys hold most rows.

Each input split, whatever keys it holds, adds its rows into dense accumulator arrays with ``numpy.bincount``; only array
blocks are shuffled, so a key that holds a third of the table costs each split one array cell, and no task sees more than
its split. Blocks are summed in two steps, first spread over a fixed fan-in and then to one array per block.

Keys are numbered by one dictionary (block, cell) that all splits share as long as it is small enough to broadcast. Beyond
that each split numbers the keys it meets itself, per block, and a block carries its keys beside its sums; blocks with
different numbers are brought to one numbering when they are added. Rows aren't shuffled either way. The spreading of
blocks follows the number of the split, so a split that is computed again after a loss gives the same blocks.

Defined results: null and blank keys are no keys and are left out; null measures count as 0; an empty table gives
an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.storage import pinned

BLOCK = 4096
#: A dictionary of at most so many bytes of keys is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of accumulators, or of rows with keys, a split holds before it hands its blocks on.
SPLIT_BYTES = 64 << 20
#: Tasks over which the blocks of one number are spread in the first step.
FAN_IN = 16


def usable_key(key: Column) -> Column:
    return key.isNotNull() & (F.trim(key) != "")


def key_sizes(rows: DataFrame) -> tuple[int, int]:
    """About how many distinct keys there are, and about the bytes of a dictionary of them."""
    n, mean = rows.agg(F.approx_count_distinct("key"), F.coalesce(F.avg(F.length("key") + F.lit(40)), F.lit(0.0))).first()
    return n, int(n * mean)


def dictionary(rows: DataFrame) -> tuple[DataFrame, int]:
    """(key, block, cell) for every distinct key, and their bytes."""
    keys = pinned(rows.select("key").distinct(), "hot-keys")
    n, size = keys.agg(F.count("key"), F.coalesce(F.sum(F.length("key") + F.lit(40)), F.lit(0))).first()
    cells = keys.withColumn("block", block_of(n))
    order = Window.partitionBy("block").orderBy("key")
    return cells.withColumn("cell", (F.row_number().over(order) - 1).cast("int")), size


def block_of(keys: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(max(1, -(-keys // (BLOCK // 2))))).cast("int")


def _salt() -> int:
    return TaskContext.get().partitionId() % FAN_IN


def _accumulate(measures: list[str]):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            blocks = sorted(held)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(blocks, pa.int32()),
                    pa.array([_salt()] * len(blocks), pa.int32()),
                    pa.array([held[b].ravel() for b in blocks], pa.list_(pa.float64())),
                ],
                ["block", "salt", "sums"],
            )
            held.clear()
            return made

        for batch in batches:
            block, cell = batch.column("block").to_numpy(), batch.column("cell").to_numpy()
            weights = [batch.column(m).to_numpy(zero_copy_only=False) for m in measures]
            for b in np.unique(block):
                at = block == b
                here = cell[at]
                width = int(here.max()) + 1
                own = held.get(b)
                if own is None or own.shape[1] < width:
                    wider = np.zeros((1 + len(measures), width))
                    if own is not None:
                        wider[:, : own.shape[1]] = own
                    own = held[b] = wider
                own[0, :width] += np.bincount(here, minlength=width)
                for i, w in enumerate(weights, 1):
                    own[i, :width] += np.bincount(here, weights=w[at], minlength=width)
            if sum(a.nbytes for a in held.values()) > SPLIT_BYTES:
                yield out()
        if held:
            yield out()

    return split


def _summed(rows: int, keys: list[str]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a group arrive in batches; one array per group is held."""
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            for k, flat in zip(ids, batch.column("sums"), strict=True):
                a = np.asarray(flat.values).reshape(rows, -1)
                own = held.get(k)
                if own is None:
                    held[k] = a.copy()
                elif own.shape[1] < a.shape[1]:
                    held[k] = a.copy()
                    held[k][:, : own.shape[1]] += own
                else:
                    own[:, : a.shape[1]] += a
        if held:
            done = sorted(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in done], pa.int32()) for i in range(len(keys))]
                + [pa.array([held[k].ravel() for k in done], pa.list_(pa.float64()))],
                [*keys, "sums"],
            )

    return add


def _numbered_blocks(block: np.ndarray, keys: pa.Array, sums: np.ndarray, ids: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each block (and each of the other ``ids`` of its keys): its keys and the [measure, key] sums as one list."""
    order = np.lexsort((*ids.values(), block))
    spread = np.stack([block[order], *(v[order] for v in ids.values())])
    starts = np.flatnonzero(np.append(True, (spread[:, 1:] != spread[:, :-1]).any(0))) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(order)))
    flat = [sums[:, order[a : a + n]].ravel() for a, n in zip(starts, sizes, strict=True)]
    columns = [pa.array(spread[i, starts], pa.int32()) for i in range(1 + len(ids))]
    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), keys.take(pa.array(order)))
    return pa.RecordBatch.from_arrays([*columns, listed, pa.array(flat, pa.list_(pa.float64()))], ["block", *ids, "keys", "sums"])


def _accumulate_own(measures: list[str]):
    """As ``_accumulate``, by keys the split numbers itself."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            coded = rows.column("key").chunk(0).dictionary_encode()
            code, n = coded.indices.to_numpy(), len(coded.dictionary)
            sums = [np.bincount(code, minlength=n)]
            sums += [np.bincount(code, weights=rows.column(m).to_numpy(), minlength=n) for m in measures]
            block = np.zeros(n, np.int64)
            block[code] = rows.column("block").to_numpy()
            return _numbered_blocks(block, coded.dictionary, np.array(sums, float), {"salt": np.full(n, _salt())})

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > SPLIT_BYTES:
                yield out()
                size = 0
        if held:
            yield out()

    return split


def _summed_own(rows: int, ids: list[str]):
    """As ``_summed``: the blocks of a partition brought to one numbering and added."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(k).to_pylist() for k in ids), strict=True))
            for k, keys, flat in zip(groups, batch.column("keys"), batch.column("sums"), strict=True):
                more, sums = keys.values, np.asarray(flat.values).reshape(rows, -1)
                if k in held:
                    more, sums = pa.concat_arrays([held[k][0], more]), np.hstack([held[k][1], sums])
                    coded = more.dictionary_encode()
                    code, n = coded.indices.to_numpy(), len(coded.dictionary)
                    more, sums = coded.dictionary, np.array([np.bincount(code, weights=s, minlength=n) for s in sums])
                held[k] = more, sums
        for k, (keys, sums) in sorted(held.items()):
            n = len(keys)
            values = dict(zip(ids, k, strict=True))
            yield _numbered_blocks(np.full(n, values.pop("block")), keys, sums, {i: np.full(n, v) for i, v in values.items()})

    return add


def _by_shared_numbers(rows: DataFrame, keys: DataFrame, measures: list[str]) -> DataFrame:
    """key, n_rows and the sums; ``keys`` is small enough to broadcast."""
    shape, add = "block int, {}sums array<double>", 1 + len(measures)
    parts = rows.join(F.broadcast(keys), "key").drop("key").mapInArrow(_accumulate(measures), shape.format("salt int, "))
    # each pair (block, salt), and then each block, is wholly in one partition
    half = parts.repartition("block", "salt").mapInArrow(_summed(add, ["block", "salt"]), shape.format("salt int, "))
    whole = half.repartition("block").mapInArrow(_summed(add, ["block"]), shape.format(""))
    width = (F.size("sums") / add).cast("int")
    cells = whole.withColumn("width", width).select(
        "block", "sums", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("cell")
    )
    cells = cells.select("block", "cell", *_unpacked(F.col("cell"), F.col("width"), measures))
    return keys.join(cells, ["block", "cell"]).select("key", "n_rows", *measures)


def _by_own_numbers(rows: DataFrame, count: int, measures: list[str]) -> DataFrame:
    """key, n_rows and the sums, for any number of keys (about ``count``)."""
    shape, add = "block int, {}keys array<string>, sums array<double>", 1 + len(measures)
    parts = rows.withColumn("block", block_of(count)).mapInArrow(_accumulate_own(measures), shape.format("salt int, "))
    half = parts.repartition("block", "salt").mapInArrow(_summed_own(add, ["block", "salt"]), shape.format("salt int, "))
    whole = half.repartition("block").mapInArrow(_summed_own(add, ["block"]), shape.format(""))
    cells = whole.select("sums", F.size("keys").alias("width"), F.posexplode("keys").alias("cell", "key"))
    return cells.select("key", *_unpacked(F.col("cell"), F.col("width"), measures))


def _unpacked(cell: Column, width: Column, measures: list[str]) -> list[Column]:
    return [
        F.get("sums", cell).cast("long").alias("n_rows"),
        *[F.get("sums", cell + i * width).alias(n) for i, n in enumerate(measures, 1)],
    ]


def dense_totals(df: DataFrame, key: Column, measures: dict[str, Column] | None = None) -> DataFrame:
    """key_value, n_rows and the sum of every measure, for all keys of ``df``."""
    measures = measures or {}
    names = [f"m{i}" for i in range(len(measures))]
    rows = df.select(
        key.alias("key"),
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, measures.values(), strict=True)],
    ).where(usable_key(F.col("key")))
    count, size = key_sizes(rows)
    keys = None
    if size <= BROADCAST_BYTES:
        keys, size = dictionary(rows)
    if keys is not None and size <= BROADCAST_BYTES:
        found = _by_shared_numbers(rows, pinned(keys, "hot-dictionary"), names)
    else:
        found = _by_own_numbers(rows, count, names)
    return found.select(F.col("key").alias("key_value"), "n_rows", *[F.col(n).alias(m) for n, m in zip(names, measures, strict=True)])


def heavy_keys(df: DataFrame, key: Column, share: float = 0.03) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of the table (rows without a key count as rows)."""
    total = df.count()
    return dense_totals(df, key).where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select("key_value", "n_rows")
