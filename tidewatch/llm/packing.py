"""Filling fixed-capacity containers with documents sized in tokens.

The instance is the histogram of sizes: at most ``capacity`` rows, whatever the number of documents. On it runs the
reduction of Martello and Toth: a set of up to three items is fixed for good where it dominates every other feasible set
with its item (alone, with an exact complement or the largest partner, or with the best pair), the instance shrinks, and
the next item is looked at. The remainder is packed by best fit, containers filled alike being one row. The plan (fillings with multiplicities) is broadcast, a few thousand rows at most; documents of one size are
numbered in splits, so that a size of which there are billions is never one task's group, and take their places.

Defined results: null texts are no documents; blank texts have their tokens (an empty text has none and takes no
room, in a container of its own with all others of size zero); a document over the capacity is cut into full
containers and one rest, which is packed like a document; ties between documents of one size go by split, then id;
ids may repeat (each row is a document).
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.storage import pinned, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenization pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Documents of a split, and the most splits; documents of one size are numbered split by split.
SPLIT, SPLITS = 100_000, 1024


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and tokens of every document. The vocabulary is a file of the driver's, sent to all executors."""
    context = documents.sparkSession.sparkContext
    context.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(SparkFiles.get(name))
        for batch in batches:
            # a lone surrogate can't be encoded; very long unbroken runs are cut, which costs a token at most
            sizes = []
            for text in batch.column(1).to_pylist():
                text = text.encode("utf-8", "replace").decode("utf-8", "replace")
                sizes.append(sum(len(tool.encode_ordinary(text[i : i + 100_000])) for i in range(0, len(text), 100_000)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    rows = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, tokens long")


class _Items:
    """Items by size with how many are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
        self.sizes = sorted(self.left)

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for s in pattern:
            self.left[s] -= times
        for s in set(pattern):
            if not self.left[s]:
                del self.left[s]
                self.sizes.remove(s)

    def largest(self, room: int, *used: int) -> int | None:
        """The largest size of at most ``room`` that is left beside the items ``used``."""
        i = bisect_right(self.sizes, room) - 1
        while i >= 0 and self.left[self.sizes[i]] <= used.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def fitting(self, room: int, most: int, *used: int) -> int:
        """How many of the smallest items, ``most`` at most, fit into ``room`` beside the items ``used``."""
        n = 0
        for s in self.sizes:
            k = min(self.left[s] - used.count(s), room // s, most - n)
            n, room = n + k, room - k * s
            if n == most or room < s and k < self.left[s] - used.count(s):
                break
        return n

    def best_pair(self, room: int, *used: int) -> tuple[int, int] | None:
        """The two sizes, larger first, whose sum comes closest to ``room``; of equal sums the one with the largest size."""
        best, high = None, len(self.sizes) - 1
        for low, s in enumerate(self.sizes):
            while high >= low and self.sizes[high] + s > room:
                high -= 1
            for i in range(high, low - 1, -1):
                t = self.sizes[i]
                if self.left[t] > used.count(t) + (t == s) and self.left[s] > used.count(s) + (t == s):
                    if best is None or (s + t, t) > (sum(best), best[0]):
                        best = (t, s)
                    break
        return best


def dominant(items: _Items, big: int, capacity: int) -> tuple[int, ...] | None:
    """The set with ``big`` that dominates every other feasible set with it, after Martello and Toth; none if that isn't
    proven. Sets of up to three items are considered."""
    room = capacity - big
    fit = items.fitting(room, 3, big)
    if not fit:
        return (big,)
    partner = items.largest(room, big)
    if fit == 1 or partner == room:
        return (big, partner)
    if fit == 2:
        pair = items.best_pair(room, big)
        if pair is None or partner >= sum(pair):
            return (big, partner)
        if pair[0] == partner:
            # no two items between the pair's, or the two next larger than its smaller one don't fit
            between = [s for s in items.sizes[bisect_right(items.sizes, pair[1]) : bisect_right(items.sizes, pair[0])] for _ in range(min(items.left[s] - (s == big) - (s == pair[0]), 2)) if s > pair[1]]
            if len(between) <= 1 or between[0] + between[1] > room:
                return (big, *pair)
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (sizes, largest first) with how often each is used, for ``counts`` items of each size in 1..capacity."""
    items = _Items(counts, capacity)
    fillings: list[tuple[tuple[int, ...], int]] = []
    # the reduction: every size in falling order, also where a larger one stays unproven
    for size in reversed(list(items.sizes)):
        while size in items.left and (found := dominant(items, size, capacity)):
            times = min(items.left[s] // found.count(s) for s in found)
            # what is proven now holds as long as no size of the set runs out
            fillings.append((tuple(sorted(found, reverse=True)), times))
            items.take(found, times)
    # best fit of the rest: the largest item first, each into the fullest container that takes it; containers filled alike
    # are one row
    rooms: list[int] = []
    alike: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in alike:
            insort(rooms, room)
            alike[room] = []
        alike[room].append((pattern, times))

    for size in reversed(items.sizes):
        n = items.left[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                put(capacity, (), n)
                continue
            room = rooms[i]
            pattern, times = alike[room].pop()
            if not alike[room]:
                del alike[room]
                rooms.pop(i)
            # a container takes further items of the size only while no fuller one does
            copies = room // size
            whole = min(times, n // copies)
            if whole:
                put(room - copies * size, pattern + (size,) * copies, whole)
                n -= whole * copies
                if times > whole:
                    put(room, pattern, times - whole)
            else:
                put(room - n * size, pattern + (size,) * n, 1)
                if times > 1:
                    put(room, pattern, times - 1)
                n = 0
    return fillings + [(p, n) for group in alike.values() for p, n in group if p]


def packed(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places: doc_id, part (0 for a whole document, else 1, 2, ... of a cut one), tokens, container."""
    spark = sizes.sparkSession
    sizes = pinned(sizes, "sizes")
    kind = dict(sizes.dtypes)["doc_id"]
    whole = F.col("tokens") <= capacity
    cut = F.when(
        whole, F.array(F.struct(F.lit(0).alias("part"), F.col("tokens").alias("tokens")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.ceil(F.col("tokens") / capacity).cast("int")),
            lambda i: F.struct(
                i.alias("part"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - (i - 1) * capacity).alias("tokens")
            ),
        )
    )
    parts = sizes.select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.part", "p.tokens")
    splits = min(max(sizes.count() // SPLIT, 16), SPLITS)
    parts = parts.withColumn("split", F.pmod(F.xxhash64("doc_id", "part"), F.lit(splits)).cast("int"))
    counts = pinned(parts.groupBy("tokens", "split").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    # at most capacity + 1 rows
    histogram = {r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    fillings = plan(histogram, capacity)
    # for each size, runs of ranks: (first rank, first container, copies of the size per container)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    container = 1
    for pattern, times in fillings:
        for s in sorted(set(pattern)):
            copies = pattern.count(s)
            runs.setdefault(s, []).append((ranks.get(s, 0), container, copies))
            ranks[s] = ranks.get(s, 0) + copies * times
        container += times
    table = spark.sparkContext.broadcast({s: np.array(r, np.int64) for s, r in runs.items()})
    # of each (size, split) the number of documents in earlier splits; the table has at most (capacity + 1) * SPLITS rows
    before = Window.partitionBy("tokens").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("tokens", "split").orderBy("doc_id", "part")
    ranked = parts.withColumn("rank", F.row_number().over(inner) - 1).join(F.broadcast(offsets), ["tokens", "split"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rank = batch.column("tokens").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(tokens), np.int64)
            for s in np.unique(tokens):
                if s and s in table.value:
                    here, r = tokens == s, table.value[s]
                    i = np.searchsorted(r[:, 0], rank[here], side="right") - 1
                    at[here] = r[i, 1] + (rank[here] - r[i, 0]) // r[i, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("tokens"), pa.array(at)],
                ["doc_id", "part", "tokens", "container"],
            )

    rows = ranked.select("doc_id", "part", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))
    return rows.mapInArrow(place, f"doc_id {kind}, part int, tokens long, container long")
