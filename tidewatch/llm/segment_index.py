"""Near-duplicates of new batches in all that was accepted before, by a segment index for edit distance.

A text of n words is cut into at least ``EDITS`` * n + 1 segments: as long as at most ``EDITS`` of its words are edited,
one of any ``EDITS`` * n + 1 segments at least is intact and stands, at some place, in the edited text. Segments have
``PIECE`` words where so many are enough, else equal lengths. The index holds the hash of each chosen segment (its words
and so its length) with the text's length and a bitmap of its words; a batch is probed with
those of its substrings that have a segment's length for some text of similar length. Positions aren't compared, because
sentences move within reposts. Of what meets, lengths and bitmaps are compared at once: a bit that only one text has is
a word the other lacks, so what has too many of them can't be the same post, and no pair is lost there. The texts of the
remaining pairs are verified word by word, the most promising of an arrival first, and no other if that one is the same.
The index is a set of tables that is opened, probed and appended to batch by batch; nothing of the history is read again.

Segments that very many texts share (standing introductions) prove little. A text is indexed under its ``EDITS`` * n + 1
rarest segments, so the commonest are used only where a text hasn't enough others; those are used in full, and the
texts of a segment that very many are indexed under are spread over salted keys, each of which the batch probes. So no
pair is lost by how often a segment occurs. Equal texts are one class throughout.

Defined results: null, blank and ``nan`` ids are no ids; a null content hash is computed; null and blank texts have no
segments and near-duplicate nothing; repeated arrivals are rejected but for the smallest arrival_id; ties don't arise,
as arrival_id is unique; an empty history or batch gives what the other alone implies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import content_hash
from tidewatch.llm.lookalikes import plain
from tidewatch.storage import pinned, scratch

EDITS, KEPT, PIECE, HOT = 0.25, 0.75, 3, 50
#: Texts of a segment under one key.
SALTED = 5_000
#: Keys of a batch that may be broadcast, about a hundred bytes each.
PROBES = 500_000
#: The list of hot segments is broadcast; the least count that is hot rises so that the list never exceeds this.
HOT_LIST = 2_000_000
#: 64-bit parts of a text's bitmap.
BITMAP = ("b0", "b1", "b2", "b3")

_WORD = re.compile(r"[a-z0-9]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(plain(text).lower())


class _Numbers(dict):
    """64-bit numbers of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = 0xCBF29CE484222325
        for b in word.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        self[word] = h = h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return h


_numbers = _Numbers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def needed(n: int) -> int:
    """How many segments can't all be hit by the edits of a text of n words."""
    return int(EDITS * n) + 1


def segment_bounds(n: int) -> np.ndarray:
    """Where the segments of a text of n words begin, and the last one's end."""
    m = needed(n)
    return np.arange(n // PIECE + 1) * PIECE if n // PIECE >= m else np.arange(m + 1) * n // m


def _spans(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each span of ``length`` words."""
    out = np.full(len(h) - length + 1, length, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x5851F42D4C957F2D) + h[k : len(h) - length + 1 + k]
    return _mixed(out)


def segments(h: np.ndarray) -> np.ndarray:
    """One hash for each segment; a repeated one comes out as often as it stands there."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    at = segment_bounds(n)
    sizes = np.diff(at)
    out = np.zeros(len(sizes), np.uint64)
    for size in np.unique(sizes):
        here = sizes == size
        out[here] = _spans(h, int(size))[at[:-1][here]]
    return out


def probe_lengths(n: int) -> list[int]:
    """Segment lengths of all texts a text of n words may be an edit of."""
    found: set[int] = set()
    for other in {*range(max(1, int(n * KEPT)), min(int(n / KEPT) + 2, 400)), int(n * KEPT), int(n / KEPT) + 1} - {0}:
        found |= set(np.diff(segment_bounds(other)).tolist())
    return sorted(x for x in found if 0 < x <= n)


def probes(h: np.ndarray, lengths: dict[int, list[int]] = {}) -> np.ndarray:  # noqa: B006 - remembered on purpose
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    if n not in lengths:
        lengths[n] = probe_lengths(n)
    return np.unique(np.concatenate([_spans(h, size) for size in lengths[n]]))


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit for each word and which time it stands in the text."""
    bits = np.zeros(64 * len(BITMAP), np.uint8)
    if len(h):
        own = np.sort(h)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        bits[(_mixed(own + nth.astype(np.uint64) * _MIX) % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def signatures(texts: DataFrame, with_probes: bool) -> DataFrame:
    """Of (cid, text, ord): cid, ord, words, bitmap, segments and, for a batch, probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n, bits, seg, prb = [], [], [], []
                for text in batch.column("text").to_pylist():
                    h = np.array([_numbers[w] for w in words_of(text)], np.uint64)
                    n.append(len(h))
                    bits.append(bitmap(h))
                    seg.append(segments(h).view(np.int64))
                    if with_probes:
                        prb.append(probes(h).view(np.int64))
                parts = np.array(bits, np.int64).reshape(-1, len(BITMAP))
                columns = [batch.column("cid"), batch.column("ord"), pa.array(n, pa.int32()), *map(pa.array, parts.T.copy()), pa.array(seg, pa.list_(pa.int64()))]
                names = ["cid", "ord", "n", *BITMAP, "segs"]
                if with_probes:
                    columns.append(pa.array(prb, pa.list_(pa.int64())))
                    names.append("probes")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = "cid long, ord long, n int, b0 long, b1 long, b2 long, b3 long, segs array<long>" + ", probes array<long>" * with_probes
    return texts.where("trim(text) <> ''").select("cid", "ord", "text").mapInArrow(run, kind)


def may_be_same() -> Column:
    """Whether lengths and bitmaps of a and b allow ``KEPT`` of the longer text's words in both; false only where they
    can't be."""
    most = F.greatest("a.n", "b.n")

    def lacking(x: str, y: str) -> Column:
        bits = [F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{c}")))) for c in BITMAP]
        return sum(bits[1:], bits[0]) <= F.col(f"{x}.n") - KEPT * most

    return (F.least("a.n", "b.n") >= KEPT * most) & lacking("a", "b") & lacking("b", "a")


class SegmentIndex:
    """The index as tables below ``home``, one part for the history and one for each appended batch; ``ord`` is -1 for the
    history and the first arrival_id for appended rows.

    ``ids`` and ``hashes``: v, ord. ``texts``: cid, ord, text, one row per distinct text of a part. ``segments``: key, cid,
    ord, n, bitmap, a row for each chosen segment. ``hot``: the segments of many texts as the history had them; they
    decide which segments of a text are chosen and how keys are salted, for appended texts and probes too."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home
        found = spark.read.parquet(f"{home}/hot").toPandas().sort_values("seg")
        self.hot = spark.sparkContext.broadcast((found["seg"].to_numpy(np.int64), found["count"].to_numpy(np.int64)))

    @classmethod
    def create(cls, spark: SparkSession, history: DataFrame, home: str | None = None) -> SegmentIndex:
        """The index of accepted posts (mention_id, title_clean, text_clean, content_hash). Nothing later reads them again."""
        home = home or scratch(spark, "segment-index")
        rows = posts_of(history).withColumn("ord", F.lit(-1).cast("long"))
        signed = pinned(signatures(distinct_texts(rows), False), "signatures")
        _hot_segments(signed).write.mode("overwrite").parquet(f"{home}/hot")
        index = cls(spark, home)
        index._write(F.lit("history"), rows, signed)
        return index

    def append(self, parts: dict[str, Column], rows: DataFrame, signed: DataFrame) -> None:
        """Adds batches: rows of ``posts_of`` with ``ord``, and their signatures. ``parts``: name and condition on ``ord`` of each
        batch. A part of a name that is there is replaced."""
        name = F.lit(None).cast("string")
        for part, condition in parts.items():
            name = F.when(condition, F.lit(part)).otherwise(name)
        self._write(name, rows, signed)

    def _write(self, part: Column, rows: DataFrame, signed: DataFrame) -> None:
        def put(df: DataFrame, table: str) -> None:
            out = df.withColumn("part", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.option("compression", "zstd").partitionBy("part").parquet(f"{self.home}/{table}")

        def first(condition: str, value: str) -> DataFrame:
            return rows.where(condition).groupBy(part.alias("p"), F.col(value).alias("v")).agg(F.min("ord").alias("ord")).drop("p")

        put(first("trim(mention_id) <> '' and lower(trim(mention_id)) <> 'nan'", "mention_id"), "ids")
        put(first("content_hash is not null", "content_hash"), "hashes")
        put(distinct_texts(rows), "texts")
        put(self.keyed(signed, "segs", True), "segments")

    def part(self, table: str) -> DataFrame:
        kinds = {"ids": "v string, ord long", "hashes": "v string, ord long", "texts": "cid long, text string, ord long", "segments": KEYED}
        return self.spark.read.schema(kinds[table]).parquet(f"{self.home}/{table}/*")

    def keyed(self, df: DataFrame, column: str, chosen: bool) -> DataFrame:
        """A row for each key of a text; ``chosen``: of the index, under the rarest segments."""
        shared = self.hot

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, counts = shared.value
            for batch in batches:
                lists = batch.column(column)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(sizes)), sizes)
                count = np.zeros(len(flat), np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    count = np.where(known[i] == flat, counts[i], 0)
                salts = 1 + count // SALTED
                if chosen:
                    order = np.lexsort((count, row))
                    rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    most = np.array([needed(n) for n in batch.column("n").to_pylist()], np.int64)
                    taken = order[rank < most[row]]
                    row, flat = row[taken], flat[taken]
                    salt = batch.column("cid").to_numpy()[row] % salts[taken]
                else:
                    row, flat = np.repeat(row, salts), np.repeat(flat, salts)
                    salt = np.arange(len(flat)) - np.repeat(np.cumsum(salts) - salts, salts)
                # without a salt the key is the segment itself
                key = flat ^ _mixed(salt.astype(np.uint64)).view(np.int64)
                at = pa.array(row, pa.int64())
                names = ["cid", "ord", "n", *BITMAP]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c).take(at) for c in names)], ["key", *names])

        return df.select("cid", "ord", "n", *BITMAP, column).mapInArrow(run, KEYED)

    def candidates(self, signed: DataFrame) -> DataFrame:
        """Pairs (a, b) with the segments they share: class of the batch and earlier indexed class that may be near, before
        texts are compared. A batch of few keys is sent to the index, which is then read once and not moved."""
        keys = self.keyed(signed, "probes", False)
        few = (signed.agg(F.sum(F.size("probes"))).first()[0] or 0) <= PROBES
        a, b = (F.broadcast(keys) if few else keys).alias("a"), self.part("segments").alias("b")
        met = b.join(a, (F.col("a.key") == F.col("b.key")) & (F.col("b.ord") < F.col("a.ord")) & (F.col("a.cid") != F.col("b.cid")) & may_be_same())
        return met.groupBy(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).agg(F.count(F.lit(1)).alias("shared"))

    def texts_of(self, cids: DataFrame) -> DataFrame:
        """Texts of some classes, one row each."""
        found = self.part("texts").join(cids, "cid", "left_semi")
        return found.groupBy("cid").agg(F.min("text").alias("text"))

    def near(self, signed: DataFrame, own: DataFrame) -> DataFrame:
        """Classes (a) of a batch that an earlier class is the same post as; ``own``: cid, text of the batch. One earlier
        class is enough, so the one with most common segments is compared first, and the others only where that fails."""
        pairs = pinned(self.candidates(signed), "segment-pairs")
        best = pinned(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")), "best-pairs")
        first = pinned(verified(best, own, self.texts_of(best.select(F.col("b").alias("cid")).distinct())).select("a"), "near-first")
        rest = pairs.join(first, "a", "left_anti").join(best, ["a", "b"], "left_anti")
        rest = pinned(rest.select("a", "b"), "other-pairs")
        later = verified(rest, own, self.texts_of(rest.select(F.col("b").alias("cid")).distinct())).select("a")
        return first.unionByName(later.distinct())


KEYED = "key long, cid long, ord long, n int, b0 long, b1 long, b2 long, b3 long"


def small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def posts_of(posts: DataFrame) -> DataFrame:
    """mention_id, content_hash (computed where it is missing), text, cid, and what else ``posts`` has of arrival_id, batch_no
    and ord."""
    kept = [c for c in ("arrival_id", "batch_no", "ord") if c in posts.columns]
    rows = posts.select(*kept, "mention_id", "title_clean", F.col("text_clean").alias("text"), "content_hash", F.xxhash64("text_clean").alias("cid"))
    blank = F.trim(F.coalesce("content_hash", F.lit(""))) == ""
    missing = rows.where(blank).withColumn("content_hash", content_hash(F.col("title_clean"), F.col("text")))
    return rows.where(~blank).unionByName(missing).drop("title_clean")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """cid, text, ord: one row per text that isn't blank, with its least ``ord``."""
    return rows.where(F.trim("text") != "").groupBy("cid").agg(F.min("text").alias("text"), F.min("ord").alias("ord"))


def _hot_segments(signed: DataFrame) -> DataFrame:
    """seg, count: the segments of more than ``HOT`` texts, at most ``HOT_LIST`` of them."""
    counts = signed.select(F.explode("segs").alias("seg")).groupBy("seg").count().where(F.col("count") > HOT)
    counts = pinned(counts, "hot-segments")
    total = counts.count()
    if total > HOT_LIST:
        least = counts.approxQuantile("count", [1 - HOT_LIST / total / 2], 0.01)[0]
        counts = counts.where(F.col("count") > least)
    return counts


def distance(a: list[str], b: list[str], most: int) -> int:
    """Word edits between two texts, ``most + 1`` if more; a band around the diagonal is enough."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            d = last.get(j, most) + 1
            if j:
                d = min(d, row.get(j - 1, most) + 1, last.get(j - 1, most) + (x != b[j - 1]))
            row[j] = min(d, most + 1)
        last = row
    return last.get(len(b), most + 1)


@lru_cache(20_000)
def _counted(text: str) -> tuple[list[str], frozenset[tuple[str, int]]]:
    """The words of a text, and each with which time it stands there."""
    words, times, counted = words_of(text), Counter(), []
    for w in words:
        counted.append((w, times[w]))
        times[w] += 1
    return words, frozenset(counted)


def same_texts(a: str, b: str) -> bool:
    (x, counted_x), (y, counted_y) = _counted(a), _counted(b)
    return len(counted_x & counted_y) >= KEPT * max(len(x), len(y)) and same_post(x, y)


def same_post(a: list[str], b: list[str], kept: float = KEPT) -> bool:
    """Whether at least ``kept`` of the words of the longer text are kept: in word pairs both have (so that moved
    sentences count), or by edit distance."""
    n = max(len(a), len(b))
    if not n or sum((Counter(a) & Counter(b)).values()) < kept * n:
        return False
    left = Counter(zip(b, b[1:], strict=False))
    covered = [False] * len(a)
    for i, pair in enumerate(zip(a, a[1:], strict=False)):
        if left[pair] > 0:
            left[pair] -= 1
            covered[i] = covered[i + 1] = True
    return sum(covered) >= kept * n or distance(a, b, int((1 - kept) * n)) <= (1 - kept) * n


def verified(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame) -> DataFrame:
    """The pairs whose texts are the same post. ``texts_*``: cid, text, one row per cid or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                same_texts(x, y) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    a = texts_a.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    b = texts_b.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def usable_id(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "") & (F.lower(F.trim(c)) != "nan")


def batches_of(rows: DataFrame) -> dict[str, Column]:
    """Name and condition on ``ord`` of each batch in order of arrival; batches whose arrival_ids overlap are taken as one."""
    spans = rows.groupBy("batch_no").agg(F.min("arrival_id").alias("low"), F.max("arrival_id").alias("high")).orderBy("low").collect()
    merged: list[list[int]] = []
    for r in spans:
        if merged and r["low"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], r["high"])
        else:
            merged.append([r["low"], r["high"]])
    return {f"batch{low}": F.col("ord").between(low, high) for low, high in merged}


def rejected(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """arrival_id and reason (``id``, ``hash`` or ``text``) of the arrivals that repeat the history or a smaller arrival. The
    history is indexed once and each batch is added to the index as a part of its own. As an entry of the index counts for later
    arrivals only, batches that are all there already are looked up together, which gives what one after the other would."""
    index = SegmentIndex.create(history.sparkSession, history)
    rows, signed = prepared(arrivals)
    if parts := batches_of(rows):
        index.append(parts, rows, signed)
    return looked_up(index, rows, signed)


def admitted(index: SegmentIndex, name: str, arrivals: DataFrame) -> DataFrame:
    """Adds a batch to the index and gives the arrivals of it to reject, with the reason."""
    rows, signed = prepared(arrivals)
    index.append({name: F.lit(True)}, rows, signed)
    return looked_up(index, rows, signed)


def prepared(arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``posts_of`` with ``ord``, and signatures of their distinct texts with probes."""
    rows = pinned(posts_of(arrivals.withColumn("ord", F.col("arrival_id"))), "arrivals")
    return rows, pinned(signatures(distinct_texts(rows), True), "batch-signatures")


def looked_up(index: SegmentIndex, rows: DataFrame, signed: DataFrame) -> DataFrame:
    """The arrivals to reject, of rows that were added to the index."""

    def known(column: str, part: str, key: str) -> DataFrame:
        """Arrivals whose value an earlier row of the index has."""
        ours = rows.select(F.col(column).alias(key), "arrival_id").where(f"{key} is not null")
        first = index.part(part).join(ours.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min("ord").alias("first"))
        return ours.join(first, key).where("first < arrival_id").select("arrival_id")

    by_id = known("mention_id", "ids", "v").withColumn("reason", F.lit("id"))
    by_hash = known("content_hash", "hashes", "v").withColumn("reason", F.lit("hash"))
    by_text = known("cid", "texts", "cid").withColumn("reason", F.lit("text"))
    plainly = pinned(by_id.unionByName(by_hash).unionByName(by_text).groupBy("arrival_id").agg(F.min("reason").alias("reason")), "known")
    # what is left has one arrival for each text, the one that ``ord`` names
    left = pinned(signed.join(plainly.select(F.col("arrival_id").alias("ord")), "ord", "left_anti"), "unknown")
    near = index.near(left, distinct_texts(rows).select("cid", "text"))
    later = rows.select("cid", "arrival_id").join(near.withColumnRenamed("a", "cid"), "cid").join(plainly.select("arrival_id"), "arrival_id", "left_anti")
    return pinned(plainly.unionByName(later.select("arrival_id", F.lit("text").alias("reason"))), "rejected")
