"""Test items whose text stands, wholly or partly, in documents.

Containment search with MinHash, partitioned by size. Items fall into partitions by the length of the run a leak must
hold at least (a quarter of the passage, twelve words or more); in each partition items are cut into overlapping pieces of
that length, and documents into overlapping blocks to match, so that what is compared is of like size however long the
document. Longer runs mean larger blocks, whose minima are those of the smaller blocks they consist of. Each partition
has bands as wide as the containment threshold allows for its sizes.

Band keys of items are a table. A filter of their bits, of bounded size whatever the number of items, goes to the
documents: a block that meets too few keys is dropped where it is made, the keys of the others meet the table in an
equi-join; a suite of few keys is sent along with the filter. What collides in enough places is verified exactly: the word pairs that item and document share are joined
into runs, and an item counts as leaked if one or two runs hold half of its words.

Shingles have three words, not five: a run of twelve words with one word replaced keeps at most three of its eight
shingles of five words, but seven of its ten of three.

Defined results: case, punctuation, layout and look-alike characters don't matter; the standing instruction of a suite
(a first sentence that several of its items share) is no part of a passage; null and blank texts contain nothing; items
without words leak nowhere; repeated documents each have their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.lookalikes import plain
from tidewatch.llm.segment_index import _mixed, _Numbers, _spans, small
from tidewatch.storage import pinned, spread

SHINGLE = 3
SIGNATURE, COLLISIONS, CONTAINMENT, FOUND = 32, 4, 0.6, 0.97
RUN, PART, INTACT, GAP = 12, 0.5, 0.85, 2
#: Words of a piece in each partition. A passage is in the last one whose pieces aren't longer than the run it must show.
RUNS = (RUN, 2 * RUN, 4 * RUN)
#: Bits of the filter for each key of the items, and at most in all (64 MB).
BITS_PER_KEY, MOST_BITS = 16, 29
#: Collisions that all pieces of a passage must have together, for each of its words. Half a passage in runs, with one word
#: in ten replaced, has about 0.6 at least.
LEAST = 0.25
#: Rows of items' keys, and of candidates, that may be broadcast.
SMALL = 500_000

_WORD = re.compile(r"[^\W_]+")
_numbers = _Numbers()
_SALTS = _mixed(np.arange(101, 101 + SIGNATURE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(plain(text).lower()) if text else []


def numbered(words: list[str]) -> np.ndarray:
    return np.array([_numbers[w] for w in words], np.uint64)


def band_width(piece: int, block: int) -> int:
    """Places of a signature that must agree at once: the most with which a piece of so many shingles, contained to the
    threshold in a block of ``block`` shingles, is still found with ``FOUND``."""
    same = CONTAINMENT / (max(block, piece) / piece + 1 - CONTAINMENT)
    for width in (4, 2):
        if 1 - (1 - same**width) ** (SIGNATURE // width) >= FOUND:
            return width
    return 1


def level_of(n: int) -> int:
    """The partition of a passage of n words: of two runs that hold half of it, one has a quarter of its words."""
    return sum(run <= max(RUN, PART * n / 2) for run in RUNS) - 1


def width_of(level: int) -> int:
    return band_width(RUNS[level] - SHINGLE + 1, 2 * RUNS[level])


def collisions_of(level: int) -> int:
    return max(1, COLLISIONS // width_of(level))


def banded(signatures: np.ndarray, width: int) -> np.ndarray:
    """[place, band] keys of [place, SIGNATURE] minima."""
    if width == 1:
        return signatures
    parts = signatures.reshape(len(signatures), SIGNATURE // width, width)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(width):
        out = out * np.uint64(0x5851F42D4C957F2D) + parts[:, :, k]
    return out


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[stretch, SIGNATURE]: least values of each stretch of shingles."""
    out = np.empty((len(starts), SIGNATURE), np.uint64)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat(_mixed(hashes ^ _SALTS[k]), starts)
    return out


def keys_of(signatures: np.ndarray, level: int) -> np.ndarray:
    """[place, band] keys, different for each partition and band."""
    keys = banded(signatures, width_of(level))
    return _mixed(keys ^ _mixed(np.arange(keys.shape[1], dtype=np.uint64) * np.uint64(8) + np.uint64(level + 1)))


def piece_keys(passage: np.ndarray) -> tuple[int, np.ndarray]:
    """Partition and [piece, band] keys of a passage."""
    level = level_of(len(passage))
    if len(passage) < SHINGLE:
        return level, np.zeros((0, 1), np.uint64)
    s, size = _spans(passage, SHINGLE), RUNS[level] - SHINGLE + 1
    last = max(len(s) - size, 0)
    made = [minima(s[at : at + size], np.zeros(1, np.int64))[0] for at in sorted({*range(0, last + 1, RUNS[level] // 2), last})]
    return level, keys_of(np.array(made), level)


def block_keys(hashes: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of documents as arrays of shingles, for each partition: its number, which document each block belongs to, and the
    [block, band] keys. Halves of the smallest blocks have ``RUN`` shingles."""
    counts = np.array([-(-len(h) // RUN) for h in hashes])
    begins = np.cumsum([0, *(len(h) for h in hashes)])[:-1]
    owner = np.repeat(np.arange(len(hashes)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    half = minima(np.concatenate(hashes), begins[owner] + inside * RUN)
    for level, run in enumerate(RUNS):
        if level:
            # two halves of the level before are one of this level
            first = np.flatnonzero(inside % 2 == 0)
            half, owner, inside = np.minimum.reduceat(half, first), owner[first], inside[first] // 2
        end = np.append(owner[1:] != owner[:-1], True)
        block = half.copy()
        block[:-1] = np.where(end[:-1, None], half[:-1], np.minimum(half[:-1], half[1:]))
        yield level, owner, keys_of(block, level)


class Places:
    """Where the word pairs of a document stand."""

    def __init__(self, words: np.ndarray):
        pairs = _spans(words, 2) if len(words) > 1 else np.zeros(0, np.uint64)
        self.at = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.at]

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.pairs, pairs, "left"), np.searchsorted(self.pairs, pairs, "right")


def leaked(passage: np.ndarray, document: Places) -> bool:
    """Exact check of a passage against a document."""
    n = len(passage)
    first, last = document.of(_spans(passage, 2) if n > 1 else np.zeros(0, np.uint64))
    shared = np.flatnonzero(last > first)
    # a replaced word takes two pairs, and at most one word in ten of half the passage is replaced
    if len(shared) < PART * n * (1 - 2 * (1 - INTACT)) - 2:
        return False
    times = (last - first)[shared]
    place = np.repeat(shared, times)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
    offset = document.at[np.repeat(first[shared], times) + inside] - place
    order = np.lexsort((place, offset))
    place, offset = place[order], offset[order]
    new = np.append(True, (offset[1:] != offset[:-1]) | (place[1:] != place[:-1] + 1)) if len(place) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(place)) - 1
    return half_in_runs(list(zip(place[start].tolist(), (place[end] + 2).tolist(), offset[start].tolist(), strict=True)), n)


def half_in_runs(stretches: list[tuple[int, int, int]], n: int) -> bool:
    """Whether one or two runs of at least ``RUN`` words hold ``PART`` of n words. ``stretches``: exact matches
    [start, end) of the passage and how far on they stand in the document. Stretches join into a run where at most
    ``GAP`` words lie between them on either side."""
    stretches.sort()
    best: list[tuple[int, int, int]] = []  # of the run that ends with a stretch: start, words matched, document's end
    runs: list[tuple[int, int]] = []
    for j, (start, end, offset) in enumerate(stretches):
        chosen = (start, end - start)
        for i in range(j - 1, -1, -1):
            s, e, o = stretches[i]
            if start - s > n:
                break
            gap, other = start - e, start + offset - (e + o)
            if -2 <= gap <= GAP and -2 <= other <= GAP and end > e and (gap > 0 or other > 0 or offset != o):
                matched = best[i][1] + (end - start) + min(gap, other, 0)
                length = end - best[i][0]
                if matched > chosen[1] and matched >= INTACT * length:
                    chosen = (best[i][0], matched)
        best.append((*chosen, end))
        if end - chosen[0] >= RUN:
            runs.append((chosen[0], end))
    if not runs:
        return False
    # the longest run that ends at or before each place of the passage; of a run and one before it all pairs are compared
    before = [0] * (n + 1)
    for a, b in set(runs):
        before[b] = max(before[b], b - a)
    for place in range(1, n + 1):
        before[place] = max(before[place], before[place - 1])
    return max(b - a + before[a] for a, b in runs) >= PART * n


_FIRST = re.compile(r"^\s*(.*?[.?!:])(?=\s|$)", re.S)


def passages(items: DataFrame, shared: int = 5) -> DataFrame:
    """item_id and words of the passage: a first sentence that at least ``shared`` items of the suite begin with is its
    standing instruction and is left out. Items without words don't come out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, whole, rest = [], [], []
            for text in batch.column("text").to_pylist():
                m = _FIRST.match(text or "")
                heads.append(" ".join(words_of(m[1])) if m else "")
                whole.append(words_of(text))
                rest.append(words_of(text[m.end() :]) if m else whole[-1])
            lists = [pa.array(x, pa.list_(pa.string())) for x in (whole, rest)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("suite"), pa.array(heads, pa.string()), *lists], ["item_id", "suite", "head", "whole", "rest"])

    kinds = dict(items.dtypes)
    schema = f"item_id {kinds['item_id']}, suite string, head string, whole array<string>, rest array<string>"
    rows = items.select("item_id", F.coalesce(F.col("suite").cast("string"), F.lit("")).alias("suite"), "text").mapInArrow(split, schema)
    standing = rows.groupBy("suite", "head").count().where(F.col("count") >= shared).select("suite", "head", F.lit(True).alias("standing"))
    words = F.when(F.col("standing"), F.col("rest")).otherwise(F.col("whole"))
    out = rows.join(small(standing, SMALL), ["suite", "head"], "left").select("item_id", words.alias("words"))
    return out.where(F.size("words") > 0).distinct()


def item_keys(known: DataFrame) -> DataFrame:
    """key, item_id, piece: the band keys of all pieces of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, keys = [], [], []
            for i, words in enumerate(batch.column("words").to_pylist()):
                _, own = piece_keys(numbered(words))
                keys.append(own.ravel())
                at.append(np.full(own.size, i))
                piece.append(np.repeat(np.arange(len(own)), own.shape[1]))
            none = [np.zeros(0, np.int64)]
            at, piece = np.concatenate(at or none), np.concatenate(piece or none)
            key = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), batch.column("item_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())], ["key", "item_id", "piece"]
            )

    return known.select("item_id", "words").mapInArrow(run, f"key long, item_id {dict(known.dtypes)['item_id']}, piece int")


def filter_bits(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each key, in an array of at most 2 ** ``MOST_BITS`` bits, and the number of a bit's binary digits. It is
    summed in tasks; what comes to the driver are its words that aren't empty."""
    digits = min(max(16, int(keys.count() * BITS_PER_KEY).bit_length()), MOST_BITS)
    mask = (1 << digits) - 1
    words = keys.selectExpr(f"shiftright(key & {mask}, 5) AS w", "shiftleft(1L, int(key & 31)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (digits - 5), np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return out, digits


def met_blocks(arrays: list[np.ndarray], bits: np.ndarray, digits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of documents as numbered words, for each partition: its number, and for the keys of blocks that meet enough of the
    items' keys the document, the block and the key."""
    here = [i for i, a in enumerate(arrays) if len(a) >= RUN]
    if not here:
        return
    mask = np.uint64((1 << digits) - 1)
    for level, owner, own in block_keys([_spans(arrays[i], SHINGLE) for i in here]):
        bit = own & mask
        met = bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)
        block, band = np.nonzero(met * (met.sum(1) >= collisions_of(level))[:, None])
        yield level, np.array(here)[owner[block]], block, own[block, band]


def document_keys(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, level, block, key for the blocks that meet enough of the items' keys."""
    shared = documents.sparkSession.sparkContext.broadcast(filter_bits(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                arrays = [numbered(words_of(t)) for t in batch.column("text").to_pylist()]
                for level, doc, block, key in met_blocks(arrays, *shared.value):
                    columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(np.full(len(doc), level), pa.int32()), pa.array(block, pa.int32()), pa.array(key.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "level", "block", "key"])

    kind = dict(documents.dtypes)["doc_id"]
    return spread(documents.where("trim(text) <> ''").select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, level int, block int, key long")


def candidates(documents: DataFrame, known: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, item_id that collide often enough, by a join of the documents' keys with the table of the items' keys."""
    met = document_keys(documents, keys).join(keys, "key")
    enough = F.lit(collisions_of(0))
    for level in range(1, len(RUNS)):
        enough = F.when(F.col("level") == level, F.lit(collisions_of(level))).otherwise(enough)
    # blocks are numbered within a batch of documents, and a document is in one batch
    often = met.groupBy("doc_id", "level", "block", "item_id", "piece").count().where(F.col("count") >= enough)
    summed = often.groupBy("doc_id", "item_id").agg(F.sum("count").alias("met")).join(known.select("item_id", F.size("words").alias("n")), "item_id")
    return summed.where(F.col("met") >= F.col("n") * LEAST).select("doc_id", "item_id")


@dataclass
class Suite:
    """Passages few enough to be sent to every task, with their keys."""

    items: list
    passages: list[np.ndarray]

    def __post_init__(self) -> None:
        made = [piece_keys(p)[1] for p in self.passages]
        pieces = [len(k) for k in made]
        self.sizes = np.array([len(p) for p in self.passages], np.int64)
        self.owner = np.repeat(np.arange(len(made)), pieces)
        none = [np.zeros(0, np.uint64)]
        keys = np.concatenate([k.ravel() for k in made] or none)
        piece = np.repeat(np.arange(len(self.owner)), np.concatenate([np.full(len(k), k.shape[1]) for k in made] or [np.zeros(0, np.int64)]).astype(np.int64))
        order = np.argsort(keys, kind="stable")
        self.keys, self.piece = keys[order], piece[order]
        self.digits = min(max(16, int(len(keys) * BITS_PER_KEY).bit_length()), MOST_BITS)
        self.bits = np.zeros(1 << (self.digits - 5), np.uint32)
        bit = keys & np.uint64((1 << self.digits) - 1)
        np.bitwise_or.at(self.bits, (bit >> np.uint64(5)).astype(np.int64), np.uint32(1) << (bit & np.uint64(31)).astype(np.uint32))

    def candidates(self, arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which document and which item collide often enough."""
        pairs, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level, doc, block, key in met_blocks(arrays, self.bits, self.digits):
            first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            n = last - first
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            piece = self.piece[np.repeat(first, n) + inside]
            both, count = np.unique(np.repeat(block, n) * len(self.owner) + piece, return_counts=True)
            often = count >= collisions_of(level)
            of_block = np.zeros(block.max(initial=0) + 1, np.int64)
            of_block[block] = doc
            both = both[often]
            pairs.append(of_block[both // len(self.owner)] * len(self.items) + self.owner[both % len(self.owner)])
            times.append(count[often])
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
        met = np.bincount(at, weights=np.concatenate(times), minlength=len(pair))
        pair = pair[met >= self.sizes[pair % max(len(self.items), 1)] * LEAST] if len(pair) else pair
        return pair // max(len(self.items), 1), pair % max(len(self.items), 1)

    def found(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Which text holds which item."""
        arrays = [numbered(words_of(t)) for t in texts]
        docs, items, last, places = [], [], -1, None
        for d, i in zip(*(x.tolist() for x in self.candidates(arrays)), strict=True):
            if d != last:
                last, places = d, Places(arrays[d])
            if leaked(self.passages[i], places):
                docs.append(d)
                items.append(i)
        return docs, items


def found_in(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for documents (doc_id, text) and items (item_id, suite, text). Suites of up to ``SMALL`` keys go to
    the documents whole; larger ones meet them as tables, with the same result."""
    kinds = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    known = pinned(passages(items), "passages")
    keys = pinned(item_keys(known), "item-keys")
    if keys.count() > SMALL:
        return _found_by_tables(documents, known, keys, schema)
    rows = known.collect()
    suite = documents.sparkSession.sparkContext.broadcast(Suite([r["item_id"] for r in rows], [numbered(r["words"]) for r in rows]))
    item_type = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = suite.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                doc, item = own.found(batch.column("text").to_pylist())
                found = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array([own.items[i] for i in item], item_type)]
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "item_id"])

    return spread(documents.where("trim(text) <> ''").select("doc_id", "text")).mapInArrow(search, schema).distinct()


def _found_by_tables(documents: DataFrame, known: DataFrame, keys: DataFrame, schema: str) -> DataFrame:
    pairs = pinned(candidates(documents, known, keys), "leak-candidates")
    texts = documents.select("doc_id", "text").join(small(pairs, SMALL), "doc_id").join(small(known, SMALL // 100), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, places = None, None
        for batch in batches:
            ok = []
            for text, words in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if text != last:
                    last, places = text, Places(numbered(words_of(text)))
                ok.append(leaked(numbered(words), places))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["doc_id", "item_id"])

    return texts.select("doc_id", "item_id", "text", "words").mapInArrow(verify, schema).distinct()
