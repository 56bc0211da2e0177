"""Mapping free-entered values to the closest entry of a reference list, or to none.

Values are deduplicated and normalised, looked up in an inverted index of character n-grams of the list's names, and
scored by cosine with weights of inverse document frequency. A value takes the best entry if its score reaches a
threshold and leads the best other entry by a margin; very short values must equal a name. What the cosine accepts is
then checked exactly: within the bounds of an edit distance over the distinguishing part of the name.

The list is split into blocks of at most ``BLOCK`` names; one block at a time is an index small enough to broadcast,
all values are scored against it, and the two best entries of all blocks are kept, so the list may be of any size.

Defined results: null and blank values are left out; null, blank and repeated names are no names; a name that several
entries share maps to none of them; equal scores of two entries are a tie and map to none; an empty list maps nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.lookalikes import plain
from tidewatch.storage import pinned

BLOCK = 20_000
#: Every name with a common n-gram that may be among the two best is scored by the mean of cosine and edit similarity,
#: in which ``FAR`` and more edits count alike.
FAR, THRESHOLD, MARGIN, SHORT, LONG = 5, 0.45, 0.05, 4, 9
#: Names weighed before the others are bounded; it decides nothing but the time.
FIRST = 4

# What people add around a name without meaning another one.
AROUND = (
    "the", "by", "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "official", "store", "shop", "brand",
    "stuff", "new", "from", "products",
)
_AROUND = frozenset(AROUND)


def words_of(value: str) -> list[str]:
    """Lower-case ASCII words of a value, without bracketed remarks, marks, possessives and what stands around names."""
    text = re.sub("[‘’`´]", "'", plain(re.sub("[®™©]", " ", value)))
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    text = re.sub(r"'s?(?![a-z0-9])", " ", text)
    words = re.findall(r"[a-z0-9]+(?:'[a-z0-9]+)*", text)
    kept = [w for w in words if w not in _AROUND]
    return kept or words


def grams(words: list[str]) -> list[str]:
    """Distinct character bi- and trigrams of each word with its edges, and of the words run together."""
    out: dict[str, None] = {}
    for w in [*words, "".join(words)] if len(words) > 1 else words:
        edged = f"^{w}$"
        for n in (2, 3):
            for i in range(len(edged) - n + 1):
                out[edged[i : i + n]] = None
    return list(out)


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours being one; ``most + 1`` if more. A column of the table of distances
    is kept as the bits of two whole numbers (where it rises and where it falls)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, kept, before, found = every, 0, 0, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        swapped = ((~kept & here) << 1) & before
        kept = ((((here & rises) + rises) ^ rises) | here | falls | swapped) & every
        up, down = falls | (every & ~(kept | rises)), kept & rises
        if up & last:
            found += 1
        elif down & last:
            found -= 1
        up, down = (up << 1 | 1) & every, down << 1 & every
        rises, falls, before = down | (every & ~(kept | up)), up & kept, here
    return min(found, most + 1)


def names_of(registry: DataFrame) -> DataFrame:
    """(name, entry) of a registry with brand_norm, brand_display and aliases. Where the last word of a name is one
    that a two-hundredth of all entries end in, the rest of the name stands for the entry too, if it stands for no other."""
    spellings = F.array_union(
        F.array("brand_norm", "brand_display"), F.coalesce("aliases", F.array().cast("array<string>"))
    )
    rows = registry.where("trim(brand_norm) <> ''").select(
        F.col("brand_norm").alias("entry"), F.explode(spellings).alias("name")
    )
    names = rows.where("trim(name) <> ''").distinct()
    ends = registry.where("trim(brand_norm) like '% %'").select(
        F.col("brand_norm").alias("entry"),
        F.regexp_extract(F.trim("brand_norm"), r"(\S+)$", 1).alias("last"),
        F.regexp_replace(F.trim("brand_norm"), r"\s+\S+$", "").alias("name"),
    ).distinct()
    often = ends.groupBy("last").agg(F.count("entry").alias("n")).where(F.col("n") >= F.greatest(F.lit(5), F.lit(registry.count() / 200)))
    short = ends.join(often, "last").where(F.length("name") >= 5)
    lone = short.groupBy("name").agg(F.min("entry").alias("entry"), F.countDistinct("entry").alias("n")).where("n = 1")
    taken = names.select(F.lower(F.trim("name")).alias("name")).distinct()
    return names.unionByName(lone.drop("n").join(taken, "name", "left_anti"))


def _bag(flat: str) -> np.ndarray:
    """How often each letter stands in a name; letters may share a place."""
    return np.bincount([ord(c) % 64 for c in flat], minlength=64)[:64] if flat else np.zeros(64, np.int64)


class Index:
    """The n-gram index of one block of names."""

    def __init__(self, names: list[str], entries: list[str], weights: dict[str, float], unseen: float):
        self.weights, self.unseen = weights, unseen
        self.words = [words_of(n) for n in names]
        self.flat = ["".join(w) for w in self.words]
        self.length = np.array([len(f) for f in self.flat], np.int64)
        self.bags = np.array([_bag(f) for f in self.flat], np.int32).reshape(-1, 64)
        self.entries = entries
        self.entry_ids = {e: i for i, e in enumerate(dict.fromkeys(entries))}
        self.entry_of = np.array([self.entry_ids[e] for e in entries], np.int64)
        self.entry_names = list(self.entry_ids)
        self.exact: dict[str, set[str]] = defaultdict(set)
        for f, e in zip(self.flat, entries, strict=True):
            self.exact[f].add(e)
        postings: dict[str, list[int]] = defaultdict(list)
        self.norm = np.ones(len(names))
        for i, w in enumerate(self.words):
            own = grams(w)
            self.norm[i] = np.sqrt(sum(self.weight(g) ** 2 for g in own)) or 1.0
            for g in own:
                postings[g].append(i)
        self.postings = {g: np.array(p, np.int64) for g, p in postings.items()}

    def weight(self, gram: str) -> float:
        return self.weights.get(gram, self.unseen)

    def best(self, value: str) -> list[tuple[str, float, str]]:
        """The two best entries as (entry, score, name as letters)."""
        words = words_of(value)
        flat = "".join(words)
        if not flat or not len(self.entries):
            return []
        if same := self.exact.get(flat):
            return [(e, 1.0, flat) for e in sorted(same)[:2]]
        if len(flat) < SHORT:
            return []
        own = grams(words)
        w = np.array([self.weight(g) for g in own])
        lists = [(self.postings[g], x * x) for g, x in zip(own, w, strict=True) if g in self.postings]
        if not lists:
            return []
        at = np.concatenate([p for p, _ in lists])
        score = np.bincount(at, weights=np.repeat([x for _, x in lists], [len(p) for p, _ in lists]), minlength=len(self.norm))
        score /= self.norm * np.sqrt((w * w).sum())
        hits = np.flatnonzero(score > 0)
        longer = np.maximum(self.length[hits], len(flat))
        shapes = arrangements(words)
        out: dict[str, tuple[str, float, str]] = {}
        second, done = 0.0, np.zeros(len(hits), bool)

        def weigh(k: int, least: int) -> None:
            nonlocal second
            i = hits[k]
            e, name = self.entries[i], self.flat[i]
            apart = FAR if least >= FAR else min(distance(a, name, FAR - 1) for a in shapes)
            near = 1 - apart / max(len(name), len(flat))
            found = (e, (float(score[i]) + near) / 2, name)
            done[k] = True
            if e not in out or out[e][1] < found[1]:
                out[e] = found
                second = sorted(o[1] for o in out.values())[-2:][0] if len(out) > 1 else 0.0

        # the names of highest cosine first: they leave few others that can still be among the two best
        first = np.argpartition(-score[hits], FIRST)[:FIRST] if len(hits) > FIRST else np.arange(len(hits))
        for k in first:
            weigh(k, 0)
        apart_by = np.minimum(np.abs(self.length[hits] - len(flat)), FAR)
        rest = np.flatnonzero(~done & ((score[hits] + 1 - apart_by / longer) / 2 >= second - 1e-9))
        # an edit adds and removes one letter at most, so this is the least there can be, and no name is lost by it
        letters = self.bags[hits[rest]] - _bag(flat)
        least = np.minimum(np.maximum(np.maximum(letters, 0).sum(1), np.maximum(-letters, 0).sum(1)), FAR)
        most = (score[hits[rest]] + 1 - least / longer[rest]) / 2
        for j in np.argsort(-most, kind="stable"):
            if len(out) > 1 and most[j] < second - 1e-9:
                break
            weigh(rest[j], int(least[j]))
        return sorted(out.values(), key=lambda o: (-o[1], o[0]))[:2]


def arrangements(words: list[str]) -> set[str]:
    """The words run together, as typed and rotated ("Gear Acme" for "Acme Gear")."""
    return {"".join(words[i:] + words[:i]) for i in range(len(words))} or {""}


def accepted(value: str, name: str, score: float, second: float, threshold: float, margin: float) -> bool:
    """Threshold, margin and the exact check: the value's letters are the name's within one edit, two for names of at
    least ``LONG`` letters; words may be rotated or run together."""
    if score >= 0.999999:
        return second < 0.999999
    if score < threshold or score - second < margin:
        return False
    most = 1 if len(name) < LONG else 2
    return any(distance(a, name, most) <= most for a in arrangements(words_of(value)))


def mapped(values: DataFrame, names: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(value, entry, score) for every distinct non-blank value of the column ``value``; entry null where none is meant."""
    spark = values.sparkSession
    distinct = values.select("value").where("trim(value) <> ''").distinct()
    # looking up is work for Python: spread over all cores, however few bytes the values have
    distinct = pinned(distinct, "values").repartition(2 * spark.sparkContext.defaultParallelism)
    names = names.withColumn("block", F.lit(0))
    count = names.count()
    blocks = max(1, -(-count // BLOCK))
    names = names.withColumn("block", F.pmod(F.xxhash64("entry"), F.lit(blocks)).cast("int"))

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                seen.update(grams(words_of(name)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

    # n-grams of 37 letters and two edges: at most about 60,000 rows
    df = names.select("name").mapInArrow(gram_rows, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    weights = {r["gram"]: float(np.log((count + 1) / (r["n"] + 0.5))) for r in df.toLocalIterator()}
    unseen = float(np.log((count + 1) / 0.5))
    found = None
    for block in range(blocks):
        rows = names.where(F.col("block") == block).orderBy("entry", "name").collect()
        shared = spark.sparkContext.broadcast(([r["name"] for r in rows], [r["entry"] for r in rows], weights, unseen))

        def lookup(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                out = [(v, *b) for v in batch.column(0).to_pylist() for b in index.best(v)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.string()))],
                    ["value", "entry", "score", "name"],
                )

        part = distinct.mapInArrow(lookup, "value string, entry string, score double, name string")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("value").orderBy(F.desc("score"), "entry")
    two = (
        found.withColumn("r", F.row_number().over(order))
        .where("r <= 2")
        .groupBy("value")
        .agg(
            F.max(F.when(F.col("r") == 1, F.struct("entry", "score", "name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
        )
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, entry, score, name, second = (c.to_pylist() for c in batch.columns)
            ok = [accepted(v, n, s, t, threshold, margin) for v, n, s, t in zip(value, name, score, second, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e if k else None for e, k in zip(entry, ok, strict=True)], pa.string()), batch.column(2)],
                ["value", "entry", "score"],
            )

    return two.select("value", "a.entry", "a.score", "a.name", "second").mapInArrow(
        decide, "value string, entry string, score double"
    )
