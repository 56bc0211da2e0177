"""Subject areas of documents by language models.

For each subject an interpolated bigram model over hashed words, and a background model of all documents, whose counts
are summed over the whole table by bincount per split. Subject counts come from labelled documents (at most
``LABELLED`` of them, those with the smallest hash of their id): a document's labels say which subjects it holds but
not where, so its sentences are shared out among its labels and the background by their cross-entropy, again and
again. A sentence of any document goes to the subject whose cross-entropy is lowest if it lies below that of the background
model and a margin below that of all other subjects' models together, weighted by what the document's other sentences
are about; a document has every subject that fills a calibrated share of its words, possibly several or
none. Margin and share are calibrated on labelled documents by models of the other half of them.

Defined results: null and blank texts have no subject; words never seen with a subject are as likely under all models;
repeated documents give repeated, labels repeated count once; without labels there are no subjects; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.lookalikes import plain
from tidewatch.llm.samples import bounded_sample
from tidewatch.storage import spread

WORDS, PAIRS, LABELLED = 1 << 16, 1 << 17, 10_000
#: What is added to a seen and an expected count, and how often sentences are shared out anew, in fitting and in use.
PRIOR, ROUNDS, FOLDS = 0.3, 8, 4
SHARE, MARGIN, ABOVE = 0.18, 4.0, 0.5

_WORD = re.compile(r"[^\W_]+", re.UNICODE)
_END = re.compile(r"[.!?…\n\r;]+")
_DIGIT = re.compile(r"\d+")


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = b = zlib.crc32(_DIGIT.sub("0", word).encode()) & (WORDS - 1)
        return b


_buckets = _Buckets()


@dataclass
class Tokens:
    """Documents as flat arrays: word and pair buckets, the sentence of each token, the document of each sentence."""

    word: np.ndarray
    pair: np.ndarray
    starts: np.ndarray
    document: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.word)))


def tokens(texts: list[str | None]) -> Tokens:
    flat: list[int] = []
    starts, document = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        for sentence in _END.split(plain(text).lower()):
            own = _WORD.findall(sentence)
            if own:
                starts.append(len(flat))
                document.append(i)
                flat += [_buckets[w] for w in own]
    word = np.array(flat, np.int64)
    at = np.array(starts, np.int64)
    before = np.empty_like(word)
    if len(word):
        before[1:] = word[:-1]
        before[at] = WORDS
    pair = (before * 0x9E3779B1 + word * 0x85EBCA77 >> 7) & (PAIRS - 1)
    return Tokens(word, pair, at, np.array(document, np.int64))


@dataclass
class Models:
    """A subject's model as its ratio to the background: P(word | subject) = background(word) * single[word, subject],
    and likewise ``double`` for a word after another; ``trust`` is the interpolation weight of the pair's own estimate."""

    subjects: list[str]
    single: np.ndarray
    double: np.ndarray
    trust: np.ndarray
    margin: float = MARGIN
    share: float = SHARE
    #: How far, in nats, a sentence's cross-entropy lies below that of the background model at least.
    above: float = ABOVE

    def gains(self, t: Tokens) -> np.ndarray:
        """[sentence, subject]: how much lower the subject's cross-entropy of the sentence is than the background's, in
        nats per token times the tokens."""
        if not len(t.word):
            return np.zeros((0, len(self.subjects)))
        out = np.empty((len(t.starts), len(self.subjects)), np.float32)
        ends = np.append(t.starts, len(t.word))
        # some sentences at a time: a row of all subjects for every token of the corpus would fill the memory
        for at in range(0, len(t.starts), 5000):
            low, high = ends[at], ends[min(at + 5000, len(t.starts))]
            pair, word = t.pair[low:high], t.word[low:high]
            trust = self.trust[pair][:, None]
            gain = np.log(trust * self.double[pair] + (1 - trust) * self.single[word])
            out[at : at + 5000] = np.add.reduceat(gain, t.starts[at : at + 5000] - low, axis=0)
        return out

    def words(self, t: Tokens, documents: int) -> tuple[np.ndarray, np.ndarray]:
        """[document, subject] words of sentences that go to the subject, and the words of each document."""
        out = np.zeros((documents, len(self.subjects)))
        total = np.bincount(t.document, weights=t.lengths, minlength=documents) if len(t.starts) else np.zeros(documents)
        if len(t.starts) and len(self.subjects):
            g, each, k = self.gains(t), np.arange(len(t.starts)), len(self.subjects)
            about = np.full((documents, k), 1.0 / k)
            for _ in range(FOLDS):
                # what a document is about elsewhere speaks for its unclear sentences
                z = g + np.log(about)[t.document]
                best = z.argmax(1)
                top = z[each, best]
                # a sentence must lie a margin below the other subjects together, so that what they share says nothing, and
                # below the model of all documents
                rest = np.exp(np.maximum(z - top[:, None], -60))
                rest[each, best] = 0
                sure = (-np.log(rest.sum(1) / max(k - 1, 1) + 1e-12) > self.margin) & (g[each, best] > self.above)
                out = np.zeros((documents, k))
                np.add.at(out, (t.document[sure], best[sure]), t.lengths[sure])
                about = (out + 5.0) / (out.sum(1) + 5.0 * k)[:, None]
        return out, total


def background_counts(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and word pairs of all documents per bucket; what is collected has at most WORDS + PAIRS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WORDS + PAIRS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                t = tokens(batch.column(0).slice(at, 500).to_pylist())
                sums[:WORDS] += np.bincount(t.word, minlength=WORDS)
                sums[WORDS:] += np.bincount(t.pair, minlength=PAIRS)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[cell])], ["cell", "n"])

    rows = spread(documents.select("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WORDS + PAIRS)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out[:WORDS], out[WORDS:]


def _ratios(bucket: np.ndarray, size: int, weight: np.ndarray, sentence: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """[size, k]: counts of the bucket in each subject against those expected of it, both raised by ``PRIOR``. ``weight``
    is each sentence's in each subject."""
    out = np.empty((size, weight.shape[1]), np.float32)
    for i in range(weight.shape[1]):
        own = weight[:, i][sentence]
        seen = np.bincount(bucket, weights=own, minlength=size)
        out[:, i] = (seen + PRIOR) / (expected * max(own.sum(), 1e-9) + PRIOR)
    return out


def _trained(t: Tokens, allowed: np.ndarray, subjects: list[str], counts: tuple[np.ndarray, np.ndarray]) -> Models:
    """Sentences of labelled documents shared out among their labels and the background until it settles."""
    k = len(subjects)
    sentence = np.repeat(np.arange(len(t.starts)), t.lengths)
    owner = allowed[t.document]
    weight = owner / np.maximum(owner.sum(1, keepdims=True), 1)
    every = len(t.word)
    # words and pairs are expected as often as in all documents; labelled text counts also where the corpus lacks it
    pair_count = np.bincount(t.pair, minlength=PAIRS)
    word_share = (counts[0] + np.bincount(t.word, minlength=WORDS)) / max(counts[0].sum() + every, 1)
    pair_share = (counts[1] + pair_count) / max(counts[1].sum() + every, 1)
    trust = (pair_count / (pair_count + 5.0)).astype(np.float32)
    model = Models(subjects, np.ones((WORDS, k), np.float32), np.ones((PAIRS, k), np.float32), trust)
    for _ in range(ROUNDS):
        model.single = _ratios(t.word, WORDS, weight, sentence, word_share)
        model.double = _ratios(t.pair, PAIRS, weight, sentence, pair_share)
        z = np.where(owner > 0, model.gains(t), -80.0)
        z = np.exp(z - z.max(1, keepdims=True)) * (owner > 0)
        weight = z / np.maximum(z.sum(1, keepdims=True), 1e-9)
    return model


def fitted(texts: list[str], labels: list[list[str]], counts: tuple[np.ndarray, np.ndarray]) -> Models:
    """Models of all labelled documents; margin and share are calibrated on the halves the models weren't fitted to."""
    subjects = sorted({s for own in labels for s in own})
    number = {s: i for i, s in enumerate(subjects)}
    allowed = np.zeros((len(texts), len(subjects)))
    for i, own in enumerate(labels):
        for s in own:
            allowed[i, number[s]] = 1
    t = tokens(texts)
    if not subjects or not len(t.word):
        return Models(subjects, np.ones((WORDS, len(subjects))), np.ones((PAIRS, len(subjects))), np.zeros(PAIRS))
    model = _trained(t, allowed, subjects, counts)
    if len(texts) >= 40:
        halves = []
        for odd in (0, 1):
            a, b = range(odd, len(texts), 2), range(1 - odd, len(texts), 2)
            part = _trained(tokens([texts[i] for i in a]), allowed[a], subjects, counts)
            halves.append((part, tokens([texts[i] for i in b]), allowed[b]))
        model.margin, model.share = _calibrated(halves)
    return model


def _calibrated(halves: list[tuple[Models, Tokens, np.ndarray]]) -> tuple[float, float]:
    """Margin and share with the best F1; ties go to the middle of what is equally good."""
    found: list[tuple[float, float, float]] = []
    for margin in (2.0, 3.0, 3.5, 4.0, 5.0, 6.0):
        parts = []
        for model, t, allowed in halves:
            model.margin = margin
            words, total = model.words(t, len(allowed))
            parts.append((words / np.maximum(total, 1)[:, None], allowed > 0))
        for share in (0.12, 0.14, 0.16, 0.18, 0.2, 0.22):
            said = [(p >= share, a) for p, a in parts]
            hit = sum((x & a).sum() for x, a in said)
            found.append((2 * hit / max(sum(x.sum() + a.sum() for x, a in said), 1), margin, share))
    top = max(f[0] for f in found)
    good = sorted(f[1:] for f in found if f[0] >= top - 0.003)
    return good[len(good) // 2]


def labelled(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[list[str], list[list[str]]]:
    own = labels.where("trim(subject) <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    rows = documents.where("trim(text) <> ''").select("doc_id", "text").join(own, "doc_id")
    picked = bounded_sample(rows.select("doc_id", "text", "subjects"), "doc_id", bound)
    return [r["text"] for r in picked], [r["subjects"] for r in picked]


def subject_shares(documents: DataFrame, model: Models) -> DataFrame:
    """doc_id, subject, words of it and words of the document, for every subject that fills the share."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words, total = own.words(tokens(batch.column("text").to_pylist()), batch.num_rows)
                i, k = np.nonzero((words >= own.share * np.maximum(total, 1)[:, None]) & (words > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(i)),
                        pa.array([own.subjects[x] for x in k], pa.string()),
                        pa.array(words[i, k].astype(np.int64)),
                        pa.array(total[i].astype(np.int64)),
                    ],
                    ["doc_id", "subject", "words", "total"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, subject string, words long, total long")
