"""Scores for abusive, hateful or sexual content.

A linear classifier over character n-grams (two to six letters, hashed) whose features are scaled by naive Bayes
log-count ratios. Texts are first brought to one form: look-alike letters, digits and signs for letters, stretched and
spaced-out words. A post's score is that of its worst window of ``WINDOW`` characters, so one abusive sentence counts
in a text of any length; all windows of all texts are scored, with cumulated sums in numpy.

Training takes the labelled lines of ``abuse_labels``, written out with slots and usual disguises, alone and between other
words, and as harmless background the windows of at most ``BACKGROUND`` posts (those with the smallest hash of their id, a
documented bound that doesn't grow with the table). Windows of an abusive line are learned by the window that shows it
best; background that a first fit takes for abusive is left out of the others. The threshold is learned from labelled
lines of kinds held out of the fit, put into background posts that were held out too; it doesn't depend on what else the
table holds.

Only ASCII letters are read once look-alikes are brought to one form, so words of other scripts say nothing either way.

Defined results: null text has a null score and isn't flagged; blank text, and text wholly in another script, scores as
harmless; repeated rows give equal scores; an empty table gives an empty result (the classifier then learns from the
labelled lines alone).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.abuse_labels import ABUSIVE, HARMLESS, SLOTS
from tidewatch.llm.lookalikes import plain
from tidewatch.llm.samples import bounded_sample
from tidewatch.storage import exists, shared_root, spread

BITS, ORDERS, WINDOW, BACKGROUND, COPIES, TAIL = 18, (2, 3, 4, 5, 6), 48, 3000, 24, 4.0

#: Folds of the labelled lines for the threshold, lines written out of each held-out pattern.
FOLDS, HELD = 3, 6

#: Windows learned at once.
STEP = 256

# Signs that stand for letters.
LEET = str.maketrans("4@3108$57", "aaeiobsst")
_TOKEN = re.compile(r"\S*[a-z]\S*[0-9@$]\S*|\S*[0-9@$]\S*[a-z]\S*")
_LONG_RUN = re.compile(r"([a-z])\1{2,}")
_SPACED = re.compile(r"(?<![a-z0-9*#@$])[a-z*#@$0-9](?:[ .\-_][a-z*#@$0-9]){3,}(?![a-z])")
_OTHER = re.compile(r"[^a-z0-9*#'$]+")


def disguised_off(text: str) -> str:
    """Lower case, letters for signs, spaced-out and stretched words put together; marks become single spaces."""
    low = plain(text).lower()
    low = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), low)
    if _TOKEN.search(low):
        low = _TOKEN.sub(lambda m: m[0].translate(LEET), low)
    low = _LONG_RUN.sub(r"\1", low)
    return _OTHER.sub(" ", low).strip()


def _hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the bucket of the n-gram that starts at each place."""
    wide = data.astype(np.uint32)
    for n in ORDERS:
        h = np.full(len(wide) - n + 1, 0x9E37 + n, np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) ^ wide[k : len(wide) - n + 1 + k]
        h = h * np.uint32(2654435761)
        yield n, (h >> np.uint32(32 - BITS)).astype(np.int64)


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array with a window of blanks after each, and where each starts."""
    parts = [t.encode("ascii", "ignore") for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + WINDOW)])[:-1] + WINDOW
    data = b" " * WINDOW + b"".join(p + b" " * WINDOW for p in parts) + b" " * WINDOW
    return np.frombuffer(data, np.uint8), starts


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, starts = _laid_out(texts)
        at = np.zeros(len(data) + 1)
        for _, h in _hashes(data):
            at[1 : len(h) + 1] += self.weights[h]
        summed = np.cumsum(at)
        return summed[WINDOW:] - summed[:-WINDOW], starts

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        values, starts = self.windows(texts)
        # a text has the windows that lie in it by half at least, a short one those that hold it whole
        ends = starts + np.array([len(t.encode("ascii", "ignore")) for t in texts], np.int64) - WINDOW // 2
        first, last = starts - WINDOW // 2, np.maximum(ends, starts - WINDOW // 2)
        bounds = np.column_stack([first, last + 1]).ravel()
        return np.maximum.reduceat(values, bounds)[::2] + self.bias

    def best(self, texts: list[str]) -> list[str]:
        """Of each text the window with the highest score."""
        values, starts = self.windows(texts)
        out = []
        for t, s in zip(texts, starts, strict=True):
            n = max(len(t) - WINDOW, 0) + 1
            i = int(np.argmax(values[s : s + n]))
            out.append(t[i : i + WINDOW])
        return out


def written_out(patterns: list[str], copies: int, seed: int, disguise: bool) -> list[str]:
    """Every pattern with its slots filled ``copies`` times, some disguised the way people do."""
    rng = random.Random(seed)
    out = []
    for pattern in patterns:
        for _ in range(copies):
            line = re.sub(r"\{(\w+)\}", lambda m: rng.choice(SLOTS[m[1]]), pattern)
            if disguise and rng.random() < 0.35:
                words = line.split()
                i = max(range(len(words)), key=lambda k: len(words[k]) * rng.random())
                w = words[i]
                if len(w) > 3:
                    k = rng.randrange(1, len(w) - 1)
                    words[i] = rng.choice([w[:k] + "*" + w[k + 1 :], w[:k] + "#" + w[k + 1 :], w[0] + "*" * (len(w) - 2) + w[-1], w[:k] + w[k + 1 :], w[:k] + " " + w[k + 1 :]])
                line = " ".join(words)
            out.append(disguised_off(line))
    return out


def _rows(texts: list[str]) -> list[np.ndarray]:
    """Buckets of each text, as one window holds them."""
    data, starts = _laid_out(texts)
    lengths = [len(t.encode("ascii", "ignore")) for t in texts]
    hashed = [h for _, h in _hashes(data)]
    out = []
    for s, n in zip(starts, lengths, strict=True):
        left = max(s - 1, 0)
        out.append(np.concatenate([h[left : s + n] for h in hashed]))
    return out


def fit(positive: list[str], negative: list[str], rounds: int = 6, l2: float = 1e-4, seed: int = 5) -> Model:
    """Logistic regression on features scaled by log-count ratios, by averaged mini-batch steps."""
    size = 1 << BITS
    rows = _rows(positive) + _rows(negative)
    labels = np.array([1.0] * len(positive) + [0.0] * len(negative))

    def present(part: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([np.unique(r) for r in part] or [np.zeros(0, np.int64)]), minlength=size)

    p, q = 1.0 + present(rows[: len(positive)]), 1.0 + present(rows[len(positive) :])
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # a bucket that neither side has says nothing, and neither do the blanks around a short text
    ratio[(p == 1) & (q == 1)] = 0.0
    ratio[[h[0] for _, h in _hashes(np.full(WINDOW, ord(" "), np.uint8))]] = 0.0
    x = (ratio / 60).astype(np.float64)
    w, grad2, bias = np.full(size, 0.02), np.full(size, 1e-6), 0.0
    bias2 = 1e-6
    rng = np.random.default_rng(seed)
    share = np.array([0.5 / max(len(negative), 1), 0.5 / max(len(positive), 1)]) * len(rows)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP):
            batch = order[at : at + STEP]
            own = [rows[i] for i in batch]
            flat = np.concatenate(own)
            place = np.repeat(np.arange(len(batch)), [len(r) for r in own])
            z = np.bincount(place, weights=(w * x)[flat], minlength=len(batch)) + bias
            y = labels[batch]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share[y.astype(int)]
            # the gradient of all buckets at once is cheaper than finding those of the batch
            seen = np.bincount(flat, weights=error[place], minlength=size)
            g = seen * x / len(batch) + l2 * w * (seen != 0)
            grad2 += g * g
            w -= 0.1 * g / np.sqrt(grad2)
            b = error.mean()
            bias2 += b * b
            bias -= 0.1 * b / np.sqrt(bias2)
    return Model(w * ratio / 60, float(bias))


def _pieces(texts: list[str], step: int = WINDOW) -> list[str]:
    return [t[i : i + WINDOW] for t in texts for i in range(0, max(len(t) - WINDOW // 2, 1), step)]


def inserted(lines: list[str], carriers: list[str], seed: int) -> list[str]:
    """Each line between the words of a carrier, as it stands in a post; without carriers the line alone."""
    rng = random.Random(seed)
    out = []
    for line in lines:
        words = rng.choice(carriers).split(" ") if carriers else []
        at = rng.randint(0, len(words))
        out.append(" ".join([*words[:at], line, *words[at:]]))
    return out


def _around(lines: list[str], carriers: list[str], seed: int) -> list[str]:
    """The lines as windows show them: every other one alone, the rest with some words of a carrier on one side."""
    rng = random.Random(seed)
    out = []
    for i, line in enumerate(lines):
        room = WINDOW - len(line) - 1
        if i % 2 and carriers and room > 3:
            text = rng.choice(carriers)
            at = rng.randint(0, max(len(text) - room, 0))
            before = rng.randint(0, room)
            line = f"{text[at : at + before]} {line} {text[at + before : at + room]}"[:WINDOW].strip()
        out.append(line)
    return out


def _fitted(positive: list[str], harmless: list[str], calm: list[str], seed: int) -> Model:
    """Some fits, each but the first learning abusive lines by the window that shows them best, and also the harmless
    windows that looked worst to those before."""
    around = _around(positive, calm, seed)
    rest = _pieces(_around(harmless, calm, seed + 1), WINDOW // 2) + _pieces(calm)
    model = fit([p[:WINDOW] for p in around], rest, rounds=2)
    for rounds in (2, 2, 6):
        rest = rest + (model.best(calm) if calm else [])
        model = fit(model.best(around), rest, rounds=rounds)
    return model


def _split(lines: list[str], fold: int) -> tuple[list[str], list[str]]:
    own = [x for i, x in enumerate(lines) if i % FOLDS == fold]
    return [x for i, x in enumerate(lines) if i % FOLDS != fold], own


def trained(background: list[str], seed: int = 11) -> Model:
    """The classifier from the labelled lines and harmless background texts, and its threshold from held-out ones: kinds
    of lines (and background) that a fit hasn't seen are put into background posts, and the threshold is where most is
    right: the share of harmless ones flagged and of abusive ones missed weigh alike."""
    texts = [t for t in map(disguised_off, filter(None, background)) if t]
    # background that a first fit takes for abusive is left out
    first = _fitted(written_out(ABUSIVE, COPIES // 2, seed, True), written_out(HARMLESS, COPIES // 2, seed, False), texts, seed)
    calm = texts
    if texts:
        scores = first.scores(texts)
        calm = [t for t, s in zip(texts, scores, strict=True) if s < _beyond(scores)]
    abusive, harmless = [], []
    for fold in range(FOLDS):
        (shown, held), (plain_shown, plain_held) = _split(ABUSIVE, fold), _split(HARMLESS, fold)
        carriers, others = _split(calm, fold)
        model = _fitted(written_out(shown, COPIES // 2, seed, True), written_out(plain_shown, COPIES // 2, seed, False), carriers, seed)
        abusive.append(model.scores(inserted(written_out(held, HELD, seed + 2, True), others, seed + 3)))
        harmless.append(model.scores(inserted(written_out(plain_held, HELD, seed + 2, False), others, seed + 4)))
    model = _fitted(written_out(ABUSIVE, COPIES, seed, True), written_out(HARMLESS, COPIES, seed + 1, False), calm, seed)
    model.threshold = best_cut(np.concatenate(abusive), np.concatenate(harmless))
    return model


def best_cut(abusive: np.ndarray, harmless: np.ndarray) -> float:
    """The score with the least share of harmless ones above + share of abusive ones below."""
    at = np.unique(np.concatenate([abusive, harmless]))
    if not len(abusive) or not len(harmless):
        return 0.0
    missed = np.searchsorted(np.sort(abusive), at) / len(abusive)
    flagged = 1 - np.searchsorted(np.sort(harmless), at) / len(harmless)
    return float(at[np.argmin(missed + flagged)])


def _beyond(scores: np.ndarray) -> float:
    """Where most texts of the background end: ``TAIL`` standard deviations over their median. The deviation is taken from
    the median and the nine tenths quantile, so abusive texts among them don't move it."""
    middle, high = np.quantile(scores, (0.5, 0.9))
    return float(middle + TAIL * max(high - middle, 1e-6) / 1.2816)


def background(posts: DataFrame, key: str, text: str, bound: int = BACKGROUND) -> list[str]:
    return [r["t"] for r in bounded_sample(posts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")), "k", bound)]


def scored(posts: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """``keys``, score (positive where flagged) and flagged."""
    shared = posts.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, threshold = shared.value
        own = Model(weights, bias, threshold)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            found = np.full(len(texts), np.nan)
            here = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(here), 500):
                part = here[at : at + 500]
                found[part] = own.scores([disguised_off(texts[i]) for i in part]) - threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [pa.array(found, mask=np.isnan(found)), pa.array(np.nan_to_num(found, nan=-1.0) > 0)],
                [*keys, "score", "flagged"],
            )

    rows = spread(posts.select(*keys, F.col(text).alias("t")))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    return rows.mapInArrow(run, schema + ", score double, flagged boolean")


def kept_model(spark: SparkSession, background: list[str]) -> Model:
    """``trained(background)``, fitted once and kept in the shared folder under a name made of all that it depends on."""
    settings = (BITS, ORDERS, WINDOW, COPIES, TAIL, FOLDS, HELD, ABUSIVE, HARMLESS, sorted(SLOTS.items()), sorted(filter(None, background)))
    path = f"{shared_root(spark)}/tidewatch/abuse-model-{hashlib.blake2b(repr(settings).encode(), digest_size=12).hexdigest()}"
    if not exists(spark, path + "/_SUCCESS"):
        model = trained(sorted(filter(None, background)))
        row = [(model.weights.tolist(), model.bias, model.threshold)]
        spark.createDataFrame(row, "weights array<double>, bias double, threshold double").coalesce(1).write.mode("overwrite").parquet(path)
        return model
    r = spark.read.parquet(path).first()
    return Model(np.array(r["weights"]), r["bias"], r["threshold"])
