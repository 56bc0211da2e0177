"""One consistent form for text that reads the same but is stored in other characters.

Steps: compatibility normalization (full-width, half-width, circled, squared and styled letters, ligatures, Roman numerals,
separate accents, spaces; not superscripts, fractions and signs, see ``FORMS``), deletion of
ignorable characters outside emoji, and for every word that mixes alphabets a lattice of look-alike letters, searched
with Viterbi under character trigram scores that are kept per script: a path stays in one script or pays for each
switch. The trigram counts are taken from all texts of the input by bincount per split and summed.

Defined results: null stays null and blank stays as it is; emoji with their joiners and selectors, words wholly in
one script, precomposed accents, typographic quotes and dashes and case are left alone; repeated rows give the same
result; an empty table gives an empty result and scores that know no script better than another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.storage import spread

# Letters of other alphabets and the Latin letters they pass for, best first (Unicode confusables).
CYRILLIC = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "г": "r", "п": "n",
    "и": "u", "ё": "e", "б": "b", "з": "e", "ь": "b", "ү": "y", "ԍ": "g",
}
GREEK = {
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o",
    "ς": "c", "τ": "t", "υ": "uy", "χ": "x", "ω": "w", "γ": "y", "ϲ": "c", "ϳ": "j", "ά": "a", "έ": "e", "ί": "i", "ό": "o",
}
# Capitals whose shape isn't that of their small letter's look-alike.
CAPITALS = {
    "В": "B", "Н": "H", "Р": "P", "С": "C", "У": "Y", "І": "Il", "Ӏ": "Il", "Г": "", "П": "", "И": "", "Б": "", "З": "", "Ё": "E",
    "Η": "H", "Ν": "N", "Ρ": "P", "Υ": "Y", "Μ": "M", "Ι": "Il", "Β": "B", "Σ": "", "Ω": "", "Γ": "", "Ά": "A", "Έ": "E", "Ό": "O",
}
# Letters of further alphabets that pass for Latin ones (Unicode confusables).
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Լ": "L", "Տ": "S"}
CHEROKEE = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ꮍ": "Y",
}
LISU = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L",
    "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
PHONETIC = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v"}
#: These have their own capitals or none, so what they pass for is given as it is.
EXACT = ARMENIAN | CHEROKEE | LISU | PHONETIC
LIKE = CYRILLIC | GREEK
#: Latin small letters and the letters of the other scripts of the same shape.
BACK = {to: [c for c, r in LIKE.items() if r[0] == to and c in "асеорхуіјѕкмтαορνικ"] for to in "aceopxyijskmtvu"}
#: Scripts by number; an alphabet holds the letters that are counted.
SCRIPTS = (
    "abcdefghijklmnopqrstuvwxyz",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїјѕ",
    "αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϲ",
)
WIDTH = 40
CODE = {c: (s, i + 1) for s, letters in enumerate(SCRIPTS) for i, c in enumerate(letters)}
#: Log-score of a switch of script within a word, and of reading a letter as another one.
SWITCH, READ_AS = -12.0, -1.5

KINDS = ("form", "accent", "invisible", "space", "letter")


def _forms() -> dict[str, str]:
    """Characters stored for the letters and digits they show, with those: the compatibility forms of Unicode but for
    superscripts, subscripts, fractions and signs, which are typography, the micro sign, Hangul letters written alone,
    Thai and Lao vowels, circled or squared characters that are emoji or enumerate, and letters of other alphabets that pass
    for Latin ones."""
    out = {chr(o): chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)}
    for o in (*range(0x80, 0x1100), *range(0x1D00, 0x2000), *range(0x2100, 0x2190), *range(0x2460, 0x2500), *range(0x3200, 0x3400), *range(0xFB00, 0xFFA0), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F150)):
        c = chr(o)
        if c.lower() in LIKE:
            continue  # read by the lattice
        tag, _, _ = unicodedata.decomposition(c).partition(" ")
        if not tag.startswith("<") or tag in ("<super>", "<sub>", "<fraction>", "<noBreak>") or o in (0xB5, 0x2139, 0x24C2, 0xE33, 0xEB3):
            continue
        plain, cat = unicodedata.normalize("NFKC", c), unicodedata.category(c)
        letters = plain.isalnum() or tag == "<narrow>"
        if tag == "<compat>" and not (cat[0] == "L" or cat == "Nl") or tag in ("<circle>", "<square>") and not (plain.isascii() and any(x.isalpha() for x in plain)):
            continue
        if letters and plain != c:
            out[c] = plain
    return out


FORMS = _forms()
_LOOK = re.compile(
    "[" + "".join(sorted(map(re.escape, FORMS))) + "".join(EXACT) + "̀-ͯ­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️"
    "﻿ﾠ\U000e0000-\U000e0fff   -   　"
    "Ͱ-ϿЀ-ԯ]"
)
_WORD = re.compile(r"[^\W\d_]+")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ" + "".join(EXACT) + "]")
_PHONETIC = re.compile("[ɐ-ʯ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
#: Scripts in which joiners are part of the spelling.
_JOINING = re.compile("[؀-ۿ܀-ݏऀ-෿က-႟ក-៿᠀-᢯]")
_CJK = re.compile("[　-ヿ㐀-鿿가-힯＀-￯]")


def _emoji(c: str) -> bool:
    o = ord(c) if c else 0
    return o >= 0x1F000 and o < 0xE0000 or 0x2190 <= o <= 0x2BFF or c in "0123456789#*©®™ℹ‼⁉〰〽㊗㊙" and bool(c)


class Lattice:
    """``scores`` is float32[script, WIDTH, WIDTH, WIDTH] of log-probabilities; without it all trigrams are alike."""

    def __init__(self, scores: np.ndarray | None = None):
        self.scores = scores
        self.word = lru_cache(1 << 16)(self._word)

    def _word(self, word: str) -> str:
        """The best reading of a word of several scripts, by Viterbi. A state is (script, last two codes)."""
        if not (_OTHER.search(word) and _LATIN.search(word)):
            return word
        if any(c not in PHONETIC for c in _PHONETIC.findall(word)):
            return word  # a transcription
        beams: dict[tuple[int, int, int], tuple[float, str]] = {(-1, 0, 0): (0.0, "")}
        for c in word:
            low = c.lower()
            base = unicodedata.normalize("NFD", low)[0]
            own = CODE.get(low) or CODE.get(base) or (3, 0)
            options = [(own[0], own[1], c, 0.0)]
            shapes = EXACT.get(c, CAPITALS.get(c))
            if shapes is None:
                shapes = LIKE.get(low, "") if c == low else LIKE.get(low, "").upper()
            options += [(0, CODE[to.lower()][1], to, READ_AS - 1.5 * i) for i, to in enumerate(shapes)]
            if c == low:
                options += [(*CODE[to], to, 3 * READ_AS) for to in BACK.get(c, ())]
            nxt: dict[tuple[int, int, int], tuple[float, str]] = {}
            for (script, a, b), (score, path) in beams.items():
                for s, code, out, cost in options:
                    new = score + cost + (SWITCH if script not in (-1, s) else 0.0)
                    if script not in (-1, s):
                        x = y = 0
                    else:
                        x, y = a, b
                    new += float(self.scores[s, x, y, code]) if self.scores is not None and s < 3 else -3.5
                    key = (s, y, code)
                    if key not in nxt or nxt[key][0] < new:
                        nxt[key] = (new, path + out)
            beams = nxt
        return max(beams.values())[1]

    def form(self, text: str | None) -> tuple[str | None, int]:
        """(consistent form, bit set of KINDS that were found)."""
        if text is None or text.isascii() or not _LOOK.search(text):
            return text, 0
        kinds, out, n, i = 0, [], len(text), 0
        while i < n:
            c = text[i]
            if c < "\u0080":
                out.append(c)
                i += 1
                continue
            o = ord(c)
            cat = unicodedata.category(c)
            prev = text[i - 1] if i else ""
            after = text[i + 1] if i + 1 < n else ""
            if cat == "Zs":
                kinds |= 8
                out.append(" ")
            elif cat == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0100 <= o:
                held = prev and (_emoji(prev) or 0xFE00 <= ord(prev) <= 0xFE0F or 0xE0000 <= ord(prev) <= 0xE007F)
                if o == 0x200D:
                    keep = bool(held) and bool(after) and _emoji(after)
                elif 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE007F:
                    keep = bool(held)
                else:
                    keep = False
                if not keep and o in (0x200C, 0x200D) and prev and _JOINING.match(prev):
                    keep = True
                if keep:
                    out.append(c)
                else:
                    kinds |= 4
            elif 0x300 <= o <= 0x36F:
                kinds |= 2
                out.append(c)
            elif c in FORMS:
                plain = FORMS[c]
                # full-width marks are the ordinary ones of East Asian text
                if o < 0xFF5F and not plain.isalnum() and (_CJK.match(prev) or _CJK.match(after)):
                    out.append(c)
                else:
                    kinds |= 1
                    out.append(plain)
            else:
                out.append(c)
            i += 1
        made = "".join(out)
        if kinds & 2 or "\u3099" in made or "\u309a" in made:
            made = unicodedata.normalize("NFC", made)
        if _OTHER.search(made):
            read = _WORD.sub(lambda m: self.word(m[0]), made)
            if read != made:
                # a foreign word that was put right has no letter of another alphabet in a Latin word
                if any(a != b and _LATIN.match(b) for a, b in zip(made, read, strict=True)):
                    kinds |= 16
                made = read
        return made, kinds


PLAIN = Lattice()


def plain(text: str) -> str:
    """The consistent form without corpus scores, for comparing texts."""
    return unicodedata.normalize("NFKC", PLAIN.form(text)[0] or "")


def _codes(script: int) -> np.ndarray:
    table = np.zeros(0x10000, np.int64)
    for c, (s, i) in CODE.items():
        if s == script:
            table[ord(c)] = i
    return table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [_codes(s) for s in range(3)]
    sums = np.zeros((3, WIDTH**3), np.int64)
    for batch in batches:
        column = batch.column(0)
        for at in range(0, len(column), 2000):
            joined = "  ".join(x for x in column.slice(at, 2000).to_pylist() if x).lower()
            points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
            points = np.where(points < 0x10000, points, 0)
            for s in range(3):
                if s and joined.isascii():
                    continue
                code = tables[s][points]
                if s and not code.any():
                    continue
                # a boundary counts as code 0; runs of other characters between words count once
                code = code[(code > 0) | np.append(True, code[:-1] > 0)]
                if len(code) > 2:
                    sums[s] += np.bincount((code[:-2] * WIDTH + code[1:-1]) * WIDTH + code[2:], minlength=WIDTH**3)
    cell = np.flatnonzero(sums.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.ravel()[cell])], ["cell", "n"])


def script_scores(texts: DataFrame) -> np.ndarray:
    """Interpolated trigram log-probabilities per script of the only column of ``texts``. What is collected has at
    most 3 * WIDTH**3 rows, whatever the size of the input."""
    cells = texts.mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(3 * WIDTH**3)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    tri = counts.reshape(3, WIDTH, WIDTH, WIDTH)
    bi, uni = tri.sum(1), tri.sum((1, 2))
    sizes = np.array([len(x) + 1 for x in SCRIPTS])[:, None]
    p1 = (uni + 1) / (uni.sum(1, keepdims=True) + sizes)
    p2 = (bi + 5 * p1[:, None, :]) / (bi.sum(2, keepdims=True) + 5)
    p3 = (tri + 5 * p2[:, None, :, :]) / (tri.sum(3, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def consistent(df: DataFrame, text: str, keys: list[str], scores: np.ndarray) -> DataFrame:
    """``keys``, the consistent form and the kinds found, of the rows whose text isn't plain ASCII (the others are
    their own form). The scores have a fixed size of under a megabyte."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            made = [lattice.form(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys]
                + [
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.int32()),
                ],
                [*keys, "form", "kinds"],
            )

    rows = spread(df.select(*keys, F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]")))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys) + ", form string, kinds int"
    return rows.mapInArrow(run, schema)
