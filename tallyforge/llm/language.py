"""Language of a text by script and words, vectorised over Arrow arrays.

Common function words of each language vote. Where they are too few to tell (option labels,
single phrases), character trigrams decide, by a naive Bayes model that :func:`learn` fits on
a bounded sample of the texts at hand, labelled by their function words.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels

LANGUAGES = ("en", "de", "fr", "es", "pt", "zh")
SAMPLE = 4_000  # texts on which the trigram model is fitted, at most
SAMPLE_CHARS = 60, 2_000  # length of the texts it is fitted on
SURE = 3.0, 1.5  # votes, and how many times those of the next language, that settle it
_SLOTS = 1 << 16

#: Common function words that (nearly) only one of the languages uses.
WORDS = {
    "en": "the of and to is it that this with have has would you i my how what when why who which should does some about are be was were by from for not but they we he she as over under",
    "de": "der die das und ist nicht den dem des ein eine einen einer im auf mit von ohne nur zum zur als auch sich wie wird sie ich über gegen nach bei seit für aber oder wenn dass mir",
    "fr": "le la les des du et est une pas dans sur pour avec plus au aux ce cette qui que je ne vous trop sans selon depuis après bien l d qu mais ou nous il elle sont",
    "es": "el los las del y es una en con por sin su sus más muy al lo cómo usted según desde hace pero hay este esta como ha son se yo no esa ese mi",
    "pt": "o os as da dos das em um uma não com sem por mais ao à você é há muitos na no nos pela sobre isso mas são ou eu foi ser essa esse minha",
}

#: What answers of agreement scales are made of.
ANSWERS = {
    "en": "agree disagree strongly yes", "de": "stimme lehne zu ab stark ja nein", "fr": "accord oui non", "es": "acuerdo desacuerdo muy sí", "pt": "concordo discordo sim",
}

Model = np.ndarray | None
"""Log probabilities of hashed trigrams, by Latin-script language."""


@functools.lru_cache(maxsize=1)
def seeds() -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and the share of a vote each gives to the Latin-script languages."""
    votes: dict[int, np.ndarray] = {}
    for k, lang in enumerate(LANGUAGES[:-1]):
        h, _ = kernels.word_hashes(pa.array([f"{WORDS[lang]} {ANSWERS[lang]}"]))
        for x in h.tolist():
            votes.setdefault(x, np.zeros(len(LANGUAGES) - 1))[k] = 1.0
    keys = np.array(sorted(votes), np.uint64)
    return keys, np.stack([votes[int(x)] / votes[int(x)].sum() ** 2 for x in keys])


def learn(texts: DataFrame, key: Column, text: Column, rows: int = SAMPLE) -> Model:
    """The trigram model of a sample: the ``rows`` texts of ``SAMPLE_CHARS`` characters whose
    ``key`` hashes lowest. None where function words settle no text of the sample."""
    src = texts.select(F.xxhash64(key).alias("h"), text.alias("t")).filter(F.length("t").between(*SAMPLE_CHARS))
    col = kernels.string_array(src.orderBy("h").limit(rows).toArrow()["t"])
    lang, sure = _vote(kernels.words(col))[:2]
    slot, owner = _trigrams(col)
    count = np.zeros((_SLOTS, len(LANGUAGES) - 1))
    told = sure[owner] & (lang[owner] < count.shape[1])
    np.add.at(count, (slot[told], lang[owner[told]]), 1.0)
    if not told.any():
        return None
    return np.log((count + 0.1) / (count.sum(0) + 0.1 * _SLOTS)).astype(np.float32)


def _trigrams(col) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of each letter with its two neighbours; what is no letter reads alike."""
    t = kernels.tables()
    cps, off = kernels.code_points(col)
    v = t.vals[0][cps]
    v[(cps >= 48) & (cps < 58)] = 0
    at = np.flatnonzero(v)
    owner = np.searchsorted(off, at, "right") - 1
    before, after = np.where(at > off[owner], v[np.maximum(at - 1, 0)], 0), np.where(at + 1 < off[owner + 1], v[np.minimum(at + 1, max(len(v) - 1, 0))], 0)
    mixed = kernels.mix64(before * np.uint64(3) + kernels.mix64(v[at]) + after * np.uint64(0x9E3779B97F4A7C15))
    return (mixed >> np.uint64(48)).astype(np.int64), owner


def _vote(read) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language by function words and script, whether it is settled, share of Han, letters."""
    hashes, start, stop, bounds, cps = read
    n = len(bounds) - 1
    keys, votes = seeds()
    owner = np.repeat(np.arange(n), np.diff(bounds))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    score = np.zeros((n, votes.shape[1]))
    for k in range(votes.shape[1]):
        score[:, k] = np.bincount(owner[hit], votes[at[hit], k], n)
    han = np.concatenate([[0], np.cumsum((cps >= 0x3400) & (cps < 0xA000))])
    chars = np.bincount(owner, stop - start, n)
    chinese = np.bincount(owner, han[stop] - han[start], n) / np.maximum(chars, 1)
    top = np.sort(score, 1)
    lang = np.where(top[:, -1] > 0, score.argmax(1), -1)
    zh = chinese > 0.35
    sure = zh | ((top[:, -1] >= SURE[0]) & (top[:, -1] >= SURE[1] * top[:, -2]))
    return np.where(zh, LANGUAGES.index("zh"), lang), sure, chinese, chars


def detect(col, model: Model = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: index into LANGUAGES (-1 if nothing tells), the share of Han characters
    among its letters and digits, and the number of these."""
    col = kernels.string_array(col)
    lang, sure, chinese, chars = _vote(kernels.words(col))
    unsure = np.flatnonzero(~sure & (chars > 0))
    if model is not None and len(unsure):
        slot, owner = _trigrams(col.take(pa.array(unsure)))
        score = np.stack([np.bincount(owner, model[slot, k], len(unsure)) for k in range(model.shape[1])], 1)
        some = np.bincount(owner, minlength=len(unsure)) > 0
        lang[unsure[some]] = score[some].argmax(1)
    return lang, chinese, chars
