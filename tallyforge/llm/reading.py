"""Reading level of documents: coverage rank of the vocabulary and sentence complexity.

A document's coverage rank is the size of the smallest frequency-ranked vocabulary that
covers ``COVER`` of its words. The vocabulary is that of a public tokenizer (a parameter),
whose merges are ordered by frequency in general text: a word ranks by its own token, a word
without one after all of them. It is a fixed table of some ten thousand words, so a level
depends on its document alone and not on what else the corpus holds. (Ranks by the corpus's own
counts were tried: specialist prose that makes up a tenth of a corpus ranks its words as
common ones, and the ranks of the bands then overlap wholly.)

The same scan measures sentence complexity: words a sentence, and the hardest and the easiest
sentence by the coverage rank of its own words and its length. SQL calibrates rank and
complexity into a level, about a school grade, and a band.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels
from tallyforge.llm.language import LANGUAGES, detect
from tallyforge.llm.mixing import default_vocabulary
from tallyforge.session import prepare

COVER = 0.6
MARKUP = r"</?[A-Za-z!][^<>]*>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6});|\\\\[nrt]"
_STOPS = np.array([ord(c) for c in ".!?。！？\n"], np.uint32)
HARDEST_WORDS, EASIEST_WORDS = 4, 6

#: A vocabulary of 250 words is the first step; each doubling of it adds 1.1
#: grades, each further word of the mean sentence a third of one.
FIRST_RANK, PER_LOG, PER_WORD = 250.0, 1.6, 0.35
BASIC_RANK, EXPERT_RANK = 3_000, 20_000  # words that a ten-year-old knows; words beyond general use

LEVEL_SQL = f"CASE WHEN language = 'en' THEN {PER_LOG} * ln(greatest(coverage_rank, 1) / {FIRST_RANK}) + {PER_WORD} * words_per_sentence END"
"""Grade of an English document from its coverage rank and the length of its sentences."""

BAND_SQL = f"""CASE WHEN language <> 'en' OR words < 10 THEN NULL
     WHEN coverage_rank <= {BASIC_RANK} AND level <= 6.7 AND hardest <= 9 THEN 'basic'
     WHEN coverage_rank >= {EXPERT_RANK} AND level >= 15 AND easiest >= 15 THEN 'expert' END"""


def _clean(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.regexp_replace(F.col(f"`{text_col}`"), MARKUP, " ")
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text")).filter("doc_id is not null and text is not null")


def ranked_words(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words of a public vocabulary file and the rank (from 1) of each."""
    words: dict[str, int] = {}
    with open(path, "rb") as f:
        for token, rank in map(bytes.split, f):
            word = base64.b64decode(token)
            if word[:1] == b" ":
                text = word[1:].decode("utf-8", "ignore").casefold()
                if text.isalpha():
                    words[text] = min(words.get(text, 1 << 30), int(rank) + 1)
    hashes, _ = kernels.word_hashes(pa.array([" ".join(words)]))
    order = np.argsort(hashes)
    return hashes[order], np.array(list(words.values()))[order]


def _cover(group: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Rank that ``COVER`` of each group's words do not pass; 1 for a group without words."""
    key = np.sort((group << 32) | rank)
    count = np.bincount(group, minlength=n)
    some = count > 0
    out = np.ones(n, np.int64)
    out[some] = key[(np.cumsum(count) - count + np.ceil(COVER * count).astype(np.int64) - 1)[some]] & 0xFFFFFFFF
    return out


def _measure(words: np.ndarray, rank: np.ndarray):
    beyond = int(rank.max(initial=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, start, stop, bounds, cps = kernels.words(b.column(1))
            rows, n = b.num_rows, np.diff(bounds)
            lang, _, _ = detect(b.column(1))
            at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
            r = np.where(words[at] == h, rank[at], beyond) if len(words) else np.full(len(h), beyond)
            owner = np.repeat(np.arange(rows), n)
            letters = np.bincount(owner, stop - start, rows)
            ends = np.concatenate([[0], np.cumsum(np.isin(cps, _STOPS))])
            new = np.ones(len(h), bool)
            new[1:] = (ends[start[1:]] != ends[start[:-1]]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            of, sentence = owner[first], np.cumsum(new) - 1
            sentences, size = np.bincount(of, minlength=rows), np.diff(np.append(first, len(h)))
            said = (cps[start] < 48) | (cps[start] > 57)  # numbers are no vocabulary
            cover = np.where(n > 0, _cover(owner[said], r[said], rows), 0)
            grade = PER_LOG * np.log(_cover(sentence[said], r[said], len(first)) / FIRST_RANK) + PER_WORD * size
            hard, easy = np.full(rows, -99.0), np.full(rows, 99.0)
            np.maximum.at(hard, of[size >= HARDEST_WORDS], grade[size >= HARDEST_WORDS])
            np.minimum.at(easy, of[size >= EASIEST_WORDS], grade[size >= EASIEST_WORDS])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([LANGUAGES[k] if k >= 0 else None for k in lang], pa.string()), pa.array(n.astype(np.int64)), pa.array(sentences.astype(np.int64)),
                    pa.array(cover), pa.array(letters / np.maximum(n, 1)), pa.array(n / np.maximum(sentences, 1)), pa.array(hard), pa.array(easy),
                ],
                names=["doc_id", "language", "words", "sentences", "coverage_rank", "letters_per_word", "words_per_sentence", "hardest", "easiest"],
            )

    return run


def reading_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: the measures, ``level`` (a school grade, about; null unless English) and ``band``.

    ``band`` is ``basic`` or ``expert`` for English documents that are so throughout, else
    null. ``language`` is told from the text, null if it cannot be. A document without words
    has zero counts, no language and no band; null texts and ids have no row; a repeated id
    has a row each time. Other columns are ignored; an empty table gives none.
    """
    prepare(docs.sparkSession)
    clean = _clean(docs, id_col, text_col)
    words, rank = ranked_words(vocabulary or default_vocabulary())
    out = "doc_id bigint, language string, words bigint, sentences bigint, coverage_rank bigint, letters_per_word double, words_per_sentence double, hardest double, easiest double"
    return clean.mapInArrow(_measure(words, rank), out).selectExpr("*", f"{LEVEL_SQL} AS level").selectExpr("*", f"{BAND_SQL} AS band")


def profile(levels: DataFrame, docs: DataFrame, id_col: str = "doc_id", by: str = "source") -> DataFrame:
    """(source, band, documents, words, mean_level): the corpus by level and source."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{by}`").alias("source"))
    band = F.when(F.col("language") != "en", "not English").otherwise(F.coalesce("band", F.when(F.col("level") < 8, "plain").when(F.col("level") < 14, "middle").otherwise("demanding")))
    return levels.select("doc_id", "words", "level", F.coalesce(band, F.lit("none")).alias("band")).join(own, "doc_id").groupBy("source", "band").agg(
        F.count("*").alias("documents"), F.sum("words").alias("words"), F.avg("level").alias("mean_level")
    )
