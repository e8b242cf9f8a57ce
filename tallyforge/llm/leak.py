"""Held-out passages inside training texts, found by spaced-seed hashing.

Each fixed mask picks some positions of a window of words and ignores the rest, so one
changed word cannot hide a passage from every mask. Windows of the items and of every
document are hashed under all masks and joined; around the hits of a (document, item) pair a
local alignment of the whole passage decides, so substitutions, insertions and omissions
inside it are tolerated.

The items are read in blocks of at most ``BLOCK_WORDS`` words; each block's seeds go to the
executors as one index of bounded size, the build side of a hash join that every document
probes as it is read. Any number of items
therefore works, at one pass over the documents per block. What several items share is counted
over all of them, and what a document holds is settled over all blocks, so that the blocks do
not show in the result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels
from tallyforge.session import prepare

MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 4, 5))
SHARED = 2  # a sentence that more items than this share is an instruction or a stock question
BLOCK_WORDS = 2_000_000
MIN_HITS = 4  # every span within the allowance has so many, wherever its words changed
MIN_SPAN = 15  # consecutive passage words that the alignment covers
CHANGED = 5  # one change is allowed for so many passage words of the span
MOST_CHANGES = 6  # a longer span with more of them holds a shorter one with few enough
LEAST_MATCHED = 10  # of 15 consecutive passage words, in every span within the allowance
MIN_SCORE = 6  # no span within that allowance aligns at less; a floor, the span decides
BATCH = 512
SLACK = 24
CLEARLY = 4  # an item whose words here match by so much less than another's is no leak
MARKUP = r"<[/!]?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#[0-9]{1,6});"
_SENTENCE = re.compile(r"(?<=[.?!。？！])\s+")


def _split(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def passages(items: list[tuple[int, str | None]], common: int = SHARED + 1, shared: set[str] | None = None) -> dict[int, str]:
    """The passage of each item: its sentences but for those that ``common`` or more items
    share (instruction lines, stock questions; ``shared``, where they are counted already)
    and a closing question."""
    split = {i: _split(t) for i, t in items}
    if shared is None:
        seen = Counter(s for ss in split.values() for s in set(ss))
        shared = {s for s, n in seen.items() if n >= common}
    out = {}
    for i, ss in split.items():
        if len(ss) > 1 and ss[-1].rstrip().endswith(("?", "？")):
            ss = ss[:-1]
        kept = [s for s in ss if s not in shared]
        out[i] = " ".join(kept)
    return out


def _seeds(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: start positions of windows inside one text, and their hashes."""
    text_end = np.repeat(bounds[1:], np.diff(bounds))
    for m, mask in enumerate(MASKS):
        span = mask[-1] + 1
        at = np.flatnonzero(np.arange(len(words)) + span <= text_end)
        h = np.full(len(at), m + 1, np.uint64)
        for o in mask:
            h = (h ^ words[at + o]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        yield at, h


class Index:
    """Seeds of one block of items, sorted by hash, and the passages' words."""

    def __init__(self, texts: dict[int, str]) -> None:
        self.ids = np.array(list(texts), np.int64)
        self.words, self.bounds = kernels.word_hashes(pa.array(list(texts.values()), pa.string()), each_sign=True)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        hs, at = [], []
        for p, h in _seeds(self.words, self.bounds):
            hs.append(h)
            at.append(p)
        h, p = (np.concatenate(hs), np.concatenate(at)) if hs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.h, self.at = h[order], p[order]
        self.item = owner[self.at] if len(self.at) else self.at
        # a slot for some forty seeds' worth of bits, whatever their number: one in forty windows passes by chance
        self.bits = max(16, int(40 * len(self.h)).bit_length())

    @functools.cached_property
    def filter(self) -> np.ndarray:
        """Which leading bits of a hash some seed has; made where it is used, not shipped."""
        out = np.zeros(1 << self.bits, bool)
        out[(self.h >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        return out


def best_alignments(ps: list[np.ndarray], costs: list[np.ndarray], ds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of the best local alignment of each pair of sequences, passage words it spans,
    and where it ends in the second sequence.

    A matching word counts 1, a word of the passage changed minus its cost, one left out -2,
    one inserted -1; of equal scores the shortest span counts. Score and start of a path
    travel in one integer.
    """
    if not ps:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = np.int64(1 << 24)
    m, n = max(map(len, ps)), max(map(len, ds))
    p, d = np.zeros((len(ps), m), np.uint64), np.ones((len(ps), n), np.uint64)
    cost = np.full((len(ps), m), one, np.int64)
    for i, (a, c, b) in enumerate(zip(ps, costs, ds, strict=True)):
        p[i, : len(a)], cost[i, : len(a)], d[i, : len(b)] = a, c * one, b
    slope = one * np.arange(n + 1, dtype=np.int64)
    row = np.zeros((len(ps), n + 1), np.int64)
    best, end, stop = np.zeros(len(ps), np.int64), np.zeros(len(ps), np.int64), np.zeros(len(ps), np.int64)
    each = np.arange(len(ps))
    for i in range(m):
        new = np.zeros_like(row)
        np.maximum(np.maximum(row[:, :-1], i) + np.where(d == p[:, i : i + 1], one, -cost[:, i : i + 1]), row[:, 1:] - 2 * one, out=new[:, 1:])
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        row[row < one] = 0
        col = row.argmax(axis=1)
        top = row[each, col]
        up = top // one > best // one
        best[up], end[up], stop[up] = top[up], i + 1, col[up]
    return best // one, np.where(best > 0, end - best % one, 0), stop


def spans_within(ps: list[np.ndarray], ds: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest span of passage words that each document shares with at most one change for
    every ``CHANGED`` of them (0 if shorter than ``MIN_SPAN``), and with no change at all.

    Word ``i`` of a passage meets words ``i`` to ``i + width - 1`` of its document. A word
    changed, left out or inserted is one change. A span starts and ends with two matching
    words, so that no stray match lengthens it. For each number of changes the earliest start
    of a span that ends here is kept.
    """
    m = max(map(len, ps), default=0)
    p, d = np.zeros((len(ps), m), np.uint64), np.ones((len(ps), m + width), np.uint64)
    for i, (a, b) in enumerate(zip(ps, ds, strict=True)):
        p[i, : len(a)], d[i, : len(b)] = a, b[: m + width]
    some = _may_span(p, d, width)
    if not some.all():
        out = np.zeros((2, len(ps)), np.int64)
        if some.any():
            keep = np.flatnonzero(some).tolist()
            out[:, keep] = _spans(p[keep], d[keep], width)
        return out[0], out[1]
    return _spans(p, d, width)


def _may_span(p: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
    """Pairs with ``LEAST_MATCHED`` matched words among some ``MIN_SPAN`` consecutive passage
    words: every span within the allowance has them, wherever its changes lie (five changes in
    the middle of twenty-five words leave the fewest)."""
    m = p.shape[1]
    if m < MIN_SPAN:
        return np.zeros(len(p), bool)
    found = np.zeros(p.shape, bool)
    for o in range(width):
        found |= d[:, o : o + m] == p
    upto = np.zeros((len(p), m + 1), np.int32)
    np.cumsum(found, axis=1, out=upto[:, 1:])
    return (upto[:, MIN_SPAN:] - upto[:, :-MIN_SPAN]).max(axis=1) >= LEAST_MATCHED


def _spans(p: np.ndarray, d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    none = np.int32(1 << 30)
    ps, m = p, p.shape[1]
    same = np.zeros((m + 2, len(ps), width), bool)
    for i in range(m):
        same[i + 1] = d[:, i : i + width] == p[:, i : i + 1]
    row = np.full((MOST_CHANGES + 1, len(ps), width), none)
    least = np.maximum(MIN_SPAN, CHANGED * np.arange(MOST_CHANGES + 1, dtype=np.int32))[:, None]
    within, verbatim = np.zeros((2, len(ps)), np.int32)
    for i in range(m):
        here = same[i + 1]
        new = np.where(here, np.minimum(row, np.where(same[i + 2], np.int32(i), none)), none)
        stop = here & same[i]
        np.minimum(new[1:], row[:-1], out=new[1:])
        np.minimum(new[1:, :, :-1], row[:-1, :, 1:], out=new[1:, :, :-1])
        for k in range(1, MOST_CHANGES + 1):
            np.minimum(new[k, :, 1:], new[k - 1, :, :-1], out=new[k, :, 1:])
        span = np.int32(i + 1) - np.where(stop, new, none).min(axis=2)
        np.maximum(verbatim, span[0], out=verbatim)
        np.maximum(within, np.where(span >= least, span, 0).max(axis=0), out=within)
        row = new
    return within, verbatim


def own_passages(group: list[tuple[int, int, int, int, int]], verbatim: frozenset[int] | set[int] = frozenset()) -> list[tuple[int, int, int, int, int]]:
    """Alignments (score, span, start, end, item) of one document without those that lie, for
    more than half, on words that another item matches clearly better: items of one mould
    resemble each other's passages without being leaked by them. Items in ``verbatim``, of
    which the document holds a whole span unchanged, stay whatever other items match."""
    kept: list[tuple[int, int, int, int, int]] = []
    for x in sorted(group, reverse=True):
        if x[4] in verbatim or not any(y[0] >= x[0] + CLEARLY and 2 * (min(x[3], y[3]) - max(x[2], y[2])) > x[3] - x[2] for y in kept):
            kept.append(x)
    return kept


def _runs(index: Index, bounds: np.ndarray, at: np.ndarray, seed: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, first and last diagonal) of each run of hits on neighbouring
    diagonals that starts at ``MIN_HITS`` or more words of the document."""
    doc, item = np.searchsorted(bounds, at, "right") - 1, index.item[seed]
    diagonal = at - index.at[seed] + index.bounds[item]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal, at = doc[order], item[order], diagonal[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] > diagonal[:-1] + MOST_CHANGES)
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    hits = np.bincount(np.unique(run * (at.max() + 1) + at) // (at.max() + 1), minlength=len(first)) if len(order) else np.zeros(0, np.int64)
    some = hits >= MIN_HITS
    first, last = first[some], last[some]
    return list(zip(doc[first].tolist(), item[first].tolist(), diagonal[first].tolist(), diagonal[last].tolist(), strict=True))


def _batches(runs: list[tuple[int, int, int, int]]) -> Iterator[tuple[list[tuple[int, int, int, int]], int]]:
    """Runs of like width together, with the width that holds each of them; a wide run goes
    in small batches."""
    runs = sorted(runs, key=lambda r: r[3] - r[2])
    lo = 0
    while lo < len(runs):
        n = max(1, min(BATCH, BATCH * 64 // (runs[lo][3] - runs[lo][2] + 1)))
        part = runs[lo : lo + n]
        yield part, part[-1][3] - part[-1][2] + 2 * MOST_CHANGES + 1
        lo += n


_ALIGNED = "doc_id bigint, row bigint, score int, span int, start bigint, stop bigint, item_id bigint, verbatim boolean"


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, bounds = kernels.word_hashes(b.column(2), each_sign=True)
            hit_at, hit_seed = [], []
            for at, h in _seeds(words, bounds):
                maybe = np.flatnonzero(index.filter[(h >> np.uint64(64 - index.bits)).astype(np.int64)])
                h, at = h[maybe], at[maybe]
                lo, hi = np.searchsorted(index.h, h, "left"), np.searchsorted(index.h, h, "right")
                n = hi - lo
                some = np.flatnonzero(n)
                hit_at.append(np.repeat(at[some], n[some]))
                n = n[some]
                hit_seed.append(np.repeat(lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            at, seed = np.concatenate(hit_at), np.concatenate(hit_seed)
            found = []
            for part, width in _batches(_runs(index, bounds, at, seed)):
                ps = [index.words[index.bounds[i] : index.bounds[i + 1]] for _, i, _, _ in part]
                ds = []
                for (d, _, x, _), p in zip(part, ps, strict=True):
                    lo = x - MOST_CHANGES
                    before = np.ones(max(0, int(bounds[d]) - lo), np.uint64)
                    ds.append(np.concatenate([before, words[max(lo, bounds[d]) : max(0, min(lo + len(p) + width, bounds[d + 1]))]]))
                within, exact = spans_within(ps, ds, width)
                some = np.flatnonzero(within)
                ds, los = [], []
                for k in some.tolist():
                    d, _, x, y = part[k]
                    los.append(max(int(bounds[d]), x - SLACK))
                    ds.append(words[los[-1] : min(int(bounds[d + 1]), y + len(ps[k]) + 2 * SLACK)])
                score, span, stop = best_alignments([ps[k] for k in some], [np.ones(len(ps[k]), np.int64) for k in some], ds)
                for k, lo, s, n, e in zip(some.tolist(), los, score.tolist(), span.tolist(), stop.tolist(), strict=True):
                    (d, i, _, _), stops = part[k], lo + e - int(bounds[part[k][0]])
                    n = max(n, int(within[k]))
                    found.append((d, s, n, stops - n, stops, int(index.ids[i]), bool(exact[k] >= MIN_SPAN)))
            of = pa.array([f[0] for f in found], pa.int64())
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column(1).take(of), *[pa.array([f[k] for f in found], t) for k, t in enumerate(types, 1)]],
                names=[c.split()[0] for c in _ALIGNED.split(", ")],
            )

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for doc, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            verbatim = {x["item_id"] for x in group if x["verbatim"]}
            found += [(doc, x[4], x[0], x[1]) for x in own_passages([(x["score"], x["span"], x["start"], x["stop"], x["item_id"]) for x in group], verbatim)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "score", "span"])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in set(_split(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "sentence"])


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, span): documents that hold a passage of a held-out item.

    The document must hold ``MIN_SPAN`` or more consecutive passage words with at most one
    change for every ``CHANGED`` of them; tags and entities in the documents do not count as words. Null ids and null or blank texts on either side give no rows;
    an item whose passage is shorter than a window cannot be found. In scripts without spaces
    every sign counts as a word. Rows repeated under one id count once. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    items = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("item_id is not null and text is not null")
    docs = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.regexp_replace(F.col(f"`{text}`"), MARKUP, " ").alias("text")).filter("doc_id is not null and text is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    each = items.mapInArrow(_sentences, "item_id bigint, sentence string").groupBy("sentence").agg(F.count_distinct("item_id").alias("n"))
    shared = {r[0] for r in each.filter(F.col("n") > SHARED).select("sentence").collect()}
    out = None
    for texts in _blocks(items, shared):
        part = docs.mapInArrow(_scan(Index(texts)), _ALIGNED)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score int, span int")
    # a few numbers for each match; texts stay where they are
    groups = out.groupBy("doc_id", "row").agg(F.collect_list(F.struct("score", "span", "start", "stop", "item_id", "verbatim")).alias("found")).select("doc_id", "found")
    return groups.mapInArrow(_own, "doc_id bigint, item_id bigint, score int, span int").groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "span")).alias("m")).select("doc_id", "item_id", "m.score", "m.span")


def _blocks(items: DataFrame, shared: set[str]) -> Iterator[dict[int, str]]:
    """Passages in blocks of a bounded number of characters, streamed to the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.orderBy("item_id").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 5 + 1
        if size > BLOCK_WORDS:
            yield passages(block, shared=shared)
            block, size = [], 0
    if block:
        yield passages(block, shared=shared)
