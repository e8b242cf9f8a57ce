"""Texts cut off before they ended.

One scan reads every text: it folds it into a hash, takes min-hash band keys of its five-word
shingles, looks at how it closes, and counts for each word how often it closes a sentence or
line. Texts with the same letters and digits share one reading. Distinct texts that meet in a
band are verified against every longer one there that could reach a similarity of 0.8 by its
number of shingles; a verified pair is aligned from end to end, and the copy whose alignment
ends early is cut. All others are judged by their closing: marks of a cut, terminal
punctuation, or else the terminality of the closing word.

A band is read in the order of its texts' sizes, each beside those within a quarter of its
own, so texts of unlike length never meet. A band of many distinct texts of one length still
costs the square of their number. A copy that lost more than a fifth of its source is no
near-copy at that similarity and is judged by its closing alone: a lower bar takes refusals and
other terse answers for cut copies of the longer texts that begin like them.

Answer sheets are lists of one-phrase lines over a handful of words: their shingles collide by
chance between any two sheets, so min-hash bands hold all of them and tell nothing. A sheet is
instead aligned with the list that its prompt asks for, and its last line is judged by the
terminality of its closing word over the lines of all sheets.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels
from tallyforge.session import prepare, written

SHINGLE, BANDS, ROWS = 5, 10, 3  # two texts of similarity 0.8 share no band in 1 of 1,300 cases
SIMILAR = 0.8
MOST_DIFFER = 16  # of 30 min-hashes; two texts of similarity 0.8 differ in more once in 200,000 cases
EARLY_WORDS = 4
TERSE_WORDS = 6
CLOSES = 0.9  # terminality from which an unpunctuated closing word ends a sentence
HARDLY = 0.005  # terminality below which a word does not end a list entry either
SUPPORT = 20, 1e-5  # occurrences, and share of all words, from which terminality tells
OPTION_CLOSES = 0.05  # terminality from which a word ends an option of a sheet
STOCK = 0.001  # share of a word's occurrences that close unpunctuated stock answers

BLANK, COMPLETE, CUT, OPEN, LISTED, TERSE = 0, 1, 2, 3, 4, 5
"""Closings: nothing readable; ended; marked as cut; unpunctuated; unpunctuated by design; a terse answer."""

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_TAIL = re.compile(r"(?:</?[A-Za-z!][^<>]*>|[\s​‌‍﻿]|&nbsp;)+$")
_RULE = re.compile(r"\n[ \t]*(?:-{3,}|\*{3,}|_{3,})$")
_NOTE = re.compile(r"\s*[（(][^（()）\s]{1,6}[）)]$")
_MARK = re.compile(r"(?:\[(?:truncated|cut off|continued|…|\.\.\.)\]|…|\.\.\.|�|\\(?:u[0-9a-fA-F]{0,3})?|&#?[A-Za-z0-9]{0,7})$", re.I)
_ENUM = re.compile(r"^[ \t>]*(?:\d+[.)]|[-*•])$")
_CLOSER = re.compile(r"[\s*_`\"'”’»)\]}」』）]+$")
_DONE = re.compile(r"(?:\\boxed\{[^{}]*\}\$?|\]\([^()\s]*\)|```)$", re.I)
_STRAY = re.compile(r"[.!?。！？][\s\"”’»)]+\d+$")
_BULLET = re.compile(r"^[ \t>]*(?:[-*•]|\d+[.)])\s+\S")
_PAIR = re.compile(r"^[^:：.!?。]{2,40}[:：]\s*[^.!?。]{1,40}$")
_HALF = re.compile(r"\]\([^()\s]*$|\\boxed\{[^{}]*$")
_TERMINAL = ".!?。！？．｡؟"
_AFTER = np.array([ord(c) for c in _TERMINAL + "\n"], np.uint32)
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


_SPACE = " \t\r\n\f\v\u00a0\u3000\u200b\u200c\u200d\ufeff"
_REACH = 400  # how far back the patterns of a closing can reach


def closing(text: str) -> int:
    """How a text closes (BLANK, COMPLETE, CUT, OPEN, LISTED or TERSE).

    Delimiters are counted over the whole text; patterns that only concern the closing read
    its last characters.
    """
    if "<" in text:
        if not any(map(str.isalnum, _TAG.sub("", text))):
            return BLANK
    elif not any(map(str.isalnum, text)):
        return BLANK
    s = text.rstrip(_SPACE)
    tail = s[-_REACH:]
    if tail[-1:] in ">;-*_":
        tail = _TAIL.sub("", tail)
        tail = _TAIL.sub("", _RULE.sub("", tail))
    if _MARK.search(tail[-16:]) or _HALF.search(tail):
        return CUT
    if "```" in s and s.count("```") % 2:
        return CUT
    if "**" in s and s.count("**") % 2 and "```" not in s:
        return CUT
    if tail[-1:] in "`)$}" and _DONE.search(tail):
        return COMPLETE
    line = tail.rsplit("\n", 1)[-1]
    if len(line) < 12 and _ENUM.match(line) and "\n" in s:
        return CUT
    if tail[-1:] in _TERMINAL:
        return COMPLETE
    if _STRAY.search(tail[-24:]):
        return COMPLETE
    bare = tail
    if not bare[-1:].isalnum():
        bare = _CLOSER.sub("", _NOTE.sub("", bare[-80:]))
        if bare[-1:] in _TERMINAL:
            return COMPLETE
    words = len(line.split())
    if words <= TERSE_WORDS and "\n" not in s and len(s) < _REACH and len(_CJK.findall(s)) <= 8 and not any(c in s for c in _TERMINAL):
        return TERSE
    if words <= TERSE_WORDS + 1:
        if _PAIR.match(line.strip()):
            return LISTED
        if _BULLET.match(line):
            for above in reversed(s.split("\n")[:-1]):
                if above.strip() and not (_BULLET.match(above) and len(above.split()) <= TERSE_WORDS + 1):
                    return LISTED if above.rstrip(" *_")[-1:] in ":：" else OPEN
    return OPEN


_FACTS = "kind int, src string, id bigint, h1 bigint, h2 bigint, n bigint, closing int, word bigint, total bigint, closed bigint, shingles bigint, bands array<bigint>, marks array<bigint>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list[int]] = {}
    for b in batches:
        col = kernels.string_array(b.column(2))
        pre = kernels.code_points(col)
        h1, h2, n = kernels.fold_hashes(col, pre)
        hashes, starts, stop, bounds, cps = kernels.words(col, pre)
        number = np.concatenate([[0], np.cumsum((cps >= 48) & (cps < 58))])
        digits = number[stop] - number[starts]
        owners, keys, marks = kernels.bands(hashes, bounds, SHINGLE, BANDS, ROWS)
        band: list[list[int] | None] = [None] * b.num_rows
        mark: list[list[int] | None] = [None] * b.num_rows
        for o, k, m in zip(owners.tolist(), keys.view(np.int64).tolist(), marks.view(np.int64).tolist(), strict=True):
            band[o], mark[o] = k, m
        sh, of = kernels.shingles(hashes, bounds, SHINGLE)
        sizes = np.bincount(of[np.unique(sh ^ kernels.mix64(of), return_index=True)[1]], minlength=b.num_rows)
        count = np.diff(bounds)
        last = np.zeros(b.num_rows, np.uint64)
        last[count > 0] = hashes[bounds[1:][count > 0] - 1]
        inner = np.ones(len(hashes), bool)
        inner[bounds[1:][count > 0] - 1] = False
        after = np.zeros(len(hashes), bool)
        after[inner] = np.isin(cps[stop[inner]], _AFTER)
        inner[stop - starts == digits] = False
        word, which = np.unique(hashes[inner], return_inverse=True)
        total = np.bincount(which, minlength=len(word))
        closed = np.bincount(which, after[inner], len(word)).astype(np.int64)
        for w, x, y in zip(word.view(np.int64).tolist(), total.tolist(), closed.tolist(), strict=True):
            got = seen.setdefault(w, [0, 0])
            got[0] += x
            got[1] += y
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), b.column(1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n),
                pa.array([closing(t) for t in col.to_pylist()], pa.int32()), pa.array(last.view(np.int64)), pa.array(count.astype(np.int64)),
                pa.array(np.zeros(b.num_rows, np.int64)), pa.array(sizes.astype(np.int64)), pa.array(band, pa.list_(pa.int64())), pa.array(mark, pa.list_(pa.int64())),
            ],
            names=[c.split()[0] for c in _FACTS.split(", ")],
        )
        if len(seen) > 200_000:
            yield _vocabulary(seen)
            seen = {}
    yield _vocabulary(seen)


def _vocabulary(seen: dict[int, list[int]]) -> pa.RecordBatch:
    n = len(seen)
    zero = pa.array(np.zeros(n, np.int64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.string()), zero, zero, zero, zero, pa.array(np.zeros(n, np.int32)), pa.array(list(seen), pa.int64()),
            pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64()), zero, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
        ],
        names=[c.split()[0] for c in _FACTS.split(", ")],
    )


def ends_early(short: str, long: str) -> bool:
    """Whether ``short`` follows ``long`` to its own end while ``long`` goes on."""
    return bool(_early_pairs(pa.array([short], pa.string()), pa.array([long], pa.string()))[0])


def _early_pairs(short: pa.Array, long: pa.Array) -> np.ndarray:
    """:func:`ends_early` of each pair: similarity ``SIMILAR`` of their five-word
    shingles, and an alignment of all their words that ends early."""
    n = len(short)
    x, bx = kernels.word_hashes(short)
    y, by = kernels.word_hashes(long)
    (sx, ox), (sy, oy) = kernels.shingles(x, bx, SHINGLE), kernels.shingles(y, by, SHINGLE)
    # one key for a shingle of a pair; the odd multiplier keeps pairs apart
    kx, ky = (np.unique(s ^ kernels.mix64(o.astype(np.uint64) + np.uint64(1)), return_index=True) for s, o in ((sx, ox), (sy, oy)))
    mine, theirs = np.bincount(ox[kx[1]], minlength=n), np.bincount(oy[ky[1]], minlength=n)
    both = np.bincount(ox[kx[1][np.isin(kx[0], ky[0])]], minlength=n)
    ok = (mine > 0) & (both >= SIMILAR * (mine + theirs - both)) & (np.diff(by) - np.diff(bx) >= EARLY_WORDS)
    for i in np.flatnonzero(ok).tolist():
        ok[i] = _stops_inside(x[bx[i] : bx[i + 1]].tolist(), y[by[i] : by[i + 1]].tolist())
    return ok


def _stops_inside(x: list[int], y: list[int]) -> bool:
    """Whether an alignment of the words of ``x`` with those of ``y`` reaches the end of ``x``
    (its last word, which may be a piece, aside) and leaves ``EARLY_WORDS`` of ``y``.

    Runs of three words that occur once in either text are anchors; the longest chain of
    anchors in the same order in both is the alignment, and it is walked on from its last.
    """
    where: dict[tuple[int, ...], int] = {}
    for j in range(len(y) - 2):
        k = (y[j], y[j + 1], y[j + 2])
        where[k] = -1 if k in where else j
    seen: dict[tuple[int, ...], int] = {}
    for i in range(len(x) - 2):
        k = (x[i], x[i + 1], x[i + 2])
        seen[k] = -1 if k in seen else i
    tails: list[int] = []  # smallest end of a chain of each length
    last: list[int] = []
    for k, i in seen.items():
        j = where.get(k, -1)
        if i >= 0 and j >= 0:
            at = bisect.bisect_left(tails, j)
            if at == len(tails):
                tails.append(j)
                last.append(i)
            else:
                tails[at], last[at] = j, i
    if not tails:
        return False
    i, j = last[-1] + 3, tails[-1] + 3
    while i < len(x) and j < len(y) and (x[i] == y[j] or (i + 1 < len(x) and j + 1 < len(y) and x[i + 1] == y[j + 1])):
        i, j = i + 1, j + 1
    return len(x) - i <= 1 and len(y) - j - (len(x) - i) >= EARLY_WORDS


_PAIRS = "src string, id bigint, src2 string, id2 bigint"


def _mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (shorter, longer) of texts that share a band and may reach the similarity by
    their numbers of shingles and their min-hashes; rows come sorted by band key and size."""
    now, window = None, []
    for b in batches:
        key = b.column(0).to_numpy()
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        alone = ~same
        alone[:-1] &= ~same[1:]
        alone[:1] = alone[-1:] = False  # these may go on in the batch before or after
        some = b.take(pa.array(np.flatnonzero(~alone)))
        found = []
        for k, size, n, m1, m2, src, i in zip(*[c.to_pylist() for c in some.columns], strict=True):
            if k != now:
                now, window = k, []
            least = SIMILAR * size - 1e-6
            if window and window[0][0] < least:
                window = [y for y in window if y[0] >= least]
            for _, n2, o1, o2, src2, i2 in window:
                if n != n2 and _differ(m1 ^ o1) + _differ(m2 ^ o2) <= MOST_DIFFER:
                    found.append((src, i, src2, i2) if n < n2 else (src2, i2, src, i))
            window.append((size, n, m1, m2, src, i))
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=[c.split()[0] for c in _PAIRS.split(", ")])


def _differ(x: int) -> int:
    """How many groups of four bits are not zero."""
    x |= x >> 1
    x |= x >> 2
    return (x & 0x1111111111111111).bit_count()


def _early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        short, long = kernels.string_array(b.column(0)), kernels.string_array(b.column(1))
        h1, h2, n = kernels.fold_hashes(short.filter(pa.array(_early_pairs(short, long))))
        yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n)], names=["h1", "h2", "n"])


def facts(texts: DataFrame) -> DataFrame:
    """One scan of ``texts`` (src, id, text): what the other steps need, written once."""
    prepare(texts.sparkSession)
    return written(texts.select("src", F.col("id").cast("bigint").alias("id"), "text").filter("id is not null and text is not null").mapInArrow(_read, _FACTS))


def early_copies(texts: DataFrame, read: DataFrame) -> DataFrame:
    """(h1, h2, n) of distinct texts that a longer near-copy continues."""
    distinct = read.filter("kind = 0 and bands is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("src", "id")).alias("r"), F.max("shingles").alias("size"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    banded = distinct.select(F.explode("bands").alias("key"), F.col("size").cast("int").alias("size"), F.col("n").cast("int").alias("n"), F.col("marks")[0].alias("m1"), F.col("marks")[1].alias("m2"), "r.src", "r.id")
    pairs = banded.repartition("key").sortWithinPartitions("key", "size").mapInArrow(_mates, _PAIRS).distinct().select(F.struct("src", "id").alias("r"), F.struct("src2", "id2").alias("q"))
    pairs = written(pairs)
    body = texts.select("src", F.col("id").cast("bigint").alias("id"), "text")
    both = pairs.join(body.select(F.struct("src", "id").alias("r"), F.col("text").alias("short")), "r").join(body.select(F.struct(F.col("src").alias("src2"), F.col("id").alias("id2")).alias("q"), F.col("text").alias("long")), "q")
    return both.select("short", "long").mapInArrow(_early, "h1 bigint, h2 bigint, n bigint").distinct()


def cut_texts(texts: DataFrame) -> DataFrame:
    """(src, id, verdict, terminality): every row with a readable text, and whether it is cut.

    ``texts`` has src, id and text. ``verdict`` is ``whole``, ``cut-mark``, ``cut-open`` or
    ``cut-copy`` (a longer near-copy goes on); ``terminality`` is the share of the closing
    word's occurrences inside texts that end a sentence or line, null if it has none. Null
    ids and null or unreadable texts have no row; an empty table gives none.
    """
    read = facts(texts)
    rows = read.filter(f"kind = 0 and closing <> {BLANK}")
    vocabulary = read.filter("kind = 1").groupBy("word").agg(F.sum("total").alias("seen"), F.sum("closed").alias("closed"))
    groups = rows.groupBy("h1", "h2", "n").agg(
        F.max(F.col("closing").isin(COMPLETE, TERSE).cast("int")).alias("whole"), F.max((F.col("closing") == CUT).cast("int")).alias("marked"),
        F.max((F.col("closing") == LISTED).cast("int")).alias("listed"), F.min("word").alias("word"), F.count("*").alias("rows"),
    )
    early = early_copies(texts, read)
    stock = groups.filter("listed = 1").groupBy("word").agg(F.sum("rows").alias("stock"))
    whole = vocabulary.agg(F.sum("seen").alias("words"))
    vocabulary = vocabulary.join(stock, "word", "left").join(F.broadcast(whole))
    share = F.col("closed") / F.col("seen")
    known = F.coalesce(F.col("seen") >= F.greatest(F.lit(SUPPORT[0]), SUPPORT[1] * F.col("words")), F.lit(False))
    stuck = known & (share < HARDLY) & (F.coalesce("stock", F.lit(0)) < STOCK * F.col("seen"))
    open_ = F.when(F.col("listed") == 1, stuck).otherwise(~known | (share < CLOSES))
    unsure = groups.filter("whole = 0 and marked = 0").join(vocabulary, "word", "left").select("h1", "h2", "n", open_.alias("open"), share.alias("terminality"))
    # whole texts without a longer copy need no join; only what is suspicious is matched back
    suspect = unsure.select("h1", "h2", "n", "open", "terminality", F.lit(False).alias("early")).unionByName(
        early.select("h1", "h2", "n", F.lit(False).alias("open"), F.lit(None).cast("double").alias("terminality"), F.lit(True).alias("early"))
    )
    suspect = suspect.groupBy("h1", "h2", "n").agg(F.max("open").alias("open"), F.max("terminality").alias("terminality"), F.max("early").alias("early"))
    marked = F.col("closing") == CUT
    return rows.join(suspect, ["h1", "h2", "n"], "left").select(
        "src", "id",
        F.when(F.coalesce("early", F.lit(False)), "cut-copy").when(marked, "cut-mark").when(F.coalesce("open", F.lit(False)), "cut-open").otherwise("whole").alias("verdict"),
        "terminality",
    )


# --- answer sheets -------------------------------------------------------------------------

_ITEM = re.compile(r"^\W*(\d{1,4})\W+(.*)$")
_LISTED = re.compile(r"^[ \t]*(\d{1,4})[.):\]]?[ \t]+\S")


def _listed(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """The readable lines of a sheet, and number and option of those that answer an item."""
    lines = [x for x in text.rstrip(_SPACE).split("\n") if any(map(str.isalnum, _TAG.sub("", x) if "<" in x else x))]
    return lines, [(int(m[1]), _PUNCTUATION.sub(" ", m[2]).strip().casefold()) for m in map(_ITEM.match, lines) if m]


def sheet_state(prompt: str | None, response: str | None) -> tuple[bool | None, str | None]:
    """Whether an answer sheet stops before its list does, as (cut, word): None and None if
    nothing is readable; None and a word if the terminality of that last word decides.

    The sheet is aligned with the numbered lines of its prompt: it is cut if the answered
    numbers are exactly a leading part of the prompt's, or if its last line is a bare number.
    Skipped lines elsewhere are no cut. A response that answers no line is judged as a text by
    its closing (an unpunctuated one is then cut).
    """
    text = response or ""
    how = closing(text)
    if how == BLANK:
        return None, None
    asked = [int(m[1]) for m in map(_LISTED.match, (prompt or "").split("\n")) if m]
    lines, got = _listed(text)
    options = {o for _, o in got}
    if not asked or len(got) < 2 or sum(map(len, options)) > 40 * len(options):
        return how in (CUT, OPEN), None
    last = lines[-1]
    if _ITEM.match(last) or _BARE.fullmatch(last):
        option = got[-1][1] if _ITEM.match(last) else ""
        if not option:
            return True, None
        answered = {q for q, _ in got}
        missing = [q not in answered for q in asked]
        if any(missing) and missing == sorted(missing):
            return True, None
        if how == CUT and _MARK.search(text.rstrip(_SPACE)[-16:]):
            return True, None
        return None, option.rsplit(" ", 1)[-1]
    if how == CUT:
        return True, None
    # a closing line after the answers: whole, unless the line itself breaks off
    return how == OPEN and not (last.rstrip().endswith((")", ".")) or all(q in {a for a, _ in got} for q in asked)), None


_PUNCTUATION = re.compile(r"\W+")
_BARE = re.compile(r"\W*\d{1,4}\W*")
_SHEETS = "kind int, id bigint, cut boolean, word string, total bigint, closed bigint"
_SHEET_NAMES = [c.split()[0] for c in _SHEETS.split(", ")]


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per sheet (kind 0), and for each word of the options how often it occurs in
    lines before a sheet's last and how often it closes them (kind 1)."""
    seen: dict[str, list[int]] = {}
    for b in batches:
        prompts, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
        got = [sheet_state(p, t) for p, t in zip(prompts, texts, strict=True)]
        options = Counter(o for t in texts for _, o in _listed(t or "")[1][:-1])
        for o, n in options.items():
            words = o.split(" ")
            for w in words:
                seen.setdefault(w, [0, 0])[0] += n
            seen[words[-1]][1] += n
        n, none = b.num_rows, pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), b.column(0), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.string()), none, none], names=_SHEET_NAMES)
        if len(seen) > 200_000:
            yield _options(seen)
            seen = {}
    yield _options(seen)


def _options(seen: dict[str, list[int]]) -> pa.RecordBatch:
    n = len(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())],
        names=_SHEET_NAMES,
    )


def cut_sheets(sheets: DataFrame, id_col: str = "sheet_id", prompt: str = "forcing_prompt", text: str = "response_text") -> DataFrame:
    """(id, cut) of every answer sheet with a readable response; rows of null ids are left out.

    A last line is whole if its closing word closes ``OPTION_CLOSES`` of its occurrences, and
    at least two of them, in the lines before the last of all sheets.
    """
    prepare(sheets.sparkSession)
    src = sheets.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{prompt}`"), F.col(f"`{text}`")).filter(f"id is not null and `{text}` is not null")
    read = written(src.mapInArrow(_sheets, _SHEETS))
    words = read.filter("kind = 1").groupBy("word").agg(F.sum("total").alias("total"), F.sum("closed").alias("closed"))
    closes = words.filter((F.col("closed") >= 2) & (F.col("closed") >= OPTION_CLOSES * F.col("total"))).select("word", F.lit(True).alias("closes"))
    rows = read.filter("kind = 0 and (cut is not null or word is not null)")
    return rows.join(closes, "word", "left").select("id", F.coalesce("cut", F.col("closes").isNull()).alias("cut"))


def cut_records(scored: DataFrame, sheets: DataFrame) -> DataFrame:
    """(src, id, model, channel, verdict, cut): all records with readable text, cut by whatever cause.

    ``verdict`` is that of :func:`cut_texts`, ``cut-list`` for a sheet that stops before its
    list, or ``cut-budget`` where ``tokens_out`` reached ``max_tokens`` and the text shows
    nothing: such a record is cut however it ends.
    """
    full = F.coalesce(F.col("tokens_out") >= F.col("max_tokens"), F.lit(False))
    a = cut_texts(scored.select(F.lit("scored").alias("src"), F.col("record_id").alias("id"), F.col("response_text").alias("text"))).select("id", "verdict")
    a = scored.select(F.col("record_id").cast("bigint").alias("id"), "model", "channel", full.alias("full")).join(a, "id").withColumn("src", F.lit("scored"))
    b = cut_sheets(sheets).select("id", F.when(F.col("cut"), "cut-list").otherwise("whole").alias("verdict"))
    b = sheets.select(F.col("sheet_id").cast("bigint").alias("id"), "model", "channel", full.alias("full")).join(b, "id").withColumn("src", F.lit("sheets"))
    verdict = F.when((F.col("verdict") == "whole") & F.col("full"), "cut-budget").otherwise(F.col("verdict"))
    return a.unionByName(b).select("src", "id", "model", "channel", verdict.alias("verdict")).withColumn("cut", F.col("verdict") != "whole")


def cut_shares(records: DataFrame) -> DataFrame:
    """(src, model, channel, records, cut, share): how often each source truncates."""
    return records.groupBy("src", "model", "channel").agg(F.count("*").alias("records"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"))
