"""Vectorised text kernels over Arrow string arrays.

Every kernel walks code points through a lookup table that says how a character folds
(letter case aside) and whether it counts at all, and folds the survivors into polynomial
hashes modulo 2**64. No canonical string is ever built. Work proceeds in blocks of a fixed
number of characters, so one very long text needs no more memory than many short ones.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 18
_TOP = 0x110000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MOD = 1 << 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (public-domain splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Tables:
    """Lookup tables over all code points, and powers of the two bases."""

    def __init__(self) -> None:
        width = np.zeros(_TOP, np.uint8)
        first = np.arange(_TOP, dtype=np.uint64)
        expand: dict[int, str] = {}
        # above the second plane everything assigned is private use, tags or variation selectors
        for lo, hi in ((0, 0x3400), (0xA000, 0xD800), (0xF900, 0x20000)):
            for cp in range(lo, hi):
                ch = chr(cp)
                if ch.isalnum():
                    f = ch.casefold()
                    width[cp] = len(f)
                    first[cp] = ord(f[0])
                    if len(f) > 1:
                        expand[cp] = f
        for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):
            width[lo:hi] = 1
        self.width = width
        self.keep = width > 0
        base = mix64(first + np.uint64(0x51ED27))
        self.vals = []
        for seed, b in enumerate(_BASES):
            v = mix64(base + np.uint64(seed * 0x1234567)) if seed else base.copy()
            v[~self.keep] = 0
            for cp, f in expand.items():
                total, p = 0, 1
                for ch in f:
                    u = int(mix64(np.array([ord(ch) + 0x51ED27], np.uint64))[0])
                    if seed:
                        u = int(mix64(np.array([(u + seed * 0x1234567) % _MOD], np.uint64))[0])
                    total, p = (total + u * p) % _MOD, p * b % _MOD
                v[cp] = total
            self.vals.append(v)
        self.compose = _uncomposed()
        self.pow, self.inv = [], []
        for b in _BASES:
            n = 3 * BLOCK + 2
            self.pow.append(_powers(b, n))
            self.inv.append(_powers(pow(b, -1, _MOD), n))


def _uncomposed() -> np.ndarray:
    """Code points that may change when a text is composed: those that do so alone, marks,
    and the second halves of composed letters and syllables."""
    out = np.zeros(_TOP, bool)
    for lo, hi in ((0x300, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20)):
        for cp in range(lo, hi):
            ch = chr(cp)
            out[cp] |= bool(unicodedata.combining(ch)) or not unicodedata.is_normalized("NFC", ch)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<":
                out[int(parts[1], 16)] = True
    out[0x1161:0x1176] = out[0x11A8:0x11C3] = True  # vowels and finals of Hangul syllables
    return out


def _powers(b: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(b)
    return np.multiply.accumulate(out, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def string_array(col) -> pa.Array:
    """One contiguous string array with 32-bit offsets; nulls become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.type != pa.string():
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def code_points(col) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts laid end to end, and the offset of each text in them.

    Letters written as a base with combining marks are composed first, so that both
    spellings of an accented letter read the same.
    """
    arr = string_array(col)
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int32, n + 1, arr.offset * 4).astype(np.int64)
    raw = bytes(bufs[2])[off[0] : off[-1]] if bufs[2] is not None else b""
    off = off - off[0]
    b = np.frombuffer(raw, np.uint8)
    if not (b & 0x80).any():
        return b.astype(np.uint32), off
    text = raw.decode("utf-8", "replace")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=lead[1:])
    if lead[-1] != len(cps):
        return _joined([s or "" for s in arr.to_pylist()])
    off = lead[off]
    # a text is composed for what it holds itself, never for its neighbours in the batch
    at = np.flatnonzero(tables().compose[cps])
    if len(at) == 0:
        return cps, off
    which = np.unique(np.searchsorted(off, at, "right") - 1)
    parts, sizes, done = [], np.diff(off), 0
    for k in which.tolist():
        part = np.frombuffer(unicodedata.normalize("NFC", arr[k].as_py()).encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [cps[done : off[k]], part]
        sizes[k], done = len(part), off[k + 1]
    return np.concatenate([*parts, cps[done:]]), np.concatenate([[0], np.cumsum(sizes)])


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unicodedata.normalize("NFC", s) for s in texts]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def fold_hashes(col, pre=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's letters and digits, and how many there are.

    Texts of equal letters and digits (case aside) hash equally whatever stands between
    them (``pre``: the code points, where they are at hand). An empty or null text, or one without letters and digits, gives (0, 0, 0).
    """
    t = tables()
    cps, off = pre or code_points(col)
    n = len(off) - 1
    h = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    length = np.zeros(n, np.int64)
    for lo in range(0, len(cps), BLOCK):
        c = cps[lo : lo + BLOCK]
        hi = lo + len(c)
        d0 = int(np.searchsorted(off, lo, "right")) - 1
        d1 = int(np.searchsorted(off, hi, "left"))
        s = np.maximum(off[d0:d1], lo) - lo
        e = np.minimum(off[d0 + 1 : d1 + 1], hi) - lo
        pos = np.zeros(len(c) + 1, np.int64)
        np.cumsum(t.width[c], out=pos[1:])
        before = length[d0]
        for k in (0, 1):
            acc = np.zeros(len(c) + 1, np.uint64)
            np.cumsum(t.vals[k][c] * t.pow[k][pos[:-1]], out=acc[1:])
            part = (acc[e] - acc[s]) * t.inv[k][pos[s]]
            if before:
                part[0] = np.uint64(int(part[0]) * pow(_BASES[k], int(before), _MOD) % _MOD)
            h[k][d0:d1] += part
        length[d0:d1] += pos[e] - pos[s]
    return h[0], h[1], length


def _folded_blocks(text: str, step: int):
    """What counts of a text, folded, block by block; a block ends before a character that
    does not combine with the one before it."""
    t = tables()
    at = 0
    while at < len(text):
        end = min(at + step, len(text))
        while end < len(text) and t.compose[ord(text[end])]:
            end += 1
        piece = text[at:end]
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        at = end
        block = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        kept = block[t.keep[block]]
        if (t.width[kept] > 1).any():
            kept = np.frombuffer("".join(map(chr, kept)).casefold().encode("utf-32-le"), np.uint32)
        yield t.vals[0][kept]


def same_folded(a: str | None, b: str | None, step: int = 4096) -> bool:
    """Whether two texts agree in their letters and digits, by two pointers that skip the rest.

    Each pointer advances over a block, drops what does not count and compares what both
    sides have; neither text is ever folded as a whole.
    """
    sides = [_folded_blocks(s or "", step) for s in (a, b)]
    rest = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    while True:
        for k in (0, 1):
            while len(rest[k]) == 0:
                more = next(sides[k], None)
                if more is None:
                    break
                rest[k] = more
        n = min(len(rest[0]), len(rest[1]))
        if n == 0:
            return len(rest[0]) == len(rest[1])
        if not np.array_equal(rest[0][:n], rest[1][:n]):
            return False
        rest = [rest[0][n:], rest[1][n:]]


def fold_digest(text: str | None, step: int = 1 << 16) -> int:
    """A third hash of a text's letters and digits, not polynomial, streamed block by block."""
    h = xxhash.xxh3_64()
    for block in _folded_blocks(text or "", step):
        h.update(block.tobytes())
    return h.intdigest()


def words(col, pre=None, each_sign: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits, case aside) of all texts: their 64-bit hashes, first
    and past-last character, and per text the number of words before it; and the code points.
    A word that goes on in the next block is carried over, so blocks do not show. With
    ``each_sign`` every sign of a script without spaces (Han, kana) is a word of its own."""
    t = tables()
    cps, off = pre or code_points(col)
    sums, widths, starts, stops = [], [], [], []
    for lo in range(0, len(cps), BLOCK):
        c = cps[lo : lo + BLOCK]
        hi = lo + len(c)
        keep = t.keep[c]
        inner = off[(off > lo) & (off < hi)] - lo
        start = keep.copy()
        start[1:] &= ~keep[:-1]
        start[inner] = keep[inner]
        stop = keep.copy()
        stop[:-1] &= ~keep[1:]
        stop[inner - 1] = keep[inner - 1]
        if each_sign:
            sign = keep & _signs(c)
            start |= sign
            stop |= sign
            start[1:] |= keep[1:] & sign[:-1]
            stop[:-1] |= keep[:-1] & sign[1:]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        pos = np.zeros(len(c) + 1, np.int64)
        np.cumsum(t.width[c], out=pos[1:])
        acc = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(t.vals[0][c] * t.pow[0][pos[:-1]], out=acc[1:])
        sums.append((acc[e] - acc[s]) * t.inv[0][pos[s]])
        widths.append(pos[e] - pos[s])
        starts.append(s + lo)
        stops.append(e + lo)
    if not sums:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64), cps
    total, width, at, end = map(np.concatenate, (sums, widths, starts, stops))
    edge = np.flatnonzero((at[1:] == end[:-1]) & (at[1:] % BLOCK == 0)) + 1
    if len(edge):
        edge = edge[off[np.minimum(np.searchsorted(off, at[edge]), len(off) - 1)] != at[edge]]
    if len(edge) and each_sign:
        edge = edge[~_signs(cps[at[edge]]) & ~_signs(cps[at[edge] - 1])]
    if len(edge):
        whole = np.ones(len(at), bool)
        head = -1
        for k in edge.tolist():
            head = head if not whole[k - 1] else k - 1
            total[head] = np.uint64((int(total[head]) + int(total[k]) * pow(_BASES[0], int(width[head]), _MOD)) % _MOD)
            width[head] += width[k]
            end[head] = end[k]
            whole[k] = False
        total, width, at, end = total[whole], width[whole], at[whole], end[whole]
    hashes = mix64(total + width.astype(np.uint64))
    return hashes, at, end, np.searchsorted(at, off, "left"), cps


def _signs(cps: np.ndarray) -> np.ndarray:
    return ((cps >= 0x3040) & (cps < 0x3100)) | ((cps >= 0x3400) & (cps < 0xA000)) | (cps >= 0x20000)


def word_hashes(col, each_sign: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, the number of words before it."""
    got = words(col, each_sign=each_sign)
    return got[0], got[3]


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the owner of each."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.flatnonzero(np.arange(len(hashes)) + size <= end)
    h = np.full(len(at), size, np.uint64)
    for o in range(size):
        h = (h ^ hashes[at + o]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h, np.searchsorted(bounds, at, "right") - 1


def bands(hashes: np.ndarray, bounds: np.ndarray, size: int, n_bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-hash band keys of each text with a shingle: (texts, band keys of shape (len,
    n_bands), and four bits of each min-hash, sixteen to an integer)."""
    h, owner = shingles(hashes, bounds, size)
    marks = -(-n_bands * rows // 16)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, n_bands), np.uint64), np.zeros((0, marks), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out, mark = np.zeros((len(first), n_bands), np.uint64), np.zeros((len(first), marks), np.uint64)
    for k in range(n_bands):
        acc = np.full(len(first), k + 1, np.uint64)
        for r in range(rows):
            i = k * rows + r
            x = (h ^ np.uint64((i * 0x9E3779B97F4A7C15 + 0x1B873593) % _MOD)) * np.uint64((i * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) % _MOD | 1)
            least = np.minimum.reduceat(x, first)
            mark[:, i // 16] |= (mix64(least) >> np.uint64(60)) << np.uint64(4 * (i % 16))
            acc = (acc ^ least) * np.uint64(0x9FB21C651E98DF25)
            acc ^= acc >> np.uint64(28)
        out[:, k] = acc
    return owner[first], out, mark
