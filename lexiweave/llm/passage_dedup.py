"""Near-duplicate passages over compact windows.

A text is its sequence of 5-word shingles. For each of six hash functions the Cartesian tree over the hashed
sequence has a node for each minimum, whose compact window (l, c, r) says that every passage inside [l, r] that holds c has
its minimum at c. Only nodes whose window holds a passage of `WIDTH` shingles (50 words) matter, so only these are built:
from the bottom, by minima over stretches of doubling length. Windows of two functions are intersected (interval join inside the
text) to runs of starts with one signature, the two minima: equal passages share all three pairs of functions, passages of
similarity 0.8 at least one with a chance of 95 % for each place they are laid side by side.

Runs of equal signature and equal content are linked to the first of them, inside a block of texts before the shuffle and again
after it. What is left of a signature are runs of different content; they are laid side by side at their minima and compared
on the shingles themselves: few of them pair by pair, many of them by the 41 shingles that two similar passages
of 46 have in common (a word changed, put in or left out spoils 4 or 5 in a row), each group of equal ones linked to its first;
keys with a shingle that stands nowhere else in the signature, or that would tell nothing new, are not made. A
signature with more runs than a task should hold sends these keys through a shuffle of their own. So a group of any size is
linked in linear time, and no link hangs on which text happens to be first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, checkpoint, release, table, utf8
from .components import connected_components, forest

WORDS, SHINGLE, SIMILAR = 50, 5, 0.8
WIDTH = WORDS - SHINGLE + 1
#: Shingles that two similar passages of WIDTH have in common, and their gaps: a word changed or put in (5), left out (4).
COMMON = int(np.ceil(2 * WIDTH * SIMILAR / (1 + SIMILAR)))
GAPS = (WIDTH - COMMON - 1, WIDTH - COMMON)
PAIRS = ((0, 1), (2, 3), (4, 5))
SEEDS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(6))
SLICE, BLOCK = 1 << 20, 300_000
#: Shingles on either side of an anchor that a passage with it may hold.
SIDE = WIDTH - 1
#: Runs of a signature laid out together with others', and held by one task. Results do not hang on them.
FEW, MANY = 24, 20_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of stretches as polynomials modulo 2**64, from sums from the left; powers of the base are kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            of = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)])
            up, down = of(self.base), of(self.inverse)
            if n > 4 * SLICE:  # a giant's powers are not kept
                return up, down
            self.up, self.down = up, down
        return self.up, self.down

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums from the left along the last axis, a zero first."""
        out = np.zeros((*x.shape[:-1], x.shape[-1] + 1), np.uint64)
        np.cumsum(x * self.powers(x.shape[-1])[0][: x.shape[-1]], axis=-1, out=out[..., 1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.powers(len(sums))[1][start]


BYTES, RUNS = Rolling(0xD1342543DE82EF95), Rolling(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE bytes that end at white space."""
    at = 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield at, min(end, len(data))
        at = end


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of all texts (A-Z lower-cased, ASCII white space), and the number of each text's."""
    data = b"\n".join(texts).lower()
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for s, e in _slices(data):
        b = np.frombuffer(data, np.uint8, e - s, s)
        edge = np.diff((~_SPACE[b]).view(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes.append(BYTES.between(BYTES.sums(b.astype(np.uint64) + np.uint64(1)), first, last))
        at.append(first + s)
    h, words = _mix(np.concatenate(hashes), 3), np.bincount(np.searchsorted(ends, np.concatenate(at), "right"), minlength=len(texts))
    n = np.maximum(words - SHINGLE + 1, 0)
    if len(h) < SHINGLE:
        return np.empty(0, np.uint64), n
    out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        out = out * np.uint64(0x100000001B3) + h[i : i + len(out)]
    owner = np.repeat(np.arange(len(texts)), words)
    return _mix(out[owner[SHINGLE - 1 :] == owner[: len(out)]], 7), n


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) minimum of each stretch of the width: the node of the Cartesian tree that it hangs under."""
    bits = np.uint64(max(20, int(len(h)).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def signatures(x: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Runs of two minima in all texts, for each pair of functions: signature, content, text, anchor, first and last start (places in x)."""
    empty = tuple(np.empty(0, np.uint64 if k < 2 else np.int64) for k in range(6))
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(x) < width:
        return empty
    valid = owner[width - 1 :] == owner[: len(x) - width + 1]
    if not valid.any():
        return empty
    one = []
    for seed in SEEDS:
        h = _mix(x, seed)
        one.append((h, minima(h, width)))
    sums, out = RUNS.sums(x), []
    text = np.diff(owner[: len(valid)], prepend=-1) != 0
    for k, (i, j) in enumerate(PAIRS):
        (hi, ci), (hj, cj) = one[i], one[j]
        cut = text | (np.diff(ci, prepend=-1) != 0) | (np.diff(cj, prepend=-1) != 0)
        first = np.flatnonzero(cut & valid)
        stop = np.flatnonzero(np.append(cut | ~valid, True))
        last = stop[np.searchsorted(stop, first, "right")] - 1
        a, b = ci[first], cj[first]
        anchor = np.minimum(a, b)
        content = _mix(RUNS.between(sums, first, last + width) + (anchor - first).astype(np.uint64), int(k + 21))
        out.append((_mix(hi[a] * np.uint64(3) + hj[b], k + 1), content, owner[first], anchor, first, last))
    return tuple(np.concatenate(v) for v in zip(*out))


#: A run: signature; content (32 bits); text; content (19 bits more), anchor less last and first start (6 bits each), anchor (32).
#: A link that is already known has a negative place: text, 0, other text, first and last start (31 bits each).
ROWS = "sig long, content int, node long, place long"
LINKS = "node long, other long, s int, e int"
_ROWS = pa.schema([("sig", pa.int64()), ("content", pa.int32()), ("node", pa.int64()), ("place", pa.int64())])
_LINKS = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def _table(schema: pa.Schema, *columns: np.ndarray, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + rows]), f.type) for c, f in zip(columns, schema)], schema=schema)


def _u(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64)


def _star(key: np.ndarray, node: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Rows sorted by key: where each key begins; links (node, other, s, e) of its rows to the first and of the first to another."""
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.empty(0, np.int64)
    rest = np.flatnonzero(node != node[at])
    back = at[rest]
    link = (np.r_[node[rest], node[back]], np.r_[node[back], node[rest]], np.r_[s[rest], s[back]], np.r_[e[rest], e[back]])
    first = np.ones(len(link[0]), bool)
    first[len(rest) + 1 :] = back[1:] != back[:-1]  # one link back from the first of a key
    return head, tuple(v[first] for v in link)


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a block of texts: one row a signature and content; the others of equal content as links."""
    held: list[tuple[np.ndarray, ...]] = []
    seen: set[int] = set()
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        sig, content, node, anchor, lo, hi = (np.concatenate(v) for v in zip(*held))
        held.clear()
        seen.clear()
        order = np.lexsort((node, content, sig))
        sig, content, node, anchor, lo, hi = (v[order] for v in (sig, content, node, anchor, lo, hi))
        head, (n, o, s, e) = _star(sig ^ content, node, lo, hi)
        place = (content[head] >> np.uint64(45) << np.uint64(44)) | _u(anchor[head] - hi[head]) << np.uint64(38) | _u(anchor[head] - lo[head]) << np.uint64(32) | _u(anchor[head])
        yield from _table(_ROWS, sig[head].view(np.int64), (content[head] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), node[head], place.view(np.int64))
        yield from _table(_ROWS, n, np.zeros(len(n), np.int32), o, (_u(s) << np.uint64(31) | _u(e) | np.uint64(1 << 63)).view(np.int64))

    def take(texts: list[bytes], nodes: list[int]) -> int:
        x, counts = shingles(texts)
        sig, content, text, anchor, lo, hi = signatures(x, counts)
        begin = (np.cumsum(counts) - counts)[text]
        held.append((sig, content, np.array(nodes, np.int64)[text], anchor - begin, lo - begin, hi - begin))
        return len(sig)

    for batch in batches:
        texts, nodes, chars = [], [], 0
        for text, node in zip(batch.column(0), batch.column(1).to_pylist()):
            if node in seen:
                continue
            seen.add(node)
            texts.append(text.as_py())
            nodes.append(node)
            chars += len(texts[-1])
            if chars >= SLICE:
                size += take(texts, nodes)
                texts, nodes, chars = [], [], 0
        if texts:
            size += take(texts, nodes)
        if size >= BLOCK:
            yield from flush()
            size = 0
    if held:
        yield from flush()


FOUND = "sig long, node long, other long, s int, e int"
_FOUND = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
MEMBER, KEY = -1, -2  # kinds of rows that are no links: in column s


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature, content, text: links of equal content; the first run of each content of a signature that has several
    (sig, node, its place in other, MEMBER)."""
    carry, several = None, False  # the last row's first of its content; whether its signature has had another content
    for batch in batches:
        sig, content, node, place = (c.to_numpy() for c in batch.columns)
        done = place < 0
        p = place[done].view(np.uint64)
        yield from _table(_FOUND, sig[done], sig[done], node[done], (p >> np.uint64(31) & np.uint64(0x7FFFFFFF)).astype(np.int32), (p & np.uint64(0x7FFFFFFF)).astype(np.int32))
        rows = tuple(v[~done] for v in (sig, content, node, place))
        if not len(rows[0]):
            continue
        if carry is not None:
            rows = tuple(np.r_[c, v] for c, v in zip(carry, rows))
        sig, content, node, place = rows
        p = place.view(np.uint64)
        anchor = (p & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lo, hi = anchor - (p >> np.uint64(32) & np.uint64(63)).astype(np.int64), anchor - (p >> np.uint64(38) & np.uint64(63)).astype(np.int64)
        whole = content.astype(np.int64) << 19 | (p >> np.uint64(44)).astype(np.int64)
        new = np.r_[True, sig[1:] != sig[:-1]]
        number = np.cumsum(new | np.r_[True, whole[1:] != whole[:-1]])
        head, (n, o, s, e) = _star(number, node, lo, hi)
        yield from _table(_FOUND, n, n, o, s, e)
        group = np.cumsum(new) - 1
        at = np.flatnonzero(head)
        g = group[at]
        low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, g, node[at])
        np.maximum.at(high, g, node[at])
        use = (np.bincount(g) > 1) & (low < high)
        if several:
            use[0] |= np.bincount(g)[0] > 1
        at = at[use[g]]
        yield from _table(_FOUND, sig[at], node[at], (p[at] & np.uint64((1 << 44) - 1)).astype(np.int64), np.full(len(at), MEMBER, np.int32), np.zeros(len(at), np.int32))
        end = np.flatnonzero(head)[-1]
        several = bool(use[-1] or several and group[-1] == 0)
        carry = tuple(v[end : end + 1] for v in rows)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way to their runs; copies that follow soon are left out."""
    import zstandard

    small, seen = zstandard.ZstdCompressor(level=1), set()
    for batch in batches:
        rows = []
        for text, node in zip(batch.column(0), batch.column(1).to_pylist()):
            if node not in seen:
                seen.add(node)
                rows.append((node, small.compress(text.as_py())))
        if len(seen) > 100_000:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary()))], ["node", "body"])


#: A run laid out for comparison: its place, and the shingles (24 bits) around its anchor from begin on.
WINDOWS = "sig long, node long, place long, begin int, part binary"
_WINDOWS = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("begin", pa.int32()), ("part", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts with their runs (structs of sig, place): the shingles that passages with each anchor may hold."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, nodes, runs = (batch.column(k) for k in range(3))
        size, i = np.array([zstandard.frame_content_size(t.as_py()) for t in texts]), 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), SLICE)) + i)
            x, counts = shingles([plain.decompress(t.as_py()) for t in texts[i:j]])
            ends = np.cumsum(counts)
            out: list[tuple] = []
            for k in range(i, j):
                part = x[ends[k - i] - counts[k - i] : ends[k - i]].view(np.uint8).reshape(-1, 8)[:, :3]
                node = nodes[k].as_py()
                for g, p in zip(*(runs[k].values.field(f).to_pylist() for f in (0, 1))):
                    a = p & 0xFFFFFFFF
                    begin = max(0, a - SIDE)
                    out.append((g, node, p, begin, part[begin : a + SIDE + 1].tobytes()))
                if len(out) >= 5000 or k == j - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WINDOWS)], schema=_WINDOWS)
                    out = []
            i = j


SPAN = 2 * SIDE + 1


class Laid:
    """Runs laid side by side at their anchors (column SIDE): text, place of column 0 in it, columns of the run's first and last
    start, and where the shingles begin and end."""

    def __init__(self, rows: list[tuple]):
        place, begin = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
        self.sig, self.node = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.at = (place & 0xFFFFFFFF) - SIDE
        self.first, self.last = SIDE - (place >> 32 & 63), SIDE - (place >> 38 & 63)
        self.left = begin - self.at
        sizes = np.array([len(r[4]) // 3 for r in rows], np.int64)
        self.right = self.left + sizes
        self.x = np.zeros((len(rows), SPAN), np.uint32)
        row = np.repeat(np.arange(len(rows)), sizes)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.left[row]
        b = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, 3).astype(np.uint32)
        self.x[row, col] = b[:, 0] | b[:, 1] << np.uint32(8) | b[:, 2] << np.uint32(16)


def distinct(z: np.ndarray, width: int) -> np.ndarray:
    """Different values in z[r, s : s + width] for each row r and start s: a place counts from the start past its value's last place, or its own window's first, on."""
    rows, n = z.shape
    order = np.argsort(z, axis=1, kind="stable")
    value = np.take_along_axis(z, order, 1)
    last = np.full((rows, n), -1)
    before = np.where(value[:, 1:] == value[:, :-1], order[:, :-1], -1)
    np.put_along_axis(last, order[:, 1:], before, 1)
    i = np.arange(n)
    begin = np.maximum(last + 1, i - width + 1)
    flat = np.bincount((begin + np.arange(rows)[:, None] * (n + 1)).ravel(), minlength=rows * (n + 1)).reshape(rows, n + 1)
    ends = np.zeros(n + 1, np.int64)
    ends[1:] = 1
    return np.cumsum(flat - ends, axis=1)[:, : n - width + 1]


def similar(laid: Laid, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each pair of rows, the starts (columns 0 to SIDE) at which their passages are similar: place by place, or as sets
    (words put in or left out move the rest)."""
    x, y = laid.x[p], laid.x[q]
    left, right = np.maximum(laid.left[p], laid.left[q]), np.minimum(laid.right[p], laid.right[q])
    col = np.arange(SPAN)
    same = (x == y) & (col >= left[:, None]) & (col < right[:, None])
    total = np.cumsum(np.concatenate([np.zeros((len(p), 1), np.int16), same], axis=1, dtype=np.int16), axis=1, dtype=np.int16)
    m = total[:, WIDTH:] - total[:, :-WIDTH]
    start = np.arange(m.shape[1])
    inside = (start >= left[:, None]) & (start + WIDTH <= right[:, None])
    good = (m >= SIMILAR * (2 * WIDTH - m)) & inside
    # Similar passages share a stretch in place of nearly half the width, whatever was put in or left out elsewhere.
    more = np.flatnonzero((inside & ~good & (m >= (WIDTH - GAPS[1]) // 2 - 1)).any(axis=1))
    for i in range(0, len(more), 2000):
        k = more[i : i + 2000]
        a, b = x[k], y[k]
        both = distinct(np.stack([a, b], axis=2).reshape(len(k), -1), 2 * WIDTH)[:, ::2]
        good[k] |= (distinct(a, WIDTH) + distinct(b, WIDTH) - both >= SIMILAR * both) & inside[k]
    return good


def _emit(node: np.ndarray, other: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _table(_FOUND, node, node, other, s.astype(np.int32), e.astype(np.int32))


#: What is left out of a passage's WIDTH shingles (before, after, and a gap inside) so that COMMON are left, by the length of what is left of the gap.
EDGES = [(n, WIDTH - COMMON - n) for n in range(WIDTH - COMMON + 1)]
INNER = [(n, WIDTH - COMMON - gap - n, gap) for gap in GAPS for n in range(WIDTH - COMMON - gap + 1)]


def met(laid: Laid) -> np.ndarray:
    """For each row the sums, from the left, of the shingles that stand elsewhere too in the rows of its signature: only these can be in a key that two rows share."""
    col = np.arange(SPAN)
    there = (col >= laid.left[:, None]) & (col < laid.right[:, None])
    x = _mix(laid.x.astype(np.uint64) + _mix(laid.sig.view(np.uint64), 23)[:, None], 29)[there]
    order = np.argsort(x)
    same = np.diff(x[order]) == 0
    twice = np.zeros(len(x), bool)
    twice[order] = np.r_[False, same] | np.r_[same, False]
    total = np.zeros((len(there), SPAN + 1), np.int32)
    total[:, 1:][there] = twice
    return np.cumsum(total, axis=1, out=total)


class Told:
    """What a comparison has found so far: passages that have a similar one, and rows whose signature's nodes are all linked to one another."""

    def __init__(self, laid: Laid):
        self.node, (_, self.group) = laid.node, np.unique(laid.sig, return_inverse=True)
        self.order = np.argsort(self.group, kind="stable")
        self.begin = np.flatnonzero(np.diff(self.group[self.order], prepend=-1))
        self.hit, self.linked = np.zeros((len(laid.node), SPAN - WIDTH + 1), bool), np.zeros(len(self.begin), bool)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links, and which signatures are linked with them."""
        self.links = [forest(*(np.concatenate(x) for x in zip(*self.links, (a, b))))]
        u, v = self.links[0]
        at = np.minimum(np.searchsorted(u, self.node), len(u) - 1)
        root = np.where(u[at] == self.node, v[at], self.node)[self.order]
        self.linked = np.minimum.reduceat(root, self.begin) == np.maximum.reduceat(root, self.begin)

    def open(self, row: np.ndarray, col: np.ndarray, able: np.ndarray) -> np.ndarray:
        """Passages (row, col) with which something may be found yet, if those in able have a key now: nothing where all of these are told and linked."""
        wanting = np.bincount(self.group[row[able & ~self.hit[row, col]]], minlength=len(self.begin)) > 0
        return (wanting | ~self.linked)[self.group[row]]


def common_keys(laid: Laid, total: np.ndarray | None = None, told: Told | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, row, column): hashes of COMMON shingles of each passage of a run, whatever their order, by turns of what is left out.

    Passages that share a key have COMMON shingles in common, and those that have so many share one: a word changed inside
    costs each 5 in a row; a word put in or left out, or two parts that changed places, 4 in one of them; the rest is at the ends. Only
    passages that repeat shingles of their own may have their common ones elsewhere. With total (see met) and told, keys that cannot
    be shared with another row, and those that would tell nothing new, are left out.
    """
    sums = np.zeros((len(laid.x), SPAN + 1), np.uint64)
    np.cumsum(_mix(laid.x.astype(np.uint64), 17), axis=1, out=sums[:, 1:])
    start = np.arange(SPAN - WIDTH + 1)
    inside = (start >= laid.left[:, None]) & (start + WIDTH <= laid.right[:, None])
    inside &= (start >= laid.first[:, None]) & (start <= laid.last[:, None])
    if total is not None:
        inside &= total[:, WIDTH:] - total[:, :-WIDTH] >= COMMON
    row, col = np.nonzero(inside)
    to = [sums[row, col + k] for k in range(WIDTH + 1)]
    of = None if total is None else [total[row, col + k] for k in range(WIDTH + 1)]
    sig = _mix(laid.sig.view(np.uint64), 19)[row]

    def turn(parts: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the stretches from a to b and from c to d."""
        if of is None:
            use = [np.arange(len(row))] * len(parts)
        else:
            able = [of[b] - of[a] + of[d] - of[c] == COMMON for a, b, c, d in parts]
            still = told.open(row, col, np.logical_or.reduce(able)) if told else True
            use = [np.flatnonzero(x & still) for x in able]
        keys = [to[b][k] - to[a][k] + to[d][k] - to[c][k] + sig[k] for k, (a, b, c, d) in zip(use, parts)]
        k = np.concatenate(use)
        return _mix(np.concatenate(keys), 13), row[k], col[k]

    yield turn([(before, WIDTH - after, 0, 0) for before, after in EDGES])
    for n in range(1, COMMON // 2 + 1):
        # both lengths of the first part, as parts may have changed places
        yield turn([(before, before + left, before + left + gap, WIDTH - after) for left in (n, COMMON - n) for before, after, gap in INNER])


def _shared(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key and node: where each row's key begins; whether the key has several nodes."""
    head = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(head)
    of = np.cumsum(head) - 1
    last = np.r_[at[1:], len(key)] - 1
    return at[of], (node[at] != node[last])[of]


def compare(laid: Laid) -> Iterator[pa.RecordBatch]:
    """Runs of any number of signatures by their common keys: each to the first with the key, and the passages that share one."""
    told = Told(laid)
    for key, row, col in common_keys(laid, met(laid), told):
        order = np.argsort(key)
        sorted_ = key[order]
        same = sorted_[1:] == sorted_[:-1]
        twice = np.append(same, False)
        twice[1:] |= same
        order = order[twice[: len(order)]]  # keys met twice
        if not len(order):
            continue
        order = order[np.lexsort((laid.node[row[order]], key[order]))]
        key, row, col = key[order], row[order], col[order]
        first, several = _shared(key, laid.node[row])
        told.hit[row[several], col[several]] = True
        a, b = laid.node[row[several]], laid.node[row[first[several]]]
        if (a != b).any():
            told.add(a[a != b], b[a != b])
    if told.links:
        u, v = told.links[0]
        yield from _emit(u, v, np.full(len(u), 1), np.zeros(len(u)))  # empty spans: links only
        edge = np.diff(told.hit.astype(np.int8), axis=1, prepend=0, append=0)
        (row, low), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        yield from _emit(laid.node[row], laid.node[row], laid.at[row] + low, laid.at[row] + end - 1)


def keys_out(laid: Laid) -> Iterator[pa.RecordBatch]:
    """compare(), and the keys that runs elsewhere may share, for runs that are too many for a task: key, node, start in other, KEY."""
    yield from compare(laid)
    for key, row, col in common_keys(laid):
        order = np.lexsort((col, laid.node[row], key))
        key, node, at = key[order], laid.node[row[order]], (laid.at[row] + col)[order]
        first, several = _shared(key, node)
        sent = ~several | (first == np.arange(len(key)))  # of a key that is told already, one row
        n = int(sent.sum())
        yield from _table(_FOUND, key[sent].view(np.int64), node[sent], at[sent], np.full(n, KEY, np.int32), np.zeros(n, np.int32))


def _compare(few: int, many: int):
    """few and many bound what is compared at once: runs of a signature that share an array with others', and that one task holds. No result hangs on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs sorted by signature: the links of each."""
        sig, over = None, False
        held: list[tuple] = []  # of the signature that is not yet complete
        small: list[tuple] = []  # complete signatures with few runs

        def flush() -> Iterator[pa.RecordBatch]:
            if small:
                yield from compare(Laid(small))
                small.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if over and held:
                yield from keys_out(Laid(held))
            elif len(held) > few:
                yield from compare(Laid(held))
            elif len(held) > 1:
                small.extend(held)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != sig:
                    yield from close()
                    if len(small) > 2000:
                        yield from flush()
                    held, sig, over = [], r[0], False
                held.append(r)
                if len(held) > (2000 if over else many):
                    for i in range(0, len(held), 2000):
                        yield from keys_out(Laid(held[i : i + 2000]))
                    held, over = [], True
        yield from close()
        yield from flush()

    return run


def _join_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, start) sorted by key and node: each to the first of its key, and that one to the last; nothing where a key has one node."""
    carry = None
    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        if not len(rows[0]):
            continue
        if carry is not None:
            rows = tuple(np.r_[c, v] for c, v in zip(carry, rows))
        key, node, at = rows
        first, several = _shared(key, node)
        begin = np.unique(first)
        last = (np.r_[begin[1:], len(key)] - 1)[np.searchsorted(begin, first)]
        other = np.where(node == node[first], node[last], node[first])
        yield from _table(_LINKS, node[several], other[several], at[several].astype(np.int32), at[several].astype(np.int32))
        # Of a key that may go on: its first row, or all of them while they are of one text.
        carry = tuple(v[first[-1] : first[-1] + 1 if several[-1] else None] for v in rows)


def passage_links(rows: DataFrame, few: int = FEW, many: int = MANY) -> DataFrame:
    """rows: body (binary), node; equal rows may repeat. Links: node, other, s, e (first and last start of similar passages in node;
    none where s > e, and other is node where only the span is told)."""
    made = rows.select("body", "node").mapInArrow(_make, ROWS)
    found = checkpoint(made.repartition("sig").sortWithinPartitions("sig", "content", F.shiftrightunsigned("place", 44), "node").mapInArrow(_reduce, FOUND))
    runs = found.filter(f"s = {MEMBER}").groupBy("node").agg(F.collect_set(F.struct("sig", F.col("other").alias("place"))).alias("runs"))  # as many as the text is long
    release(rows.sparkSession)
    texts = rows.select("body", "node").mapInArrow(_squeeze, "node long, body binary").groupBy("node").agg(F.first("body").alias("body"))
    with batch_rows(rows.sparkSession, 100):
        laid = texts.join(runs, "node").select("body", "node", "runs").mapInArrow(_cut, WINDOWS)
        near = laid.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_compare(few, many), FOUND)
        near = checkpoint(near)
    links = found.filter("s >= 0").union(near.filter("s >= 0")).select("node", "other", "s", "e")
    keys = near.filter(f"s = {KEY}").select("sig", "node", "other")
    if not keys.isEmpty():
        links = links.union(keys.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_join_keys, LINKS))
    return links


SPANS = "array<struct<s:int,e:int>>"


def _merged(xs: str | Column) -> Column:
    """Sorted stretches (s, e), those that meet or overlap put together."""
    return F.aggregate(
        xs,
        F.array().cast(SPANS),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, many: int = MANY) -> DataFrame:
    """One row per row of docs: doc_id, class_id, repeated, n_repeat_words, spans (first word, words).

    class_id is the smallest doc_id that shares a passage of 50 words or more, directly or through others; equal
    texts of 50 words or more are in one class. spans are the passages that have a similar one in another text, and
    n_repeat_words their words. Null, empty and short texts are in a class of their own (as are those without a repeated
    passage); repeated rows come out once each; a null doc_id counts only if its class has no other; an empty table gives no rows.
    """
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), node.alias("node"), utf8(text_col).alias("body"))
    links = checkpoint(passage_links(rows, few, many))
    flat = links.filter("s <= e").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("s", (F.col("e") + WORDS).alias("e")))).alias("xs"))  # as many as the text is long
    spans = flat.select("node", F.transform(_merged("xs"), lambda x: F.struct(x["s"].alias("start"), (x["e"] - x["s"]).alias("words"))).alias("spans"))
    parts = checkpoint(connected_components(links.select(F.col("node").alias("u"), F.col("other").alias("v"))))
    long = F.rlike(F.col("body").cast("string"), F.lit(f"^[\\x20\\x09-\\x0D]*+(?:[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]++){{{WORDS - 1}}}[^\\x20\\x09-\\x0D]"))
    ids = checkpoint(rows.select("doc_id", "node", long.alias("long")).groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.max("long").alias("long")))
    lowest = parts.join(ids, "node").groupBy("root").agg(F.min("low").alias("lowest"))
    label = ids.join(parts.join(lowest, "root").select("node", "lowest"), "node", "left").join(spans, "node", "left")
    label = checkpoint(label.select(F.col("node").alias("n"), F.when(F.col("spans").isNotNull(), F.col("lowest")).when(F.col("long"), F.col("low")).alias("class"), (F.col("spans").isNotNull() | F.col("long") & (F.col("copies") > 1)).alias("repeated"), "spans"))
    out = docs.select(F.col(id_col).alias("doc_id"), node.alias("node")).join(label, F.col("node") == F.col("n"))
    words = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,words:int>>")), F.lit(0), lambda a, x: a + x["words"])
    return out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), "repeated", words.alias("n_repeat_words"), "spans")


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
