"""Removal of repeated substrings by a hash-compared suffix sort.

A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document with a smaller
id, or earlier in the same one. Strings are judged on the input and never cross documents.

Only suffixes that can be equal over `length` bytes need to meet. Each window of `length` bytes picks as
anchor its `anchor`-byte substring of least hash (leftmost of equals), a choice its content alone decides, so
equal windows have equal anchors. Windows side by side with one anchor form a segment; a text of n
bytes has some 2n / (length - anchor) of them, and only (anchor, segment hash, place) are shuffled.

- A segment whose content was seen earlier goes whole; its first occurrence stays for now. Within what a task reads
  together the bytes are compared; across tasks 112 bits of hash decide, of strings under 256 bytes.
- An anchor under which there is one segment content only is done with. What is left, the borders of
  repeated passages, has its bytes fetched (from the exchange of texts that every step shares) and its
  suffixes sorted, bucket by bucket of the anchor.

The sort is a mergesort, vectorised over all suffixes of a batch. Prefix polynomial hashes modulo
2**64 tell whether two suffixes agree on their first m bytes; a binary search over m finds the longest
common extension, so a comparison takes log2(length) steps. Neighbours that the hashes call equal over
`length` bytes are verified byte by byte, and false ones are told apart.

Hot content: copies within some 8 MB are settled where they are read, so that a passage in every document
sends a row per task. An anchor with more than `hot` contents has its windows sent one by one, to the
bucket of their own hash. No step holds a whole group of copies in memory.

Ids are integers. Defined results: null counts as the empty text, which has nothing to remove; a null id counts as the
smallest; rows with one id follow each other in the order of their texts' hashes (they are numbered first, by ranges of id and
hash, so that an id that many rows share is no hot key), so the later of two equal
rows goes whole if it is long enough; an empty table gives an empty result; columns other than the two
named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, mix64, numbered, powers, prefix_hash, ship, table, text_buffers

LENGTH = 100
ANCHOR = 32
HOT = 4096
#: Bytes of a document above which its windows are scanned in several runs.
LONG_BYTES = 4 << 20
_NONE = -(1 << 63)
_LOW = np.uint64(0xFFFF)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, start, windows, k1, k2) of each segment.

    k1: 48 bits of the anchor's hash, then 8 of its place in the segment and 8 of the number of windows;
    k2: hash of the segment.
    """
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 0)
    total = int(count.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    inverse = powers(len(prefix))[1]
    grams = mix64((prefix[anchor:] - prefix[:-anchor]) * inverse[: len(prefix) - anchor])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - anchor + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(count) - count), count)
    pick = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(total, bool)
    first[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    i = np.flatnonzero(first)
    windows = np.diff(np.append(i, total))
    start, place = at[i], pick[i]
    k1 = (grams[place] & ~_LOW) | ((place - start).astype(np.uint64) << np.uint64(8)) | windows.astype(np.uint64)
    k2 = mix64((prefix[start + windows + length - 1] - prefix[start]) * inverse[start])
    return row[i], start - offsets[row[i]], windows, k1, k2


def _pack(rn: np.ndarray, pos: np.ndarray, windows: np.ndarray, flag: np.ndarray | int) -> np.ndarray:
    return (rn << 40) | (pos << 8) | (windows << 1) | flag


def _unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return loc >> 40, (loc >> 8) & 0xFFFFFFFF, (loc >> 1) & 0x7F, loc & 1


def _leaders(*keys: np.ndarray) -> np.ndarray:
    """For each row the first one with its keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.zeros(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0  # lexsort is stable
    return out


def _copies(data: np.ndarray, start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a string (start, size in data) has the keys and, byte by byte, the content of an earlier one: the first with its keys."""
    lead = _leaders(*keys)
    out = lead != np.arange(len(lead))
    i = np.flatnonzero(out)
    out[i] = size[i] == size[lead[i]]
    i = np.flatnonzero(out)
    ends = np.cumsum(size[i])
    a = 0
    while a < len(i):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (4 << 20), side="right")))
        n = size[i[a:b]]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        same = data[np.repeat(start[i[a:b]], n) + step] == data[np.repeat(start[lead[i[a:b]]], n) + step]
        out[i[a:b]] = np.logical_and.reduceat(same, first)
        a = b
    return out


class Suffixes:
    """Suffixes of a byte string, compared over their first `length` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length = data, length
        self.prefix = prefix_hash(data)
        self.power = powers(len(self.prefix))[0]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension, at most `length`: the largest m whose hashes agree."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        hx, hy, px, py = self.prefix[x], self.prefix[y], self.power[x], self.power[y]
        for _ in range(int(self.length).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[x + mid] - hx) * py == (self.prefix[y + mid] - hy) * px
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where or_equal."""
        m = self.common(x, y)
        full = m >= self.length
        at = np.where(full, 0, m)
        return np.where(full, or_equal, self.data[x + at] < self.data[y + at])

    def sort(self, position: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each run of equal group (groups stay where they are); stable.

        Bottom-up mergesort: the place of an element in a merged run is its place in its own run plus the
        number of elements before it in the other one, found by binary search.
        """
        n = len(position)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        begin, size = np.repeat(begin, size), np.repeat(size, size)
        current, width, most = np.arange(n), 1, int(size.max(initial=0))
        rank = np.arange(n) - begin
        while width < most:
            run = rank // width
            other = begin + (run ^ 1) * width
            stop = np.minimum(other + width, begin + size)
            i = np.flatnonzero(other < begin + size)
            low, high = other[i].copy(), stop[i].copy()
            mine, right = position[current[i]], (run[i] & 1) == 1
            open_ = np.arange(len(i))
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                before = self.below(position[current[mid]], mine[open_], right[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            slot = np.arange(n)
            slot[i] = begin[i] + (run[i] // 2) * 2 * width + (rank[i] - run[i] * width) + (low - other[i])
            merged = np.empty_like(current)
            merged[slot] = current
            current, width = merged, 2 * width
        return current

    def verified(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves are equal."""
        out = np.ones(len(x), bool)
        step = np.arange(self.length)
        for i in range(0, len(x), 1 << 14):
            out[i : i + (1 << 14)] = (self.data[x[i : i + (1 << 14), None] + step] == self.data[y[i : i + (1 << 14), None] + step]).all(axis=1)
        return out


def repeated(suffixes: Suffixes, position: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether an earlier element of the same group (they come in order) has the same first bytes."""
    order = suffixes.sort(position, group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    equal = np.zeros(len(order), bool)
    m = suffixes.common(position[a[near]], position[b[near]])
    near = near[m >= suffixes.length]
    good = suffixes.verified(position[a[near]], position[b[near]])
    equal[near[good] + 1] = True
    # a hash collision breaks a run of equals: its members are compared with every class head of the run
    for k in near[~good]:
        _repair(suffixes, position, group, order, equal, int(k))
    out = np.zeros(len(order), bool)
    out[order[equal]] = True
    return out


def _repair(suffixes: Suffixes, position: np.ndarray, group: np.ndarray, order: np.ndarray, equal: np.ndarray, k: int) -> None:
    a = b = k
    while a > 0 and group[order[a - 1]] == group[order[a]] and suffixes.common(position[order[a - 1 : a]], position[order[a : a + 1]])[0] >= suffixes.length:
        a -= 1
    while b + 1 < len(order) and group[order[b + 1]] == group[order[b]] and suffixes.common(position[order[b : b + 1]], position[order[b + 1 : b + 2]])[0] >= suffixes.length:
        b += 1
    seen: set[bytes] = set()
    for j in range(a, b + 1):
        p = position[order[j]]
        content = suffixes.data[p : p + suffixes.length].tobytes()
        equal[j] = content in seen
        seen.add(content)


def _rows(schema: list[str], *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=schema)


def _longs(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _scan(length: int, anchor: int):
    """Texts in order -> (k1, k2, did, loc) of their segments; loc's flag marks copies settled here."""
    names = ["k1", "k2", "did", "loc"]

    def settle(held: list[tuple[np.ndarray, ...]], texts: list[np.ndarray]) -> pa.RecordBatch:
        did, loc, k1, k2, start, size = (np.concatenate(x) for x in zip(*held))
        copy = _copies(np.concatenate(texts), start, size, k1, k2)
        k1 = np.where(copy, mix64(k1 + _mixed(did, loc)), k1)  # copies go anywhere
        return _rows(names, _longs(k1), _longs(k2), did, loc | copy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for b in batches:
            did, rn = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            data, offsets = text_buffers(b.column(2))
            for i, j in chunks(offsets, CHUNK_BYTES // 2):
                # a long document is cut into runs of windows; where segments are cut doesn't matter to the result
                whole = int(offsets[j] - offsets[i])
                step = LONG_BYTES if j == i + 1 and whole > LONG_BYTES else whole + 1
                for p in range(0, max(1, whole - length + 1), step):
                    stop = min(whole, p + step + length - 1)
                    own = offsets[i : j + 1] - offsets[i] if step > whole else np.array([0, stop - p])
                    text = data[offsets[i] + p : offsets[i] + stop]
                    row, start, windows, k1, k2 = segments(text, own, length, anchor)
                    held.append((did[i + row], _pack(rn[i + row], start + p, windows, 0), k1, k2, size + own[row] + start, windows + length - 1))
                    texts.append(text)
                    size += stop - p
                    if size > 8 << 20:
                        yield settle(held, texts)
                        held, texts, size = [], [], 0
        if held:
            yield settle(held, texts)

    return run


def _mixed(did: np.ndarray, loc: np.ndarray) -> np.ndarray:
    return mix64(did.view(np.uint64) * np.uint64(31) + loc.view(np.uint64))


def _judge(hot: int):
    """Segments sorted by (k1, k2, did, loc) -> (did, loc, kind, k1): kind 0 goes, 1 is to be compared, 2 likewise but under a hot anchor."""
    names = ["did", "loc", "kind", "k1"]

    def out(did: np.ndarray, loc: np.ndarray, kind: int | np.ndarray, k1: np.ndarray) -> pa.RecordBatch:
        return _rows(names, did, loc, np.broadcast_to(np.asarray(kind, np.int32), did.shape), _longs(k1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held, hot_anchor = empty, None
        for b in batches:
            k1, k2, did, loc = (b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(), b.column(3).to_numpy())
            settled = loc & 1 == 1
            if settled.any():
                yield out(did[settled], loc[settled], 0, k1[settled])
                k1, k2, did, loc = k1[~settled], k2[~settled], did[~settled], loc[~settled]
            if not len(k1):
                continue
            k1, k2, did, loc = (np.concatenate([h, x]) for h, x in zip(held, (k1, k2, did, loc)))
            copy = np.zeros(len(k1), bool)
            copy[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
            if copy.any():
                yield out(did[copy], loc[copy], 0, k1[copy])
                k1, k2, did, loc = k1[~copy], k2[~copy], did[~copy], loc[~copy]
            group = k1 >> np.uint64(16)
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            last = int(new[-1])
            size = np.repeat(np.diff(np.append(new, len(k1))), np.diff(np.append(new, len(k1))))
            is_hot = size > hot
            if hot_anchor is not None:
                is_hot |= group == hot_anchor
            done = (np.arange(len(k1)) < last) & ((size > 1) | is_hot)
            if done.any():
                yield out(did[done], loc[done], np.where(is_hot[done], 2, 1), k1[done])
            keep = np.arange(len(k1)) >= last
            if is_hot[last]:
                hot_anchor = group[last]
                more = keep.copy()
                more[-1] = False  # the last one is held, as copies of it may follow
                if more.any():
                    yield out(did[more], loc[more], 2, k1[more])
                keep &= ~more
            held = (k1[keep], k2[keep], did[keep], loc[keep])
        if len(held[0]) > 1 or (len(held[0]) and hot_anchor is not None and held[0][0] >> np.uint64(16) == hot_anchor):
            yield out(held[2], held[3], 2 if len(held[0]) == 1 or len(held[0]) > hot else 1, held[0])

    return run


def _fetch(length: int):
    """Documents with their verdicts -> (k1, did, loc, bytes) of what is to be compared."""
    names = ["k1", "did", "loc", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                data, offsets = text_buffers(part.column(2))
                lists = part.column(3)
                items = lists.flatten()
                if not len(items):
                    continue
                doc = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(lists).fill_null(0)))
                loc, kind, k1 = (np.asarray(items.field(x)) for x in range(3))
                rn, pos, windows, _ = _unpack(loc)
                did = part.column(0).to_numpy()
                mine = (rn == part.column(1).to_numpy()[doc]) & (kind > 0)
                raw = data.tobytes()
                plain = np.flatnonzero(mine & (kind == 1))
                at = offsets[doc] + pos
                if len(plain):
                    yield pa.RecordBatch.from_arrays([pa.array(k1[plain]), pa.array(did[doc[plain]]), pa.array(loc[plain]), pa.array([raw[a : a + w + length - 1] for a, w in zip(at[plain].tolist(), windows[plain].tolist())], pa.binary())], names=names)
                under_hot = np.flatnonzero(mine & (kind == 2))
                under_hot = under_hot[np.lexsort((pos[under_hot], doc[under_hot]))]
                for many in np.array_split(under_hot, 1 + len(under_hot) // 512):
                    if len(many):
                        n = windows[many]
                        back = np.repeat(many, n)
                        step = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
                        start = at[back] + step
                        prefix = prefix_hash(data)
                        h = mix64((prefix[start + length] - prefix[start]) * powers(len(prefix))[1][start]) & ~_LOW
                        copy = _copies(data, start, np.full(len(start), length), h)
                        place = _pack(rn[back], pos[back] + step, np.ones(len(back), np.int64), copy.astype(np.int64))
                        key = np.where(copy, mix64(h + _mixed(did[doc[back]], place)), h)
                        yield pa.RecordBatch.from_arrays([pa.array(_longs(key)), pa.array(did[doc[back]]), pa.array(place), pa.array([b"" if c else raw[a : a + length] for a, c in zip(start.tolist(), copy.tolist())], pa.binary())], names=names)

    return run


def _compare(length: int):
    """(k1, did, loc, bytes) sorted by (k1's anchor, did, loc) -> (did, rn, start, end) of what goes."""
    names = ["did", "rn", "start", "stop"]

    def solve(k1: np.ndarray, did: np.ndarray, loc: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        rn, pos, windows, _ = _unpack(loc)
        data, offsets = text_buffers_of_binary(texts)
        piece = np.repeat(np.arange(len(k1)), windows)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = ((k1[piece] >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64) - step
        anchor = k1[piece] >> np.uint64(16)
        order = np.lexsort((place, anchor))  # stable: within a group the order of documents stays
        a, d = anchor[order], place[order]
        new = np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]))
        group = np.cumsum(new)
        more = np.bincount(group)[group] > 1
        order, group = order[more], group[more]
        if not len(order):
            return
        gone = order[repeated(Suffixes(data, length), offsets[piece[order]] + step[order], group)]
        gone.sort()
        if not len(gone):
            return
        first = np.append(True, (np.diff(gone) != 1) | (piece[gone[1:]] != piece[gone[:-1]]))
        last = np.append(first[1:], True)
        p, q = gone[first], gone[last]
        yield _rows(names, did[piece[p]], rn[piece[p]], pos[piece[p]] + step[p], pos[piece[q]] + step[q] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            settled = b.column(2).to_numpy() & 1 == 1
            if settled.any():
                did, (rn, pos, _, _) = b.column(1).to_numpy()[settled], _unpack(b.column(2).to_numpy()[settled])
                yield _rows(names, did, rn, pos, pos + length)
                b = b.filter(pa.array(~settled))
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size > 8_000:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                anchor = table.column(0).to_numpy().view(np.uint64) >> np.uint64(16)
                cut = _last_run(anchor)
                if cut:
                    yield from solve(*_columns(table.slice(0, cut)))
                held = [table.slice(cut)]
                size = table.num_rows - cut
        if held:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            if table:
                yield from solve(*_columns(table[0]))

    return run


def _last_run(anchor: np.ndarray) -> int:
    return int(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))[-1])


def _columns(b: pa.RecordBatch) -> tuple:
    return b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)


def text_buffers_of_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _cut(length: int):
    """Documents with verdicts and further spans -> kept bytes and removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            data, offsets = text_buffers(b.column(2))
            did, rn = b.column(0), b.column(1).to_numpy()
            one, two = b.column(3), b.column(4)
            kept, removed, spans, starts, stops = [], [], [], [], []
            lists = []
            for column in (one, two):
                n = np.asarray(pa.compute.list_value_length(column).fill_null(0))
                lists.append((np.concatenate([[0], np.cumsum(n)]), column.flatten()))
            (o1, i1), (o2, i2) = lists
            loc, kind = np.asarray(i1.field(0)), np.asarray(i1.field(1))
            r1, p1, w1, _ = _unpack(loc)
            r2, s2, e2 = (np.asarray(i2.field(x)).astype(np.int64) for x in range(3))
            for k in range(b.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                a = slice(o1[k], o1[k + 1])
                c = slice(o2[k], o2[k + 1])
                ok = (kind[a] == 0) & (r1[a] == rn[k])
                mine = r2[c] == rn[k]
                start = np.concatenate([p1[a][ok], s2[c][mine]])
                stop = np.concatenate([p1[a][ok] + w1[a][ok] + length - 1, e2[c][mine]])
                if not len(start):
                    kept.append(text.tobytes())
                    removed.append(0)
                    spans.append(0)
                    starts.append([])
                    stops.append([])
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
                begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                kept.append(text[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(len(begin))
                starts.append(begin)
                stops.append(end)
            yield pa.RecordBatch.from_arrays([did, pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], names=["did", "kept", "n_bytes", "n_removed", "n_spans", "starts", "stops"])

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """One row per document: id, kept (binary), n_bytes, n_removed, n_spans, starts, stops (removed spans).

    One exchange of the texts, by id, which the scan, the fetch and the final cut share.
    """
    if not 0 < length - anchor < 127:
        raise ValueError("length - anchor has to lie between 1 and 126")
    ship(df.sparkSession)
    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NONE)).alias("did"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    if texts.groupBy("did").count().where("count > 1").isEmpty():
        out = _unique(texts, length, anchor, hot)
    else:
        placed = table(numbered(texts, "did", "t"), "numbered")
        out = _unique(placed.select("place", "t").withColumnRenamed("place", "did"), length, anchor, hot).withColumnRenamed("did", "place")
        out = placed.select("place", "did").join(out, "place").drop("place")
    return out.withColumn("did", F.when(F.col("did") != _NONE, F.col("did"))).withColumnRenamed("did", id_col)


def _unique(texts: DataFrame, length: int, anchor: int, hot: int) -> DataFrame:
    """For (did, t) with distinct did."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = texts.repartition(n, "did").sortWithinPartitions("did").select("did", F.lit(1).alias("rn"), "t")
    found = docs.mapInArrow(_scan(length, anchor), "k1 long, k2 long, did long, loc long")
    judged = found.repartition(n, F.shiftright("k1", 16)).sortWithinPartitions("k1", "k2", "did", "loc").mapInArrow(_judge(hot), "did long, loc long, kind int, k1 long")
    verdicts = judged.groupBy("did").agg(F.collect_list(F.struct("loc", "kind", "k1")).alias("seen"))
    with_verdicts = docs.join(verdicts.hint("merge"), "did", "left")
    open_ = with_verdicts.where(F.exists("seen", lambda x: x["kind"] > 0))
    pieces = open_.mapInArrow(_fetch(length), "k1 long, did long, loc long, bytes binary")
    spans = pieces.repartition(n, F.shiftright("k1", 16)).sortWithinPartitions(F.shiftright("k1", 16), "did", "loc").mapInArrow(_compare(length), "did long, rn long, start long, stop long")
    more = spans.groupBy("did").agg(F.collect_list(F.struct("rn", "start", "stop")).alias("more"))
    last = with_verdicts.join(more.hint("merge"), "did", "left")
    nothing = F.array().cast("array<struct<loc:bigint,kind:int,k1:bigint>>"), F.array().cast("array<struct<rn:bigint,start:bigint,stop:bigint>>")
    last = last.select("did", "rn", "t", F.coalesce("seen", nothing[0]).alias("seen"), F.coalesce("more", nothing[1]).alias("more"))
    return last.mapInArrow(_cut(length), "did long, kept binary, n_bytes long, n_removed long, n_spans long, starts array<long>, stops array<long>")


__all__ = ["Suffixes", "repeated", "segments", "suffix_dedup"]
