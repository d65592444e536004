"""Removal of byte strings that an earlier document has, with suffix arrays by external induced sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Equal strings
must meet to be found. Each window of LENGTH bytes has an anchor, its smallest 16-gram by hash, and neighbouring windows
with one anchor form a piece; equal windows have equal anchors, so pieces are dealt to shards by anchor, and anchors
that only one document has (found by a first pass over anchor hashes) are left out. Pieces around a very frequent anchor
are cut by where in a window the anchor lies and dealt by the longer string that all windows of a cut share. The number of
shards follows from the bytes that the first pass counts.

Equal windows have equal anchors in equal places, so a shard cuts each of its different pieces to the windows whose common
string around the anchor, of 42 bytes or so, another piece with another smallest id has, too; other windows repeat only in
whole copies of their piece. A shard sorts the suffixes of these cuttings by external induced sorting (see induced.py), which yields the common-prefix
values along with the order; windows between which they reach LENGTH are equal, and those not from the smallest id of
their run are removed. Texts, queues and all arrays over symbols of a shard lie in files of the task beyond a memory budget.
A piece that several documents have is sorted once, under its smallest id; the other documents' copies go whole. No group
of copies is ever held together: a task sends a piece once for its smallest id, and a shard sorts different pieces only.

Null texts count as empty; texts shorter than LENGTH stay as they are; an empty table gives an empty result. A null doc_id
is neither smaller nor larger than another: such rows lose nothing and take nothing from others. Rows that repeat a doc_id
must repeat its text, and get the same result; a document's own repetitions stay. Extra columns stay out. Texts of any
length are read in steps of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import bounded_batches, cut, id_filter, release_memory, shuffle_partitions, table
from framewright.llm.induced import MEMORY, Column, Scratch, Sorter

LENGTH, GRAM = 50, 16
#: Windows handled in one step; pieces that a task remembers having sent; bytes of text whose pieces are dealt at once, as
#: each batch makes a row for each shard.
STEP, SENT, DEALT = 1 << 19, 1_000_000, 16 << 20
#: Bytes of texts that are looked at together, unless one is longer by itself.
TOGETHER = 1 << 17
#: The filter of shared anchors has FILTER_BITS bits an anchor, two to the power of the first of FILTER_LOG in all at least
#: and of the second at most: with more anchors than that it lets pieces through that nobody shares, and never too few.
FILTER_BITS, FILTER_LOG = 16, (27, 29)
#: Bytes of pieces that a shard should get, shards at most, and bytes of a piece on average. Beyond so many shards they
#: grow, and lie in files, so that rows between tasks grow no faster than the input.
SHARD_BYTES, SHARDS, PIECE_BYTES = 16 << 20, 1 << 10, 66
#: Anchors whose pieces are dealt by longer strings, at most, and how many pieces one must have. One that isn't among
#: so many has less than one HOT-th of all pieces.
HOT, HOT_LEAST = 1 << 16, (4 << 20) // PIECE_BYTES // 4
#: Where in a window the anchor lies, in so many ranges, for pieces that are cut.
RANGES = 4

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LOW = np.uint64(0xFFFFFFFF)
_MIXED = np.random.default_rng(50).integers(1, 1 << 63, (2, 256), np.uint64)


def pieces(buffer: np.ndarray, length: int = LENGTH, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window + 1, anchor's place and anchor hash of the pieces of a text, or of several ones that begin
    at ``starts``."""
    n = len(buffer) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    b = buffer.astype(np.uint64)
    two = b[:-1] * _A + b[1:] + _B
    four = two[:-2] * _B + (two[2:] ^ (two[2:] >> np.uint64(29)))
    eight = four[:-4] * _C + (four[4:] ^ (four[4:] >> np.uint64(31)))
    gram = eight[:-8] * _A + (eight[8:] ^ (eight[8:] >> np.uint64(30)))
    gram = (gram ^ (gram >> np.uint64(32))) * _B
    gram ^= gram >> np.uint64(29)
    best = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)  # the leftmost of equal hashes
    width, over = 1, length - GRAM + 1
    while 2 * width <= over:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:n], best[over - width : over - width + n])
    anchor = (best & _LOW).astype(np.int64)
    fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    if starts is None:
        first = np.flatnonzero(fresh)
        return first, np.append(first[1:], n), anchor[first], gram[anchor[first]]
    fresh[starts[starts < n]] = True
    first = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(buffer)) - length + 1  # no window goes on in the next text
    last = np.minimum(np.append(first[1:], n), ends[np.searchsorted(starts, first, side="right") - 1])
    inside = first < last
    first = first[inside]
    return first, last[inside], anchor[first], gram[anchor[first]]


def _part_places(length: int) -> list[tuple[int, int]]:
    """The anchor's place in a window, from .. to, for each part of a piece."""
    over = length - GRAM + 1
    return [(over * r // RANGES, over * (r + 1) // RANGES - 1) for r in range(RANGES)]


def split_hot(raw: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window + 1, anchor's place and hash of the parts of some pieces, cut by that place in a window.

    All windows of a part cover one longer string around the anchor; the hash is that string's.
    """
    out = []
    for low, high in _part_places(length):
        a, b = np.maximum(first, place - high), np.minimum(last, place - low + 1)
        some = a < b
        p = place[some]
        out.append((a[some], b[some], p, _hashes(raw, p - low, p - high + length)[0]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _steps(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(id, bytes, offset of the bytes) of each text, long ones in overlapping steps."""
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        for at in range(0, len(raw) - length + 1, STEP):
            yield i, raw[at : at + STEP + length - 1], at


def _groups(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, where each one's bytes begin, and its offset) of some steps at a time."""
    held, size = [], 0

    def group() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, raw, at = zip(*held, strict=True)
        n = np.array([len(r) for r in raw], np.int64)
        return np.array(ids, np.int64), np.concatenate(raw), np.cumsum(n) - n, np.array(at, np.int64)

    for i, raw, at in _steps(batch, length):
        if held and size + len(raw) > TOGETHER:
            yield group()
            held, size = [], 0
        held.append((i, raw, at))
        size += len(raw)
    if held:
        yield group()


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, rows) for each shard that has any."""
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        yield i, order[bounds[i] : bounds[i + 1]]


def _shared_anchors(documents: DataFrame, length: int, shards: int) -> DataFrame:
    """anchor, n: hashes of the anchors that more than one document, or parts of several tasks, have, and how many pieces
    they have, where a batch counts 65,535 of them at most: that only places pieces, and loses none."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_hashes, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for ids, raw, starts, _ in _groups(batch, length):
                first, _, _, anchor = pieces(raw, length, starts)
                all_hashes.append(anchor)
                whose.append(ids[np.searchsorted(starts, first, side="right") - 1])
            h, d = np.concatenate(all_hashes), np.concatenate(whose)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first) if len(h) else np.zeros(0, bool)
            many = np.minimum(np.diff(np.append(first, len(h))), 65535).astype(np.uint16)
            h = h[first]
            rows = []
            for s, at in _by_shard((h % np.uint64(shards)).astype(np.int64), shards):
                at = at[np.argsort(several[at], kind="stable")]
                single = int((~several[at]).sum())
                # the lowest bytes are dropped: a chance match only sends a piece for nothing
                rows.append({"shard": s, "single": single, "packed": h[at].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(), "many": many[at[single:]].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("single", pa.int32()), ("packed", pa.binary()), ("many", pa.binary())]))
        release_memory()

    def meet(t: pa.Table) -> pa.Table:
        anchors, counts, more = [], [], []
        for single, raw, many in zip(t.column("single").to_pylist(), t.column("packed"), t.column("many"), strict=True):
            six = np.frombuffer(raw.as_py(), np.uint8).reshape(-1, 6)
            eight = np.zeros((len(six), 8), np.uint8)
            eight[:, 2:] = six
            anchors.append(eight.view(np.int64)[:, 0])
            counts.append(np.concatenate([np.ones(single, np.int32), np.frombuffer(many.as_py(), np.uint16).astype(np.int32)]))
            more.append(np.arange(len(six)) >= single)
        h, n, m = (np.concatenate(x) for x in (anchors, counts, more))
        del anchors, counts, more
        order = np.argsort(h)
        h, n, m = h[order], n[order], m[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(n, head, dtype=np.int64)
        shared = (np.diff(np.append(head, len(h))) > 1) | np.logical_or.reduceat(m, head)
        out = pa.table({"anchor": h[head[shared]], "n": total[shared]})
        release_memory()
        return out

    return documents.mapInArrow(send, "shard int, single int, packed binary, many binary").groupBy("shard").applyInArrow(meet, "anchor long, n long")


def _spread(anchors: np.ndarray, log: int) -> np.ndarray:
    """The bit of each anchor (without its lowest bytes) among two to the power ``log``."""
    x = (anchors.view(np.uint64) & ~np.uint64(0xFFFF)) * _C
    return ((x ^ (x >> np.uint64(32))) * _A >> np.uint64(64 - log)).astype(np.int64)


def _filter_log(anchors: int) -> int:
    """How many bits the filter has, as a power of two."""
    return min(max(FILTER_LOG[0], (anchors * FILTER_BITS - 1).bit_length()), FILTER_LOG[1])


def _filter_bits(anchors: DataFrame, log: int) -> np.ndarray:
    """A bit array of a bounded size that has the bit of every shared anchor."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_spread(batch.column(0).to_numpy(), log))
            part = bit >> 16
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(bit) else np.zeros(0, np.int64)
            low = (bit & 0xFFFF).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"part": part[first], "bits": [x.tobytes() for x in np.split(low, first[1:])] if len(bit) else []}, schema=pa.schema([("part", pa.int64()), ("bits", pa.binary())]))

    def pack(t: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, bool)
        for raw in t.column("bits"):
            on[np.frombuffer(raw.as_py(), np.uint16)] = True
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    found = anchors.mapInArrow(deal, "part long, bits binary").groupBy("part").applyInArrow(pack, "part long, bits binary").toArrow()  # as large as the filter at most
    out = np.zeros((1 << (log - 16), 1 << 13), np.uint8)
    for part, raw in zip(found.column("part").to_pylist(), found.column("bits"), strict=True):
        out[part] = np.frombuffer(raw.as_py(), np.uint8)
    return out.ravel()


def removed_windows(symbols: np.ndarray, start: np.ndarray, ids: np.ndarray, length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, as piece, first window and last window + 1, of some different pieces that start a string which a
    piece of a smaller id has.

    ``symbols`` holds the bytes of the pieces plus 1, a 0 behind each piece, and zeros for the sorter; ``start`` the places
    where pieces begin and, last, where they end; ``ids`` the pieces' ids.
    """
    n, scratch = int(start[-1]), Scratch(memory // 4)
    window, gone = scratch.empty(n, bool), scratch.empty(n, bool)
    gone[:] = False
    window[:] = True
    for at in range(0, len(start) - 1, STEP):
        ends = np.asarray(start[at + 1 : at + 1 + STEP])
        for k in range(1, length + 1):  # no window starts in the last bytes of a piece or between two
            window[ends - k] = False

    def settle(p: np.ndarray, heads: np.ndarray) -> None:
        many = np.diff(np.append(heads, len(p)))
        use = np.repeat(many > 1, many)
        if use.any():
            p, many = p[use], many[many > 1]
            d = ids[np.searchsorted(start, p, side="right") - 1]
            least = np.minimum.reduceat(d, np.cumsum(many) - many)
            gone[p] = np.repeat(least, many) < d

    held_p, held_new, held = [], [], 0
    for p, common in Sorter(symbols, n, length, memory).suffixes():
        # a run of equal windows has no other suffix inside, so no common prefix within it is lost
        use = window[p]
        held_p.append(p[use])
        held_new.append((common < length)[use])
        held += len(held_p[-1])
        if held > STEP and held_new[-1].any():
            p, new = np.concatenate(held_p), np.concatenate(held_new)
            new[0] = True
            heads = np.flatnonzero(new)
            whole = int(heads[-1])  # the last run may go on
            settle(p[:whole], heads[:-1])
            held_p, held_new, held = [p[whole:]], [new[whole:]], len(p) - whole
    if held:
        p, new = np.concatenate(held_p), np.concatenate(held_new)
        new[0] = True
        settle(p, np.flatnonzero(new))
    found, before = [np.zeros(0, np.int64)], False
    for at in range(0, n, STEP):
        g = np.concatenate([[before], gone[at : at + STEP], [False] * (at + STEP >= n)])
        edge = np.flatnonzero(g[1:] != g[:-1]) + at
        before = bool(g[-1])
        found.append(edge)
    edge = np.concatenate(found)
    first, end = edge[::2], edge[1::2]
    of = np.searchsorted(start, first, side="right") - 1
    return of, first - start[of], end - start[of]


def _zip(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, as differences, compressed."""
    return zstandard.compress(b"".join(np.diff(x.astype(np.int64), prepend=0).tobytes() for x in arrays))


def _unzip(raw: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.decompress(raw), np.int64)
    return [np.cumsum(x) for x in flat.reshape(n, -1)]


class _Sent:
    """The smallest id that this task has sent a piece for, by two 64-bit hashes; what doesn't fit in is just sent again."""

    def __init__(self):
        self.hashes, self.second, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def owner(self, h: np.ndarray, second: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The smallest id with each piece, here or before; a piece whose hashes don't agree is its own."""
        every, head, at = np.unique(h, return_index=True, return_inverse=True)
        of = second[head]
        least = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(least, at, d)
        fresh, clash = np.ones(len(every), bool), np.zeros(len(every), bool)
        if len(self.hashes):
            i = np.minimum(np.searchsorted(self.hashes, every), len(self.hashes) - 1)
            fresh = self.hashes[i] != every
            clash = ~fresh & (self.second[i] != of)
            i, old = i[~fresh & ~clash], ~fresh & ~clash
            least[old] = self.ids[i] = np.minimum(least[old], self.ids[i])
        add = np.flatnonzero(fresh)[: max(0, SENT - len(self.hashes))]
        if len(add):
            hashes, second_, ids = (np.concatenate(x) for x in ((self.hashes, every[add]), (self.second, of[add]), (self.ids, least[add])))
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.second, self.ids = hashes[order], second_[order], ids[order]
        return np.where(clash[at] | (second != of[at]), d, least[at])


_POWERS: list[np.ndarray] = []


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: int = 1) -> list[np.ndarray]:
    """64-bit hashes of byte ranges of one step, by prefix sums of a polynomial over mixed bytes."""
    if not _POWERS:  # made once a process, for the longest step
        base = 0xD6E8FEB86659FD93
        for x in (base, pow(base, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP + 4096, x, np.uint64)]), dtype=np.uint64))
    out = []
    for mixed in _MIXED[:kinds]:
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mixed[raw] * _POWERS[0][: len(raw)], out=prefix[1:], dtype=np.uint64)
        h = (prefix[end] - prefix[start]) * _POWERS[1][start] + (end - start).astype(np.uint64) * _C
        h = (h ^ (h >> np.uint64(31))) * _A
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _ranges_of(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for n[0] places, and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Shard:
    """The pieces of one shard as they come in, and what goes of them. All of it lies in files beyond the memory budget."""

    def __init__(self, length: int, memory: int = MEMORY):
        self.length, self.memory = length, memory
        self.bytes, self.n, self.ids, self.at, self.hashes, self.anchors = (Column(t, memory // 8) for t in (np.uint8, np.int64, np.int64, np.int64, np.uint64, np.int16))
        self.sorted = 0  # bytes of them

    def add(self, n: np.ndarray, ids: np.ndarray, at: np.ndarray, anchor: np.ndarray, raw: bytes) -> None:
        """Pieces of n bytes of documents, with their places there and their anchors' places in them."""
        raw, ends = np.frombuffer(raw, np.uint8), np.cumsum(n)
        for x, column in zip((raw, n, ids, at, anchor), (self.bytes, self.n, self.ids, self.at, self.anchors), strict=True):
            column.append(x)
        a = 0
        while a < len(n):  # some pieces at a time, as many as one step may hold
            base = int(ends[a] - n[a])
            b = max(a + 1, int(np.searchsorted(ends, base + STEP, side="right")))
            self.hashes.append(_hashes(raw[base : int(ends[b - 1])], ends[a:b] - n[a:b] - base, ends[a:b] - base)[0])
            a = b

    def _meeting(self, raw: np.ndarray, begin: np.ndarray, n: np.ndarray, anchor: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and last window + 1 of different pieces that may be windows of one with another smallest id; none
        where they are equal. Equal hashes of different strings only make it more."""
        first, last = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64)
        cuts = [[] for _ in range(RANGES)]
        some = max(1, STEP // (2 * self.length))
        for a in range(0, len(n), some):
            m, g = n[a : a + some], anchor[a : a + some].astype(np.int64)
            start = np.cumsum(m) - m
            part = raw[_ranges_of(begin[a : a + some], m)]
            for (low, high), found in zip(_part_places(self.length), cuts, strict=True):
                x, y = np.maximum(g - high, 0), np.minimum(g - low + 1, m - self.length + 1)
                i = np.flatnonzero(x < y)
                found.append((i + a, x[i], y[i], _hashes(part, (start + g)[i] - low, (start + g)[i] - high + self.length)[0]))
        for found in cuts:
            i, x, y, h = map(np.concatenate, zip(*found, strict=True))
            found.clear()
            if not len(i):
                continue
            order = np.argsort(h)
            h, d = h[order], least[i[order]]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head)
            live = order[np.repeat(several, np.diff(np.append(head, len(h))))]
            i, x, y = i[live], x[live], y[live]
            first[i], last[i] = np.minimum(first[i], x), np.maximum(last[i], y)
        return np.minimum(first, last), last

    def ranges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """id, first and end of what goes, in parts."""
        raw, n, ids, at, h = (c.array() for c in (self.bytes, self.n, self.ids, self.at, self.hashes))
        if not len(n):
            return
        scratch = Scratch(self.memory // 4)
        begin = scratch.empty(len(n), np.int64)
        begin[:] = np.cumsum(n) - n
        order = np.argsort(h, kind="stable")
        head = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        of = scratch.empty(len(n), np.int64)  # the first piece with these bytes
        of[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        del order, head, h
        for a in range(0, len(n), STEP // 64):  # the hash suggests, the bytes decide
            i = np.arange(a, min(len(n), a + STEP // 64))
            i = i[of[i] != i]
            i = np.concatenate([i[n[i] != n[of[i]]], i[n[i] == n[of[i]]]])
            differ = n[i] != n[of[i]]
            same = i[~differ]
            if len(same):
                x = np.asarray(raw[_ranges_of(begin[same], n[same])]) != np.asarray(raw[_ranges_of(begin[of[same]], n[same])])
                differ[len(i) - len(same) :] = np.logical_or.reduceat(x, np.cumsum(n[same]) - n[same])
            of[i[differ]] = i[differ]
        own = np.flatnonzero(of == np.arange(len(n)))
        number = scratch.empty(len(n), np.int64)
        number[own] = np.arange(len(own))
        number[:] = number[of]
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, number, ids)
        low, high = self._meeting(raw, begin[own], n[own], self.anchors.array()[own], least)
        meeting = low < high
        slot = np.where(meeting, np.cumsum(meeting) - 1, -1)  # the place among the sorted ones
        own, low, high, self.anchors = own[meeting], low[meeting], high[meeting], None
        size = high - low + self.length - 1
        self.sorted = int(size.sum())
        symbols = Column(np.uint8, self.memory // 4)
        for a in range(0, len(own), STEP // 64):
            mine, m = begin[own[a : a + STEP // 64]] + low[a : a + STEP // 64], size[a : a + STEP // 64]
            part = np.zeros(int(m.sum()) + len(mine), np.uint8)  # no UTF-8 text has the byte 255, so plus 1 fits
            part[_ranges_of(np.cumsum(m + 1) - m - 1, m)] = raw[_ranges_of(mine, m)] + np.uint8(1)
            symbols.append(part)
        symbols.append(np.zeros(self.length + 16, np.uint8))
        start = np.concatenate([[0], np.cumsum(size + 1)])
        del raw
        self.bytes = None
        piece, first, end = removed_windows(symbols.array(), start, least[meeting], self.length, self.memory)
        first, end = first + low[piece], end + low[piece]
        for a in range(0, len(n), STEP):
            i, text, place = ids[a : a + STEP], number[a : a + STEP], at[a : a + STEP]
            whole = i > least[text]
            yield i[whole], place[whole], (place + n[a : a + STEP])[whole]
            mine = slot[text[~whole]]
            begun = np.searchsorted(piece, mine)  # runs are in order of pieces
            many = np.searchsorted(piece, mine, side="right") - begun
            run = _ranges_of(begun, many)
            doc, place = np.repeat(i[~whole], many), np.repeat(place[~whole], many)
            yield doc, place + first[run], place + end[run] + self.length - 1


def repeated_ranges(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, ranges: of each document (id, text) that has any, the maximal byte ranges that go: first, end, first, end ..."""
    spark = documents.sparkSession
    buckets = max(8, shuffle_partitions(spark))
    anchors = cut(_shared_anchors(documents, length, buckets))
    several, pieces_there = anchors.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).head()
    log = _filter_log(several)
    shards = min(SHARDS, max(8, -(-pieces_there * PIECE_BYTES // SHARD_BYTES)))
    hot = anchors.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "anchor").limit(HOT).toArrow()  # HOT rows at most
    hot = np.sort(hot.column("anchor").to_numpy().view(np.uint64))
    wanted = spark.sparkContext.broadcast((_filter_bits(anchors.select("anchor"), log), hot))  # of bounded size

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, turn = _Sent(), 0
        bits, frequent = wanted.value

        def deal(found: list[tuple], buffers: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal turn
            start, end, place, anchor, doc, shift, h, second = (np.concatenate(x) for x in zip(*found, strict=True))
            buffer = np.concatenate(buffers)
            own = doc == sent.owner(h, second, doc)
            rows = []
            # another document with a smaller id has the whole piece
            done = _join(doc[~own], (start + shift)[~own], (end + shift)[~own])
            if len(done[0]):
                turn += 1
                rows.append({"shard": turn % shards, "packed": _zip(*done), "texts": None})
            mine = np.flatnonzero(own)
            for s, at in _by_shard(((anchor[mine] >> np.uint64(16)) % np.uint64(shards)).astype(np.int64), shards):
                at = mine[at]
                n = end[at] - start[at]
                rows.append({"shard": s, "packed": _zip(n, doc[at], (start + shift)[at], (place - start)[at]), "texts": zstandard.compress(buffer[_ranges_of(start[at], n)].tobytes())})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("packed", pa.binary()), ("texts", pa.binary())]))

        found, buffers, base = [], [], 0
        for batch in batches:
            for ids, raw, starts, offsets in _groups(batch, length):
                first, last, place, anchor = pieces(raw, length, starts)
                bit = _spread(anchor, log)
                use = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                if not len(use):
                    continue
                first, last, place, anchor = first[use], last[use], place[use], anchor[use]
                if len(frequent):
                    bare = anchor & ~np.uint64(0xFFFF)
                    hit = frequent[np.minimum(np.searchsorted(frequent, bare), len(frequent) - 1)] == bare
                    if hit.any():
                        parts = split_hot(raw, first[hit], last[hit], place[hit], length)
                        first, last, place, anchor = (np.concatenate([x[~hit], y]) for x, y in zip((first, last, place, anchor), parts, strict=True))
                a, b = first, last + length - 1
                of = np.searchsorted(starts, a, side="right") - 1
                found.append((a + base, b + base, place + base, anchor, ids[of], (offsets - starts)[of] - base, *_hashes(raw, a, b, 2)))
                buffers.append(raw)
                base += len(raw)
                if base >= DEALT:
                    yield deal(found, buffers)
                    found, buffers, base = [], [], 0
        if found:
            yield deal(found, buffers)
        release_memory()

    def rows_of(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            doc, first, end = _join(*part)
            rows = [{"bucket": b, "packed": _zip(doc[x], first[x], end[x])} for b, x in _by_shard((doc % buckets).astype(np.int64), buckets)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(length)
        for batch in batches:
            done = [(np.zeros(0, np.int64),) * 3]
            for numbers, texts in zip(batch.column("packed"), batch.column("texts"), strict=True):
                if texts.is_valid:
                    shard.add(*_unzip(numbers.as_py(), 4), zstandard.decompress(texts.as_py()))
                else:
                    done.append(_unzip(numbers.as_py(), 3))  # id, first, end
            yield from rows_of([tuple(map(np.concatenate, zip(*done, strict=True)))])
        yield from rows_of(shard.ranges())
        release_memory()

    def merge(t: pa.Table) -> pa.Table:
        doc, first, end = _join(*(np.concatenate(x) for x in zip(*(_unzip(r.as_py(), 3) for r in t.column("packed")), strict=True)))
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        both = np.stack([first, end], 1).ravel()
        offsets = pa.array(2 * np.append(edge, len(doc)), pa.int32())
        out = pa.table({"id": pa.array(doc[edge], pa.int64()), "ranges": pa.ListArray.from_arrays(offsets, pa.array(both, pa.int64()))})
        release_memory()
        return out

    met = documents.mapInArrow(send, "shard int, packed binary, texts binary").groupBy("shard").applyInArrow(sort, "bucket int, packed binary")
    out = cut(met.groupBy("bucket").applyInArrow(merge, "id long, ranges array<long>"))
    wanted.unpersist()  # workers let go of it, too
    return out


def _join(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that touch or overlap made one, sorted by document and place."""
    if not len(doc):
        return doc, first, end
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], end[order]
    # the furthest end so far within a document: documents are put behind one another for that
    _, number = np.unique(doc, return_inverse=True)
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * wide) - number * wide
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])]))
    return doc[new], first[new], reach[np.append(new[1:] - 1, len(doc) - 1)]


def _spans(ranges: list[int] | None) -> np.ndarray:
    return np.array(ranges or [], np.int64).reshape(-1, 2)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = np.concatenate([[0], spans.ravel(), [len(raw)]]).reshape(-1, 2).tolist()
    return b"".join(raw[a:b] for a, b in edges)


def _split(documents: DataFrame, length: int) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``documents`` that may have ranges, with them, the rows that have none, and the column's name."""
    id_, ranges = "__framewright_id", "__framewright_ranges"
    whole = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    each = repeated_ranges(whole, length).toDF(id_, ranges)
    touched = id_filter(each.select(id_))
    mark = "__framewright_touched"
    marked = documents.withColumn(mark, touched(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    some = marked.where(mark).drop(mark).join(each, F.col("doc_id").cast("long") == F.col(id_), "left").drop(id_)
    return some, marked.where(~F.col(mark)).drop(mark), ranges


def suffix_dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``documents``."""
    bounded_batches(documents.sparkSession)
    some, none, ranges = _split(documents.select("doc_id", "text"), length)

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string>")
    def digest(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, r in zip(texts, found, strict=True):
            raw, spans = (text.as_py() or "").encode(), _spans(r.as_py())
            out.append((len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    raw, zero = F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(0).cast("long")
    whole = none.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"))
    return some.select("doc_id", digest.asNondeterministic()("text", ranges).alias("d")).select("doc_id", "d.*").union(whole)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with what repeats taken out of text, and n_chars, if it is there, counted anew.

    A character of which only a part is removed goes whole. A text that is removed whole stays as an empty one.
    """
    bounded_batches(documents.sparkSession)
    some, none, ranges = _split(documents, length)

    @F.arrow_udf("string")
    def kept(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not r.as_py() else _kept(t.as_py().encode(), _spans(r.as_py())).decode("utf-8", "ignore") for t, r in zip(texts, found, strict=True)], pa.string())

    rows = some.withColumn("text", kept.asNondeterministic()("text", ranges)).drop(ranges).unionByName(none)
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"]))
    return rows.select(*documents.columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
SQL = {
    "op3_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, h[2 * i + 1 : 2 * i + 100] as win from d, unnest(generate_series(0, len(h) // 2 - 50)) as g(i)),
f as (select win, min(doc_id) as first from w group by win having min(doc_id) < max(doc_id)),
gone as (select doc_id, i from w join f using (win) where first < doc_id),
islands as (select doc_id, i, i > 50 + lag(i) over (partition by doc_id order by i) as fresh from gone),
numbered as (select doc_id, i, sum(coalesce(fresh, true)::int) over (partition by doc_id order by i) as k from islands),
spans as (select doc_id, k, min(i) as a, max(i) + 50 as b from numbered group by doc_id, k),
edges as (select doc_id, list(struct_pack(a := a, b := b) order by a) as r, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id),
kept as (select d.doc_id, case when r is null then h else array_to_string(list_transform(generate_series(0, len(r)), lambda j: h[2 * (case when j = 0 then 0 else r[j].b end) + 1 : 2 * (case when j = len(r) then len(h) // 2 else r[j + 1].a end)]), '') end as kept from d left join edges using (doc_id))
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(kept)) as kept_sha256
from d left join edges using (doc_id) join kept using (doc_id)""",
}
