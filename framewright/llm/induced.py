"""External induced sorting of suffixes with common-prefix values, in bulk steps over disk-backed queues.

A suffix is of type S if it is smaller than the one behind it, else of type L; an S suffix behind an L suffix is a seed.
Seeds are ordered by their first ``cap`` symbols: they are dealt by leading symbols into disk-backed queues, each of which
is dealt again by itself until it fits the memory budget. All other suffixes follow by induction: suffixes leave the
queues in order, by first symbol and then by arrival, and each puts the one in front of it into the queue of that one's
first symbol, first the L suffixes from the smallest up, then the S suffixes from the largest down. Every queue entry is
a tuple of position and common-prefix length with the entry before it in its queue, taken from the running minimum between
the two entries that induced them. Queues keep arrival order, so no entry is ever compared again.

What grows with the text, queues and arrays over its symbols alike, is held in memory up to a budget and lies in unnamed
files of the running task beyond it, so a text may be far larger than memory. Common prefixes are capped, and suffixes that
agree for ``cap`` symbols may come in any order among themselves.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes that one sort keeps in memory besides the steps it works on, and entries handled in one step.
MEMORY, STEP = 48 << 20, 1 << 17
#: Bytes of memory a seed takes while it is ordered.
_SEED_BYTES = 64
_KINDS = 256


def scratch_file():
    """A file without a name in the executor's own spill folder; it is gone when the task is."""
    folders = [f for f in (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",") if f]
    if not folders:  # outside of an executor, as in tests
        folders = [tempfile.gettempdir()]
    for f in folders:
        if os.path.isdir(f) and os.access(f, os.W_OK):
            return tempfile.TemporaryFile(dir=f)
    raise OSError(f"none of the spill folders can be written: {folders}")


class Scratch:
    """Arrays in memory up to a budget, beyond it in unnamed files."""

    def __init__(self, memory: int = MEMORY):
        self.left = memory

    def empty(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.empty(n, dtype)
        return np.memmap(scratch_file(), dtype, "w+", shape=(n,))


class Column:
    """An array that is appended to, in memory up to a budget, beyond it in an unnamed file."""

    def __init__(self, dtype, memory: int):
        self.dtype, self.memory, self.held, self.file, self.parts = np.dtype(dtype), memory, 0, None, []

    def append(self, x: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(x, self.dtype))
        self.held += self.parts[-1].nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or scratch_file()
        for part in self.parts:
            self.file.write(memoryview(part).cast("B") if len(part) else b"")
        self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.zeros(0, self.dtype), *self.parts])
        self._spill()
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r+")


class Queues:
    """Queues of (position, common prefix), in memory up to a budget and then on disk."""

    def __init__(self, memory: int, kinds: int = _KINDS):
        self.memory, self.held, self.file, self.end = memory, 0, None, 0
        self.parts: list[list] = [[] for _ in range(kinds)]
        self.taken = [0] * kinds
        self.entries = [0] * kinds
        self.fresh: list[tuple[int, int]] = []  # parts in memory, by queue and place

    def push(self, kind: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.fresh.append((kind, len(self.parts[kind])))
        self.parts[kind].append((positions, common))
        self.entries[kind] += len(positions)
        self.held += 9 * len(positions)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or scratch_file()
        self.file.seek(self.end)
        for kind, i in self.fresh:
            part = self.parts[kind][i]
            if part is not None:
                self.file.write(np.asarray(part[0], np.int64).tobytes() + np.asarray(part[1], np.uint8).tobytes())
                self.parts[kind][i] = (self.end, len(part[0]))
                self.end += 9 * len(part[0])
        self.fresh, self.held = [], 0

    def load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        self.file.seek(part[0])
        raw = self.file.read(9 * part[1])
        return np.frombuffer(raw, np.int64, part[1]), np.frombuffer(raw, np.uint8, part[1], 8 * part[1])

    def pop(self, kind: int) -> tuple[np.ndarray, np.ndarray] | None:
        """What has arrived so far for the symbol and is not taken yet, about STEP entries of it; None at the end."""
        waiting, got, n = self.parts[kind], [], 0
        while n < STEP and self.taken[kind] < len(waiting):
            part = waiting[self.taken[kind]]
            got.append(self.load(part))
            n += len(got[-1][0])
            if isinstance(part[0], np.ndarray):
                self.held -= 9 * len(part[0])
            waiting[self.taken[kind]] = None
            self.taken[kind] += 1
        if not got:
            return None
        return got[0] if len(got) == 1 else tuple(map(np.concatenate, zip(*got, strict=True)))

    def read(self, kind: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in reversed(self.parts[kind]) if backwards else self.parts[kind]:
            yield self.load(part)


def _starts(fresh: np.ndarray) -> np.ndarray:
    """For each element the place of the last one marked fresh, itself included."""
    at = np.flatnonzero(fresh)
    return np.repeat(at, np.diff(np.append(at, len(fresh))))


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


class Sorter:
    """Suffixes of ``text``, symbols from 0 to 254 in bytes. What ends a text counts as smaller than any symbol.

    ``text`` must have ``cap`` + 16 zeros behind its ``n`` symbols; it may be an array in a file.
    """

    def __init__(self, text: np.ndarray, n: int, cap: int, memory: int = MEMORY):
        self.x, self.n, self.cap, self.memory = text, n, cap, memory
        self.scratch = Scratch(memory // 3)
        self.word = np.ndarray((n + cap + 8,), ">u8", text, 0, (1,))  # eight symbols from each position on
        self.run, self.small = self.scratch.empty(n, np.uint8), self.scratch.empty(n, bool)
        self._types()

    def _types(self) -> None:
        """The capped length of the run of one symbol at each position, and whether its suffix is of type S."""
        after, ahead, up = -1, 0, False  # symbol, run and type right behind the chunk
        for at in range((self.n - 1) // STEP * STEP, -1, -STEP) if self.n else ():
            x = np.asarray(self.x[at : min(at + STEP, self.n)])
            ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)
            where = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
            run = ends[where] - np.arange(len(x)) + 1
            rises = np.zeros(len(ends), bool)
            rises[:-1] = x[ends[:-1] + 1] > x[ends[:-1]]
            if int(x[-1]) == after:
                run[where == len(ends) - 1] += ahead
                rises[-1] = up
            else:
                rises[-1] = after > int(x[-1])
            self.run[at : at + len(x)] = np.minimum(run, self.cap)
            self.small[at : at + len(x)] = rises[where]
            after, ahead, up = int(x[0]), int(min(run[0], self.cap)), bool(rises[0])

    def _words(self, at: np.ndarray) -> np.ndarray:
        return self.word[at].astype(np.uint64)

    def _seed_chunks(self) -> Iterator[np.ndarray]:
        for at in range(1, self.n, STEP):
            s = np.asarray(self.small[at - 1 : min(at + STEP, self.n)])
            found = np.flatnonzero(s[1:] & ~s[:-1]) + at
            if len(found):
                yield found

    def _order(self, chunks: Callable[[], Iterator[np.ndarray]], n: int, offset: int, out: np.ndarray, at: int) -> None:
        """Puts the ``n`` positions of the chunks, equal in all symbols before ``offset``, into out[at:] in order."""
        if offset >= self.cap:
            for p in chunks():  # equal as far as it counts
                out[at : at + len(p)] = p
                at += len(p)
        elif n * _SEED_BYTES <= self.memory:
            out[at : at + n] = self._ordered(np.concatenate([*chunks()]), offset)
        else:
            every = max(1, n // 4096)
            some = np.sort(np.concatenate([self._words(p[::every] + offset) for p in chunks()]))
            between = np.unique(some[:: max(1, len(some) * self.memory // (2 * n * _SEED_BYTES))])
            queues = Queues(self.memory // 4, 2 * len(between) + 1)
            for p in chunks():
                w = self._words(p + offset)
                kind = np.searchsorted(between, w, side="left") + np.searchsorted(between, w, side="right")  # odd where equal
                order = np.argsort(kind, kind="stable")
                kind, p = kind[order], p[order]
                head = np.flatnonzero(_changes(kind))
                for k, part in zip(kind[head].tolist(), np.split(p, head[1:]), strict=True):
                    queues.push(k, part, np.zeros(len(part), np.uint8))
            for k, count in enumerate(queues.entries):
                if count:
                    self._order(lambda k=k: (p for p, _ in queues.read(k)), count, offset + 8 * (k % 2), out, at)
                    at += count

    def _ordered(self, p: np.ndarray, offset: int) -> np.ndarray:
        key = self._words(p + offset)
        order = np.argsort(key)
        p, key = p[order], key[order]
        fresh = _changes(key)
        for offset in range(offset + 8, self.cap, 8):
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group, key = _starts(fresh)[at], self._words(p[at] + offset)
            order = np.lexsort((key, group))
            p[at], key = p[at[order]], key[order]
            fresh[at] |= _changes(key)  # the first of a group is fresh already
        return p

    def seeds(self) -> np.ndarray:
        """The seeds in order."""
        n = sum(map(len, self._seed_chunks()))
        out = self.scratch.empty(n, np.int64)
        if n:
            self._order(self._seed_chunks, n, 0, out, 0)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Capped common prefixes of pairs of suffixes."""
        out = np.zeros(len(a), np.int64)
        at = np.arange(len(a))
        limit = len(self.word) - 1
        for offset in range(0, self.cap, 8):
            d = self._words(np.minimum(a[at] + offset, limit)) ^ self._words(np.minimum(b[at] + offset, limit))
            same = d == 0
            rest = d[~same]
            lead = np.zeros(len(rest), np.int64)
            for k in range(1, 8):
                lead += rest < (np.uint64(1) << np.uint64(64 - 8 * k))
            out[at[~same]] = offset + lead
            at = at[same]
            if not len(at):
                break
        out[at] = self.cap
        return np.minimum(out, self.cap).astype(np.uint8)

    def _induce(self, queues: Queues, positions: np.ndarray, common: np.ndarray, carry: np.ndarray, small: bool) -> None:
        """Puts the suffixes in front of these, if of the wanted type, into their queues.

        carry[c] is the least common prefix since the last entry of queue c, -1 before its first.
        """
        before = positions - 1
        use = np.flatnonzero((before >= 0) & (self.small[np.maximum(before, 0)] == small))
        if not len(use):
            if len(common):
                np.minimum(carry, int(common.min()), out=carry, where=carry >= 0)
            return
        kinds = self.x[before[use]]
        order = np.argsort(kinds, kind="stable")
        k, at = kinds[order], use[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        low = np.empty(len(at), np.int64)
        low[first] = 0
        low[~first] = at[:-1][~first[1:]] + 1
        least = _range_minimum(common, low, at)
        head = np.flatnonzero(first)
        own = carry[k[head]]
        value = np.minimum(least.astype(np.int16) + 1, self.cap)
        value[head] = np.where(own < 0, 0, np.minimum(np.minimum(own, least[head]) + 1, self.cap))
        ends = np.append(head[1:], len(k)).astype(np.int64)
        for a, b in zip(head.tolist(), ends.tolist(), strict=True):
            queues.push(int(k[a]), before[at[a:b]], value[a:b].astype(np.uint8))
        np.minimum(carry, int(common.min()), out=carry, where=carry >= 0)
        last = at[ends - 1]
        tail = _range_minimum(common, np.minimum(last + 1, len(common) - 1), np.full(len(last), len(common) - 1))
        carry[k[head]] = np.where(last + 1 < len(common), tail, self.cap)

    def _meet(self, a: int | None, b: int | None) -> int:
        """Common prefix of an L and an S suffix with one first symbol."""
        return 0 if a is None or b is None else int(min(self.run[a], self.run[b]))

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in order of their suffixes, with common prefixes with the one before, in pieces."""
        if not self.n:
            return
        seeds = self.seeds()
        between = self.scratch.empty(len(seeds), np.uint8)
        many = np.zeros(_KINDS, np.int64)
        for at in range(0, len(seeds), STEP):
            own = np.asarray(seeds[at : at + STEP])
            many += np.bincount(self.x[own], minlength=_KINDS)
            before = np.concatenate([seeds[max(0, at - 1) : at], own])
            between[at + len(own) - len(before) + 1 : at + len(own)] = self.common(before[:-1], before[1:])
        bounds = np.concatenate([[0], np.cumsum(many)])
        large, queue, carry = Queues(self.memory // 4), Queues(self.memory // 4), np.full(_KINDS, -1, np.int16)
        queue.push(int(self.x[self.n - 1]), np.array([self.n - 1]), np.zeros(1, np.uint8))
        carry[self.x[self.n - 1]] = 0
        top: list[int | None] = [None] * _KINDS  # the largest L suffix of each first symbol
        for c in range(_KINDS):
            while (entry := queue.pop(c)) is not None:
                for a in range(0, len(entry[0]), STEP):
                    p, v = entry[0][a : a + STEP], entry[1][a : a + STEP]
                    large.push(c, p, v)
                    self._induce(queue, p, v, carry, False)
                top[c] = int(entry[0][-1])
            for a in range(bounds[c], bounds[c + 1], STEP):
                end = min(a + STEP, bounds[c + 1])
                own, v = np.asarray(seeds[a:end]), np.array(between[a:end])
                if a == bounds[c]:
                    v[0] = self._meet(top[c], int(own[0]))
                self._induce(queue, own, v, carry, False)
        small, queue, carry = Queues(self.memory // 4), Queues(self.memory // 4), np.full(_KINDS, -1, np.int16)
        bottom: list[int | None] = [None] * _KINDS  # the smallest S suffix of each first symbol
        for c in range(_KINDS - 1, -1, -1):
            while (entry := queue.pop(c)) is not None:
                for a in range(0, len(entry[0]), STEP):
                    p, v = entry[0][a : a + STEP], entry[1][a : a + STEP]
                    small.push(c, p, v)
                    self._induce(queue, p, v, carry, True)
                bottom[c] = int(entry[0][-1])
            ahead = self._meet(top[c], bottom[c])  # common prefix of the entry to come with the one just taken
            for p, v in large.read(c, backwards=True):
                p, turned = p[::-1], np.concatenate([[ahead], v[::-1][:-1]]).astype(np.uint8)
                ahead = int(v[0])
                self._induce(queue, p, turned, carry, True)
        for c in range(_KINDS):
            yield from large.read(c)
            ahead = self._meet(top[c], bottom[c])
            for p, v in small.read(c, backwards=True):
                # turned round, an entry's common prefix with the one before it is that of the entry generated next
                yield p[::-1], np.concatenate([[ahead], v[::-1][:-1]]).astype(np.uint8)
                ahead = int(v[0])


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both ends included."""
    if not len(low):
        return np.zeros(0, values.dtype)
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    return out
