"""Winnowed anchors and external induced suffix sorting with common prefixes, in numpy."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from .text_kernels import U, mix64, powers, prefix_hash, span_hash

#: A piece of a very long text that is worked on at once; pieces overlap so that every window is whole in one.
PIECE = 1 << 18
#: Numbers of an array that is kept in memory; longer ones are files. Suffixes that are induced from at once.
IN_MEMORY, BATCH = 1 << 20, 1 << 20
#: Names of a reduced string that are ordered in memory; longer ones by recursion.
MOST_NAMES = 4 << 20
#: Digits that names are written in for the recursion.
DIGIT = 16
_BITS = 26


def pieces(offsets: np.ndarray, width: int):
    """Groups of (row, start, end) of about PIECE bytes in all; every window of ``width`` bytes is in exactly one."""
    group, size = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = a
        while b - at >= width:
            end = min(b, at + PIECE + width - 1)
            if size and size + end - at > PIECE:
                yield group
                group, size = [], 0
            group.append((row, at, end))
            size += end - at
            at = end - width + 1
    if group:
        yield group


def anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hash of the bytes, hashes of all grams, and for each window of ``width`` bytes the place of its anchor.

    A window's anchor is the gram of least hash in it, the first of equals, so equal windows have equal anchors.
    """
    sums = prefix_hash(data)
    n = len(data)
    h = mix64((sums[gram:] - sums[:-gram]) * powers(n + 1, True)[: n - gram + 1])
    m = ((h >> U(_BITS)) << U(_BITS)) | np.arange(len(h), dtype=U)
    reach, span = width - gram + 1, 1
    while 2 * span <= reach:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    count = n - width + 1
    m = np.minimum(m[:count], m[reach - span : reach - span + count]) if span < reach else m[:count]
    return sums, h, (m & U((1 << _BITS) - 1)).astype(np.int64)


def runs_of(data: np.ndarray, bounds: np.ndarray, width: int, gram: int):
    """(text, first window start in it, windows, anchor's hash, two digests of the run's bytes) of texts data[bounds[k]:bounds[k+1]].

    A run is a stretch of windows with one anchor; windows over a border between texts are left out. The digests have
    64 bits each, of independent bases.
    """
    sums, h, at = anchors(data, width, gram)
    count = len(at)
    cover = np.zeros(count + 1, np.int64)
    np.add.at(cover, np.minimum(np.maximum(bounds[1:] - width + 1, bounds[:-1]), count), 1)
    np.add.at(cover, np.minimum(bounds[1:], count), -1)
    valid = np.cumsum(cover[:-1]) == 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    text = np.searchsorted(bounds, lo, "right") - 1
    second = span_hash(prefix_hash(data, False, 1), lo, hi + width, 1)
    return text, lo - bounds[text], hi - lo + 1, h[at[lo]], span_hash(sums, lo, hi + width), second


class Scratch:
    """Arrays of one task: in memory up to ``limit`` numbers, beyond that in files that go with the array."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.step = limit, max(16, min(limit, BATCH))

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.limit:
            return np.zeros(n, dtype)
        with tempfile.TemporaryFile(prefix="fq-suffix-") as file:
            file.truncate(n * np.dtype(dtype).itemsize)
            return np.asarray(np.memmap(file, dtype, "r+", shape=(n,)))

    def ranges(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.step):
            yield a, min(n, a + self.step)


def _kinds(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Whether each suffix is smaller than the next one (type S); the last one is. From the end, block by block."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = True
    for b in range(n - 1, 0, -scratch.step):
        a = max(0, b - scratch.step)
        here = text[a : b + 1].astype(np.int32)
        step = np.sign(here[1:] - here[:-1])
        following = np.minimum.accumulate(np.where(step != 0, np.arange(b - a), b - a)[::-1])[::-1]  # where the run of equal symbols ends
        out[a:b] = np.append(step > 0, out[b])[following]
    return out


def _seeds(small: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Leftmost S suffixes, in text order."""
    n = len(small)
    found = lambda a, b: a + np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1])
    parts = [(max(a, 1), b) for a, b in scratch.ranges(n)]
    sizes = [len(found(a, b)) for a, b in parts]
    out = scratch.array(sum(sizes), np.int32 if n < 1 << 31 else np.int64)
    at = 0
    for (a, b), size in zip(parts, sizes, strict=True):
        out[at : at + size] = found(a, b)
        at += size
    return out


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a..b]) for each pair a <= b, by minima of stretches of 1, 2, 4, ... numbers."""
    k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), x.dtype)
    for j in range(int(k.max(initial=-1)) + 1):
        if j:
            x = np.minimum(x[: -(1 << (j - 1))], x[1 << (j - 1) :])
        at = np.flatnonzero(k == j)
        out[at] = np.minimum(x[a[at]], x[b[at] - (1 << j) + 1])
    return out


class Induction:
    """Induced sorting: a priority queue of suffixes by leading symbol and, within one, in the order of arrival.

    The queue is one array (a file beyond ``scratch.limit``) with a stretch for each symbol, suffixes that are larger
    than the next one at its start, smaller ones at its end, so what has left the queue is the suffix array. With
    seeds' common prefixes the queue also carries each entry's common prefix with its neighbour, up to ``cap``: one
    more than the least that the suffixes had that the two were induced from, and all between.
    """

    def __init__(self, text: np.ndarray, small: np.ndarray, symbols: int, cap: int, scratch: Scratch):
        self.text, self.symbols, self.cap, self.scratch = text, symbols, cap, scratch
        total, low = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
        for a, b in scratch.ranges(len(text)):
            total += np.bincount(text[a:b], minlength=symbols)
            low += np.bincount(text[a:b][small[a:b]], minlength=symbols)
        self.ends = np.cumsum(total)
        self.starts, self.middle, self.used = self.ends - total, self.ends - low, np.flatnonzero(total).tolist()

    def by_symbol(self, seeds: np.ndarray) -> np.ndarray:
        """The seeds by leading symbol, otherwise as they come."""
        count = np.zeros(self.symbols, np.int64)
        for a, b in self.scratch.ranges(len(seeds)):
            count += np.bincount(self.text[seeds[a:b]], minlength=self.symbols)
        at = np.cumsum(count) - count
        out = self.scratch.array(len(seeds), seeds.dtype)
        for a, b in self.scratch.ranges(len(seeds)):
            p = np.array(seeds[a:b])
            s = self.text[p]
            by = np.argsort(s, kind="stable")
            p, s = p[by], s[by]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(first, len(s)))
            out[np.repeat(at[s[first]] - first, size) + np.arange(len(s))] = p
            at[s[first]] += size
        return out

    def _push(self, p: np.ndarray, common: np.ndarray | None, c: int, up: bool, equal: bool) -> None:
        """Queue the suffixes before those of ``p`` that the pass induces; ``common``: prefix shared with the one before in ``p``."""
        at = np.flatnonzero(p > 0)
        q = p[at] - 1
        s = self.text[q]
        ok = (s > c) if up else (s < c)
        if equal:
            ok |= s == c
        at, q, s = at[ok], q[ok], s[ok]
        if len(at):
            by = np.argsort(s, kind="stable")
            at, q, s = at[by], q[by], s[by]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            sym, size = s[first].astype(np.int64), np.diff(np.append(first, len(s)))
            within = np.arange(len(s)) - np.repeat(first, size)
            to = np.repeat(self.tail[sym], size) + (within if up else -1 - within)
            self.tail[sym] += size if up else -size
            self.order[to] = q
        if common is None:
            return
        if len(at):
            before = np.append(0, at[:-1] + 1)
            before[first] = 0
            value = _range_min(common, before, at)
            value[first] = np.minimum(value[first], self.since[sym])
            self.common[to if up else to + 1] = np.minimum(value + 1, self.cap)
        np.minimum(self.since, common.min(), out=self.since)
        if len(at):
            last = at[np.append(first[1:], len(at)) - 1]
            after = np.append(np.minimum.accumulate(common[::-1])[::-1], np.int16(1 << 14))
            self.since[sym] = after[last + 1]

    def _run(self, p: int, c: int) -> int:
        """How often the suffix repeats its leading symbol, up to ``cap``."""
        here = np.array(self.text[p : p + self.cap])
        return int(np.argmin(np.append(here == c, False)))

    def run(self, seeds: np.ndarray, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """All suffixes in order, and each one's common prefix with the one before, from the seeds in theirs."""
        n, carried = len(self.text), common is not None
        self.order = self.scratch.array(n, seeds.dtype)
        self.common = self.scratch.array(n + 1, np.uint8) if carried else None
        self.tail, self.since = self.starts.copy(), np.full(self.symbols, -1, np.int16)
        got = lambda a, b: self.common[a:b].astype(np.int16) if carried else None
        seeded = 0
        for c in self.used:
            i = int(self.starts[c])
            while i < self.tail[c]:
                j = min(int(self.tail[c]), i + self.scratch.step)
                self._push(np.array(self.order[i:j]), got(i, j), c, True, True)
                i = j
            top = seeded
            while seeded < len(seeds):
                p = np.array(seeds[seeded : seeded + self.scratch.step])
                p = p[: int(np.argmin(np.append(self.text[p] == c, False)))]
                if not len(p):
                    break
                x = common[seeded : seeded + len(p)].astype(np.int16) if carried else None
                if carried and seeded == top:
                    x[0] = min(self._run(int(self.order[i - 1]), c), self._run(int(p[0]), c)) if i > self.starts[c] else 0
                self._push(p, x, c, True, False)
                seeded += len(p)
        self.tail, self.since = self.ends.copy(), np.full(self.symbols, -1, np.int16)
        self.order[0] = n - 1  # the end mark
        self.tail[0] = 0
        for c in reversed(self.used):
            j = int(self.ends[c])
            while j > self.tail[c]:
                i = max(int(self.tail[c]), j - self.scratch.step)
                self._push(np.array(self.order[i:j])[::-1], got(i + 1, j + 1)[::-1] if carried else None, c, False, True)
                j = i
            if carried and self.starts[c] < j < self.ends[c]:
                self.common[j] = min(self._run(int(self.order[j - 1]), c), self._run(int(self.order[j]), c))
            while j > self.starts[c]:
                i = max(int(self.starts[c]), j - self.scratch.step)
                self._push(np.array(self.order[i:j])[::-1], got(i + 1, j + 1)[::-1] if carried else None, c, False, False)
                j = i
        return self.order, self.common


def _names(text: np.ndarray, seeds: np.ndarray, order: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Names of the stretches from each seed to the next one, in text order, equal where they are; how many there are."""
    n, m = len(text), len(seeds)
    stretch, place = scratch.array(m, U), scratch.array(n // 2 + 1, seeds.dtype)
    k = 0
    while k < m:
        begin = int(seeds[k])
        j = k + max(1, int(np.searchsorted(seeds[k : k + scratch.step], begin + scratch.step, "right")) - 1)
        j = min(j, m)
        end = int(seeds[j]) if j < m else n
        own = np.array(seeds[k:j], np.int64) - begin
        size = np.diff(np.append(own, end - begin))
        code = mix64(text[begin:end].astype(U) + U(1)) * powers(int(size.max()) + 1)[np.arange(end - begin) - np.repeat(own, size)]
        following = np.append(text[begin:end][own[1:]], text[end] if end < n else 0).astype(U)
        stretch[k:j] = mix64(np.add.reduceat(code, own) + mix64(following + U(1)) * powers(int(size.max()) + 1)[size] + size.astype(U))
        place[np.array(seeds[k:j]) // 2] = np.arange(k, j)  # seeds are two symbols apart at least
        k = j
    name, last, made = scratch.array(m, np.int64), None, -1
    for a, b in scratch.ranges(m):
        at = place[np.array(order[a:b]) // 2]
        h = stretch[at]
        new = np.append(last is None or h[0] != last, h[1:] != h[:-1])
        name[at] = made + np.cumsum(new)
        made, last = int(name[at[-1]]), h[-1]
    return name, made + 1


def _order_names(name: np.ndarray, count: int, depth: int, text_size: int, scratch: Scratch, most: int) -> np.ndarray:
    """Places of the reduced string in the order of its suffixes, by as many names as ``depth`` symbols have at most.

    In memory by doubling; a string of over ``most`` names is written in digits and sorted by recursion, which ends
    because there are at most half as many names as symbols.
    """
    m = len(name)
    if m > most and 2 * m + 1 < 0.95 * text_size:
        low = (1 << DIGIT) - 1
        digits = scratch.array(2 * m + 1, np.int32)
        for a, b in scratch.ranges(m):
            digits[2 * a : 2 * b : 2], digits[2 * a + 1 : 2 * b : 2] = (name[a:b] >> DIGIT) + 1, (name[a:b] & low) + 1
        whole = suffix_array(digits, 2 * depth, (count >> DIGIT) + low + 3, scratch, most)[0]
        out, at = scratch.array(m, np.int64), 0
        for a, b in scratch.ranges(len(whole)):
            p = np.array(whole[a:b], np.int64)
            p = p[(p % 2 == 0) & (p < 2 * m)] // 2
            out[at : at + len(p)] = p
            at += len(p)
        return out
    name, reach = np.array(name), 1
    while 2 * reach < depth and count < m:
        key = (name + 1) * (m + 2) + np.append(name[reach:] + 1, np.zeros(min(reach, m), np.int64))[:m]
        by = np.argsort(key)
        name[by] = np.cumsum(np.append(0, (key[by][1:] != key[by][:-1]).astype(np.int64)))
        count = int(name[by[-1]]) + 1
        reach *= 2
    return np.argsort(name)


def suffix_array(text: np.ndarray, depth: int, symbols: int = 258, scratch: Scratch | None = None, most: int = MOST_NAMES, cap: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffixes of ``text`` by their first ``depth`` symbols at least, and common prefixes of neighbours up to ``cap``.

    Its last symbol is 0, the others 1 to ``symbols`` - 1; ``cap`` is at most ``depth`` and 250, and none are given for
    0. Leftmost S suffixes are sorted by induction, named, and ordered by their names; the order of all suffixes and
    their common prefixes are induced from theirs. Arrays longer than ``scratch.limit`` are files.
    """
    scratch, n = scratch or Scratch(), len(text)
    if n < 2:
        return np.arange(n), np.zeros(n + 1, np.uint8)
    small = _kinds(text, scratch)
    seeds = _seeds(small, scratch)
    sorting = Induction(text, small, symbols, cap, scratch)
    if len(seeds) > 1:
        whole, _ = sorting.run(sorting.by_symbol(seeds), None)
        order, at = scratch.array(len(seeds), seeds.dtype), 0
        for a, b in scratch.ranges(n):
            p = np.array(whole[a:b])
            p = p[small[p] & ~small[p - 1] & (p > 0)]
            order[at : at + len(p)] = p
            at += len(p)
        name, count = _names(text, seeds, order, scratch)
        places = _order_names(name, count, depth, n, scratch, most)
        for a, b in scratch.ranges(len(seeds)):
            order[a:b] = seeds[places[a:b]]
        seeds = order
    common = None
    if cap:
        common = scratch.array(len(seeds), np.uint8)
        reach = np.arange(cap)
        step = max(1, scratch.step // cap)
        for a in range(0, len(seeds), step):
            p = np.array(seeds[max(a - 1, 0) : a + step], np.int64)
            rows = text[np.minimum(p[:, None] + reach, n - 1)]
            differ = np.append(rows[1:] != rows[:-1], np.ones((len(rows) - 1, 1), bool), axis=1)
            common[max(a, 1) : max(a - 1, 0) + len(p)] = np.argmax(differ, axis=1)
    return sorting.run(seeds, common)


def first_owner(data: np.ndarray, ends: np.ndarray, owners: np.ndarray, width: int, scratch: Scratch | None = None, most: int = MOST_NAMES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, start, smallest owner) for every window of ``width`` bytes in the texts that end at ``ends`` that occurs again, in batches.

    Neighbouring suffixes with a common prefix of ``width`` symbols form a run, whose smallest owner is found.
    """
    if not len(ends):
        return
    scratch = scratch or Scratch()
    begin = np.append(0, ends[:-1]) + np.arange(len(ends))  # in the joined text, where every text has an end mark
    joined = scratch.array(int(ends[-1]) + len(ends) + 1, np.uint16)  # 1 ends a text, 0 ends all
    joined[: len(joined) - 1] = 1
    for a in range(0, len(ends), max(1, scratch.step // 64)):
        b = min(len(ends), a + max(1, scratch.step // 64))
        lo, hi = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        texts = np.repeat(np.arange(a, b), np.diff(np.append(lo, ends[a:b])))
        joined[np.arange(lo, hi) + texts] = data[lo:hi].astype(np.uint16) + 2
    order, common = suffix_array(joined, width, 258, scratch, most, width)
    stop = np.append(begin[1:] - 1, len(joined) - 2)
    least = scratch.array(len(order), np.int64)

    def batches():
        """(order, run of each, text of each) of windows that have an equal neighbour; those over an end mark are runs of their own."""
        run = -1
        for a, b in scratch.ranges(len(order)):
            as_before = common[a : b + 1] >= width
            at = run + np.cumsum(~as_before[:-1])
            run = int(at[-1])
            keep = np.flatnonzero(as_before[:-1] | as_before[1:])
            p, at = np.array(order[a:b][keep], np.int64), at[keep]
            of = np.searchsorted(begin, p, "right") - 1
            whole = p + width <= stop[of]
            yield p[whole], at[whole], of[whole]

    least[:] = np.iinfo(np.int64).max
    for _, at, of in batches():
        if len(at):
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            least[at[new]] = np.minimum(least[at[new]], np.minimum.reduceat(owners[of], new))
    for p, at, of in batches():
        yield of, p - begin[of], least[at]
