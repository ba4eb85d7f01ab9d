"""Suffix order with common prefixes by external induced sorting.

A suffix is of type L if it is larger than the one that begins one symbol later, else of type S; an S
suffix after an L suffix is a star.  The pieces between stars are sorted and named, and the names are
a shorter text whose suffixes are sorted in the same way (recursion).  From the stars' order all L
suffixes follow in one ascending pass, and from those all S suffixes in a descending one: whenever a
suffix's turn comes, the tuple of the suffix before it (position, and the prefix it has in common
with the tuple before in its bucket) goes into a priority queue ordered by symbol, then arrival.

The queue, the text and the order are arrays that move to unnamed files beyond a stated size, so a task
can sort more than its memory; passes run over blocks of tuples.  Texts are pieces that each end
with symbol 0; nothing is common beyond it.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

import numpy as np

#: Bytes of a queue or of an order that stay in memory.
MEMORY = 48 << 20
#: Tuples whose range minima are taken at once, and tuples that a pass over a large alphabet orders at once.
BLOCK, BATCH = 1 << 18, 1 << 15
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Runs of a queue before they are merged.
RUNS = 256


def placed(array: np.ndarray, held: int) -> np.ndarray:
    """The array, in an unnamed file if it does not fit into MEMORY beside what is held already."""
    if held + array.nbytes <= MEMORY or not len(array):
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        return np.memmap(file, array.dtype, "r", shape=array.shape)


def in_memory(array: np.ndarray) -> int:
    return 0 if isinstance(array, np.memmap) else array.nbytes


def by_symbol(symbols: np.ndarray) -> np.ndarray:
    """The stable order of symbols below 2^31; larger ones than bytes are sorted together with their places, which numpy does faster than by a stable sort."""
    if symbols.dtype.itemsize <= 2:
        return np.argsort(symbols, kind="stable")
    return np.sort(symbols.astype(np.int64) << 32 | np.arange(len(symbols))) & 0xFFFFFFFF


@dataclass
class Queue:
    """Tuples by symbol and arrival; runs of them are sorted when they come and read from their fronts."""

    runs: list[list[np.ndarray]] = field(default_factory=list)

    def push(self, symbols: np.ndarray, *columns: np.ndarray) -> None:
        if len(symbols):
            order = by_symbol(symbols)
            self._add([symbols[order], *(c[order] for c in columns)])
            if len(self.runs) > RUNS:
                run = [np.concatenate(c) for c in zip(*self.runs, strict=True)]
                self.runs = []
                order = by_symbol(run[0])
                self._add([c[order] for c in run])

    def _add(self, run: list[np.ndarray]) -> None:
        held = sum(in_memory(c) for r in self.runs for c in r)
        self.runs.append([placed(c, held) for c in run])

    def pop(self, below: int) -> list[np.ndarray] | None:
        """Symbols and columns of all tuples with smaller symbols, in order; they leave the queue."""
        found, left = [], []
        for run in self.runs:
            kind = run[0].dtype.type  # a wider number would have the whole run converted
            n = len(run[0]) if below > np.iinfo(kind).max else int(run[0].searchsorted(kind(below)))
            if n:
                found.append([np.asarray(c[:n]) for c in run])
            if n < len(run[0]):
                left.append([c[n:] for c in run])
        self.runs = left
        if not found:
            return None
        run = [np.concatenate(c) for c in zip(*found, strict=True)]
        if min(int(r[0][0]) for r in found) == max(int(r[0][-1]) for r in found):  # one symbol: they are in order of arrival
            return run
        order = by_symbol(run[0])
        return [c[order] for c in run]


@dataclass
class Order:
    """Parts of an order, one after the other."""

    parts: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, part: np.ndarray) -> None:
        self.parts.append(placed(part, self.held))
        self.held += in_memory(self.parts[-1])

    def all(self, kind: type) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, kind)


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type L; the last one is S."""
    kind = np.zeros(len(text), bool)
    np.greater(text[:-1], text[1:], out=kind[:-1])
    same = np.flatnonzero(text[:-1] == text[1:])  # of the type of the suffix after the run
    if len(same):
        last = np.flatnonzero(np.append(np.diff(same) > 1, True))
        kind[same] = np.repeat(kind[same[last] + 1], np.diff(last, prepend=-1))
    return kind


def stars(text: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(kind[:-1] & ~kind[1:]) + 1).astype(np.int32 if len(text) < 1 << 31 else np.int64)


def words_of(text: np.ndarray, beyond: int = 8) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(beyond + 8, np.uint8)])
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def names(text: np.ndarray, size: int, at: np.ndarray, ends_alike: bool) -> np.ndarray:
    """The rank of the piece from each star to the next, that one's symbol included.

    A piece that another one goes on from is the larger of the two: its last symbol is of type S, the
    other's there is L.  If ends_alike, symbol 0 stands at the end of all texts: those pieces are ranked by
    place, the last text's first.
    """
    n = len(at)
    length = np.append(np.diff(at), 0) + 1
    rank = np.zeros(n, np.int64)
    first = text[at] == 0 if ends_alike else np.zeros(n, bool)
    zeros = int(first.sum())
    rank[first] = np.arange(zeros)[::-1]
    active, group = np.flatnonzero(~first), np.full(n - zeros, zeros, np.int64)
    is_bytes, bits = text.dtype == np.uint8, int(size).bit_length()
    together, offset = 8 if is_bytes else 63 // bits, 0
    words = words_of(text) if is_bytes else None
    while len(active):
        if is_bytes:  # eight at once, as a number; 255 stands for what is beyond a piece
            left = np.clip(length[active] - offset, 0, 8).astype(np.uint64)
            key = words[np.minimum(at[active] + offset, len(text))].byteswap() | np.where(left == 0, np.uint64(0), ONES >> (left * np.uint64(8) % np.uint64(64)))
            key[left == 0] = ONES
            key[left == 8] = words[at[active[left == 8]] + offset].byteswap()
        else:
            key = np.zeros(len(active), np.uint64)
            for t in range(offset, offset + together):
                inside = t < length[active]
                here = np.full(len(active), size, np.uint64)
                here[inside] = text[at[active[inside]] + t]
                key = key << np.uint64(bits) | here
        order = np.argsort(key)
        if offset:
            order = order[by_symbol(group[order])]
        active, group, key = active[order], group[order], key[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        opens = np.concatenate([[True], group[1:] != group[:-1]])
        index = np.arange(len(active))
        start = np.maximum.accumulate(np.where(opens, index, 0))
        group = group + np.maximum.accumulate(np.where(new, index, 0)) - start
        rank[active] = group
        offset += together
        runs = np.diff(np.append(np.flatnonzero(new), len(active)))
        more = np.add.reduceat((length[active] > offset).astype(np.int64), np.flatnonzero(new)) > 0
        keep = np.repeat((runs > 1) & more, runs)
        active, group = active[keep], group[keep]
    present = np.zeros(n, bool)
    present[rank] = True
    return (np.cumsum(present) - 1)[rank]


def _generations(symbols: np.ndarray, kind: np.ndarray, found: np.ndarray, seeds: int, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a batch of symbols from base to below size, with those that follow from them inside it, in order; and which of them are seeds.

    found has the tuples popped and then so many seeds, each in order.  What follows from a suffix of the
    batch stands after the popped ones of its symbol and before the seeds, in the order of the suffixes
    that it follows from, which settles one generation a round.
    """
    n, stage = len(found), np.zeros(len(found), np.int64)
    stage[n - seeds :] = 2
    place, parent, now, first = [], [], found, 0
    while len(now):
        ok = np.flatnonzero(now > 0)
        before = now[ok] - 1
        inside = np.flatnonzero(kind[before] & (symbols[before] < size))
        parent.append(first + ok[inside])
        first, now = first + len(now), before[inside]
        place.append(now)
    key = (symbols[found] - np.int64(base)) * 3 + stage
    order = np.argsort(key, kind="stable")  # of two ascending runs
    if len(place) < 2:
        return found[order], stage[order] == 2
    # only what follows is ordered again each round: it is little, as a rule
    follow, parent = np.concatenate(place), np.concatenate(parent)
    own = (symbols[follow] - np.int64(base)) * 3 + 1
    ascending, held = key[order], np.sort(own)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    from_found = np.flatnonzero(parent < n)
    behind = np.zeros(len(follow), np.int64)
    behind[from_found] = rank[parent[from_found]] + np.searchsorted(held, key[parent[from_found]])
    chained = np.flatnonzero(parent >= n)
    above, ahead, rank = parent[chained] - n, np.searchsorted(ascending, own), np.zeros(len(follow), np.int64)
    for _ in place[1:]:
        behind[chained] = ahead[above] + rank[above]
        rank[np.argsort(own << 32 | behind, kind="stable")] = np.arange(len(follow))
    out, is_seed = np.empty(n + len(follow), found.dtype), np.zeros(n + len(follow), bool)
    at = np.arange(n) + np.searchsorted(held, ascending)
    out[at], is_seed[at] = found[order], stage[order] == 2
    out[ahead + rank] = follow
    return out, is_seed


def induced(text: np.ndarray, kind: np.ndarray, seeds: np.ndarray, mirrored: bool) -> np.ndarray:
    """All suffixes for which kind holds, in order, given the seeds in order; mirrored: both in descending order."""
    top = size_of(text)
    symbols = (top - text if mirrored else text).astype(np.int32)
    counts = np.bincount(symbols[kind], minlength=top + 1)
    seed_symbols = symbols[seeds]
    counts += np.bincount(seed_symbols, minlength=top + 1)
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(counts) // BATCH)) + 1, top + 1)
    queue, out, low, taken = Queue(), Order(), 0, 0
    for high in np.unique(cuts).tolist():
        popped = queue.pop(high)
        until = int(np.searchsorted(seed_symbols, high))
        mine = seeds[taken:until]
        found = mine if popped is None else np.concatenate([popped[1], mine])
        taken = until
        if len(found):
            place, is_seed = _generations(symbols, kind, found, len(mine), low, high)
            out.add(place[~is_seed])
            before = place[place > 0] - 1
            before = before[kind[before]]
            to = symbols[before]
            on = to >= high
            queue.push(to[on], before[on])
        low = high
    return out.all(seeds.dtype)


def size_of(text: np.ndarray) -> int:
    return int(text.max(initial=0))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a text whose last symbol is its smallest and occurs once."""
    kind = types(text)
    order = star_order(text, kind, False)
    large = induced(text, kind, order, False)
    small = induced(text, ~kind & (np.arange(len(text)) < len(text) - 1), large[::-1], True)
    return _merged(text, large, np.append(small, small.dtype.type(len(text) - 1))[::-1])[0]


def star_order(text: np.ndarray, kind: np.ndarray, ends_alike: bool) -> np.ndarray:
    """The stars in the order of their suffixes."""
    at = stars(text, kind)
    called = names(text, size_of(text) + 1, at, ends_alike)
    if len(at) == 0 or called.max() + 1 == len(at):
        return at[np.argsort(called)]
    return at[suffix_order(called.astype(np.int32))]


def _merged(text: np.ndarray, large: np.ndarray, small: np.ndarray, *values: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """L and S suffixes in one order: by symbol, L first; and their values."""
    out = []
    symbols = text[large], text[small]
    n = [np.bincount(s, minlength=size_of(text) + 1) for s in symbols]
    ends = np.cumsum(n[0] + n[1])
    first = ends - n[0] - n[1]
    to = (
        np.arange(len(large)) + (first - (np.cumsum(n[0]) - n[0]))[symbols[0]],
        np.arange(len(small)) + (first + n[0] - (np.cumsum(n[1]) - n[1]))[symbols[1]],
    )
    for pair in ((large, small), *values):
        whole = np.empty(len(large) + len(small), pair[0].dtype)
        whole[to[0]], whole[to[1]] = pair
        out.append(whole)
    return tuple(out)


def common(text: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The prefix, up to most bytes, that each suffix has in common with the one before it in order; left: bytes up to the next end."""
    words = words_of(text, most)
    out = np.minimum(left[order], most)
    out[1:] = np.minimum(out[1:], out[:-1])
    out[:1] = 0
    pairs = np.flatnonzero(out)
    for offset in range(0, most, 8):
        x = words[order[pairs] + offset] ^ words[order[pairs - 1] + offset]
        differs = x != 0
        at, x = pairs[differs], x[differs]
        equal = (np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1) >> 3  # whole bytes below the lowest bit that differs
        out[at] = np.minimum(out[at], offset + equal)
        pairs = pairs[~differs]
        pairs = pairs[out[pairs] > offset + 8]
    return out


def _minima(values: np.ndarray, codes: np.ndarray, at: np.ndarray, since: np.ndarray) -> np.ndarray:
    """For each tuple at a place of the block, the least value since the tuple of the same code before it.

    since has, by code, the least value since that code's last tuple of earlier blocks, and is brought up to date.
    """
    order = np.argsort(codes, kind="stable")
    code, place = codes[order], at[order]
    fresh = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    low = np.where(fresh, 0, np.roll(place, 1) + 1)
    width = place - low + 1
    out = np.empty(len(place), values.dtype)
    if len(place):  # a table of the minima over 1, 2, 4, ... tuples: two of them cover any width
        steps = (np.frexp(width)[1] - 1).astype(np.uint8)
        by_step, table = np.argsort(steps, kind="stable"), values
        bounds = np.searchsorted(steps[by_step], np.arange(int(steps.max()) + 2))
        for level in range(len(bounds) - 1):
            table = table if level == 0 else np.minimum(table[: -(1 << (level - 1))], table[1 << (level - 1) :])
            here = by_step[bounds[level] : bounds[level + 1]]
            out[here] = np.minimum(table[low[here]], table[place[here] + 1 - (1 << level)])
    out[fresh] = np.minimum(out[fresh], since[code[fresh]])
    after = np.minimum.accumulate(np.append(values, np.iinfo(values.dtype).max)[::-1])[::-1]
    since[:] = np.minimum(since, after[0])
    last = np.concatenate([code[1:] != code[:-1], [True]]) if len(code) else fresh
    since[code[last]] = after[place[last] + 1]
    back = np.empty(len(out), values.dtype)
    back[order] = out
    return back


def _run(text: np.ndarray, at: int, most: int) -> int:
    """How often the symbol at a place repeats from there on, up to most."""
    same = text[at : at + most] == text[at]
    return int(len(same) if same.all() else np.argmin(same))


def induced_common(text: np.ndarray, kind: np.ndarray, seeds: np.ndarray, shared: np.ndarray, most: int, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """induced() over bytes, one symbol after the other, with the prefix that each suffix has in common with the one before it in its bucket; shared: that of the seeds."""
    queue, out, commons = Queue(), Order(), Order()
    seed_symbols = text[seeds]
    bounds = np.searchsorted(seed_symbols if not mirrored else 255 - seed_symbols, np.arange(257))
    for turn in range(256):
        c = 255 - turn if mirrored else turn
        popped = queue.pop(turn + 1)
        mine, mine_shared = (x[bounds[turn] : bounds[turn + 1]] for x in (seeds, shared))
        parts, values, generation = [], [], 0
        now, value = popped[1:] if popped else (seeds[:0], np.zeros(0, np.uint8))
        while len(now):  # those that begin with one c, then with two, ...
            value = value.copy()
            value[0] = min(generation, most)
            parts.append(now)
            values.append(value)
            ok = np.flatnonzero(now > 0)
            ok = ok[text[now[ok] - 1] == c]
            if len(ok):
                least = np.minimum.reduceat(value[: ok[-1] + 1], np.concatenate([[0], ok[:-1] + 1]))
                value = np.minimum(least.astype(np.int64) + 1, most).astype(np.uint8)
            now, generation = now[ok] - 1, generation + 1
        if parts:
            out.add(np.concatenate(parts))
            commons.add(np.concatenate(values))
        if len(mine):
            mine_shared = mine_shared.copy()
            mine_shared[0] = min(len(parts), _run(text, int(mine[0]), most)) if c else 0
            parts.append(mine)
            values.append(mine_shared)
        if not parts:
            continue
        scan, scan_common = np.concatenate(parts), np.concatenate(values)
        since = np.zeros(256, np.uint8)
        for start in range(0, len(scan), BLOCK):
            block, value = scan[start : start + BLOCK], scan_common[start : start + BLOCK]
            at = np.flatnonzero(block > 0)
            before = block[at] - 1
            ok = kind[before] & (text[before] != c)
            at, before = at[ok], before[ok]
            to = text[before]
            least = _minima(value, to, at, since)
            queue.push(255 - to if mirrored else to, before, np.minimum(least.astype(np.int64) + 1, most).astype(np.uint8))
    return out.all(seeds.dtype), commons.all(np.uint8)


def sorted_suffixes(text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of byte texts in order, and the prefix, up to most bytes, that each has in common with the one before it.

    text holds bytes from 1 to 254; a 0 stands before the first text and after each one.  Suffixes count
    as equal beyond ``most`` bytes or a text's end for what they have in common; their order goes on.
    """
    kind = types(text)
    ends = np.flatnonzero(text == 0)
    left = np.zeros(len(text), np.int32)
    left[1:] = np.repeat(ends[1:], np.diff(ends)) - np.arange(1, len(text))
    seeds = star_order(text, kind, True)
    large, large_common = induced_common(text, kind, seeds, common(text, left, seeds, most).astype(np.uint8), most, False)
    others = ~kind
    others[[0, -1]] = False
    down = np.concatenate([[0], large_common[:0:-1]]).astype(np.uint8) if len(large) else large_common
    small, small_common = induced_common(text, others, large[::-1], down, most, True)
    small, small_common = small[::-1], np.concatenate([small_common[1:], [0]]).astype(np.uint8)[::-1] if len(small) else small_common
    order, found = _merged(text, large, small, (large_common, small_common))
    # where a symbol's S suffixes follow its L suffixes, both begin with that symbol's run
    bucket = text[order]
    begin = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(order) else np.zeros(0, bool)
    found[begin | (bucket == 0)] = 0
    is_large = kind[order]
    for at in np.flatnonzero(~begin & (bucket > 0) & ~is_large & np.concatenate([[False], is_large[:-1]])).tolist():
        found[at] = min(_run(text, int(order[at]), most), _run(text, int(order[at - 1]), most))
    return order, found
