"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes run over many strings at once, and
vectorised binary search between the arrays of different shards."""

from __future__ import annotations

import numpy as np

SYMBOLS_A_KEY = 7  # nine bits a symbol: bytes are 1 to 256, 0 ends a string
PLACES = 256  # places of a string that one cursor of the common prefixes goes through


class Shard:
    """Strings laid end to end, a separator behind each, with their suffix array; windows are of `depth` symbols."""

    def __init__(self, strings: list[bytes], depth: int):
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.depth = depth
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.lengths = lengths
        raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
        self.text = raw.astype(np.uint16) + 1
        self.text[self.starts + lengths] = 0
        eights = np.concatenate([raw, np.zeros(depth + 16, np.uint8)])
        self.eights = np.ndarray((len(eights) - 7,), dtype=">u8", buffer=eights, strides=(1,)).astype(np.uint64)
        self.array, self.rank = refine(self.text)

    def common(self, most: int | None = None) -> np.ndarray:
        return kasai(self.text, self.array, self.rank, self.starts, self.lengths, most)

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Whether `depth` symbols of one string start at these places."""
        owner = np.searchsorted(self.starts, at, side="right") - 1
        return at + self.depth <= self.starts[owner] + self.lengths[owner]


def refine(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) of the suffixes of all strings; equal ones go by place, so no two share a rank.

    Sorts once by the first symbols, then doubles: only slots in groups of two or more are sorted again, by the
    rank of what follows. Members of a group all reach at least as far as they are sorted, so what follows lies in
    their own strings, and a suffix that ends there is alone already.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(SYMBOLS_A_KEY, text.dtype)]).astype(np.uint64)
    key, ended = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    for k in range(SYMBOLS_A_KEY):
        ended |= padded[k : n + k] == 0
        key = key << np.uint64(9) | np.where(ended, np.uint64(0), padded[k : n + k])
    array = np.argsort(key)
    short = np.flatnonzero(ended[array])
    ends = array[short]
    array[short] = ends[np.lexsort((ends, key[ends]))]
    ordered = key[array]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) | ended[array]
    rank = np.empty(n, dtype=np.int64)
    rank[array] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_ = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])))
    step = SYMBOLS_A_KEY
    while len(open_):
        at = array[open_]
        key = rank[at].astype(np.uint64) << np.uint64(32) | rank[at + step].astype(np.uint64)
        order = np.argsort(key)
        key, at = key[order], at[order]
        array[open_] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        open_ = open_[~(fresh & np.concatenate([fresh[1:], [True]]))]
        step *= 2
    return array, rank


def kasai(text: np.ndarray, array: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int | None = None) -> np.ndarray:
    """Symbols that each slot of the suffix array shares with the slot before, counted up to `most`.

    Going through a string from the left, the shared length falls by one symbol at most from place to place.
    Cursors set PLACES apart advance together, each by one comparison or one place a round, so the rounds do not
    grow with the longest string.
    """
    out = np.zeros(len(array), dtype=np.int32)
    per = -(-lengths // PLACES)
    owner = np.repeat(np.arange(len(starts)), per)
    at = starts[owner] + PLACES * (np.arange(len(owner)) - (np.cumsum(per) - per)[owner])
    end = np.minimum(at + PLACES, (starts + lengths)[owner])
    h = np.zeros(len(at), dtype=np.int64)
    most = len(text) if most is None else most
    while len(at):
        slot = rank[at]
        before = array[np.maximum(slot - 1, 0)]
        x = text[at + h]
        same = (x == text[before + h]) & (x > 0) & (slot > 0) & (h < most)
        done = ~same
        out[slot[done]] = h[done]
        at = at + done
        h = np.where(same, h + 1, np.maximum(h - 1, 0))
        go = at < end
        if not go.all():
            at, end, h = at[go], end[go], h[go]
    return out


def _words(shard: Shard, at: np.ndarray, k: int) -> np.ndarray:
    """Eight bytes from 8k behind each place as big-endian numbers, cut at the depth."""
    raw = shard.eights[at + 8 * k]
    over = 8 * (k + 1) - shard.depth
    return raw >> np.uint64(8 * over) if over > 0 else raw


def _less(a: Shard, pa: np.ndarray, b: Shard, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is less, is equal) of the whole windows at pa in a and pb in b."""
    less, open_ = np.zeros(len(pa), dtype=bool), np.arange(len(pa))
    for k in range(-(-a.depth // 8)):
        x, y = _words(a, pa[open_], k), _words(b, pb[open_], k)
        less[open_] = x < y
        open_ = open_[x == y]
        if not len(open_):
            break
    equal = np.zeros(len(pa), dtype=bool)
    equal[open_] = True
    return less, equal


def search(a: Shard, sorted_a: np.ndarray, b: Shard, windows_b: np.ndarray) -> np.ndarray:
    """For each whole window of b, the slot of the equal window in sorted_a (distinct whole windows of a in order), or -1."""
    low, high = np.zeros(len(windows_b), dtype=np.int64), np.full(len(windows_b), len(sorted_a), dtype=np.int64)
    while len(go := np.flatnonzero(low < high)):
        mid = (low[go] + high[go]) // 2
        less, _ = _less(a, sorted_a[mid], b, windows_b[go])
        low[go] = np.where(less, mid + 1, low[go])
        high[go] = np.where(less, high[go], mid)
    found = np.full(len(windows_b), -1, dtype=np.int64)
    if len(sorted_a):
        in_ = np.flatnonzero(low < len(sorted_a))
        _, equal = _less(a, sorted_a[low[in_]], b, windows_b[in_])
        found[in_[equal]] = low[in_[equal]]
    return found


def repeated_windows(strings: list[bytes], origin: np.ndarray, depth: int, shard_bytes: int = 1 << 20) -> list[np.ndarray]:
    """By string, the places whose `depth` bytes also stand at a place of smaller origin.

    A place's origin is its string's origin plus its place. Strings are dealt to shards of about shard_bytes;
    equal windows inside a shard are runs of its suffix array whose common prefixes reach the depth, and between
    shards they are met by binary search of one shard's distinct windows in the other's.
    """
    cuts, size = [0], 0
    for i, s in enumerate(strings):
        if size and size + len(s) > shard_bytes:
            cuts.append(i)
            size = 0
        size += len(s) + 1
    cuts.append(len(strings))
    shards = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        shard = Shard(strings[a:b], depth)
        shared = shard.common(depth)
        whole = np.flatnonzero(shard.whole(shard.array))
        # Slots between two whole windows hold shorter suffixes only if those windows differ.
        place = shard.array[whole]
        group = np.cumsum(np.concatenate([[True], (shared[whole[1:]] < depth) | (np.diff(whole) > 1)])) - 1 if len(whole) else whole
        owner = np.searchsorted(shard.starts, place, side="right") - 1
        age = origin[a:b][owner] + place - shard.starts[owner]
        least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, age)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
        shards.append((shard, a, place, group, owner, age, least, place[first]))
    # In this order the first shard that holds a window always knows its smallest origin so far and hands it on.
    for j in range(len(shards)):
        for i in range(j):
            (sa, *_, least_a, rep_a), (sb, *_, least_b, rep_b) = shards[i], shards[j]
            met = search(sa, rep_a, sb, rep_b)
            hit = np.flatnonzero(met >= 0)
            both = np.minimum(least_a[met[hit]], least_b[hit])
            least_a[met[hit]] = both
            least_b[hit] = both
    out = [np.zeros(0, dtype=np.int64)] * len(strings)
    for shard, a, place, group, owner, age, least, _ in shards:
        later = age > least[group] if len(group) else np.zeros(0, bool)
        own, at = owner[later], (place - shard.starts[owner])[later]
        order = np.lexsort((at, own))
        own, at = own[order], at[order]
        bounds = np.searchsorted(own, np.arange(len(shard.starts) + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            out[a + k] = at[bounds[k] : bounds[k + 1]]
    return out
