"""Near-duplicate passages through compact windows (operator 9).

A passage is 50 words or more. Its tokens are the hashes of its five-word
shingles; two passages are near duplicates when the Jaccard similarity of
their shingles is 0.8 or more and both begin and end with equal words.

1. The Cartesian tree over a text's shingle hashes gives compact windows
   (l, c, r): every subsequence of [l, r] that holds c has the min-hash of
   place c. Nodes whose window spans ``RUN`` shingles or more are kept.
2. One hash function is enough, and certain. Similarity 0.8 allows two passages
   that share s shingles s / 4 others between them. A changed, added or missing
   word costs 9 or more, so there are at most s / 36 changes, and the longest
   run of equal shingles has s / (s / 36 + 1) or more: 21 at least, as s is 41
   at least. In both texts that run's least shingle is the centre of a window
   that spans the run. So near passages always meet at an equal min-hash, with
   ten equal shingles on one side of it.
3. Windows are joined on min-hash and on the hash of the ten shingles on either
   side; min-hashes of one text only are dropped. Joined windows must overlap,
   with their centres aligned, over ``RUN`` shingles (interval join).
4. Candidates are verified on the words around the centre, as far as a passage
   of up to twice the least length reaches. A longer near passage has such a
   part, at one of its centres. First every member of a group is compared with
   the group's first, and then with all others that are not linked to it yet
   and that share enough shingles, found by rare shingles (prefix filter). So
   a crowd is linked throughout by about one link a member.
5. Verified parts that overlap in a text are one passage. Passages linked
   through others form a class.

The result has one row per passage of each text, with its class, and one row
per copy of a text (equal from end to end) with the first of the copies, whose
passages stand for all of them.

Groups beyond ``BLOCK`` members are dealt into blocks, every two of which meet.

Defined results: documents with a null doc_id cannot be named and are left
out; null, empty and short texts have no passages; passages repeated inside
one document only are not reported; a doc_id with several texts has the
passages of each; extra columns are ignored; an empty table gives an empty
result. Passages that repeat one phrase over and over may be near duplicates
with shorter equal runs, when only the number of repeats differs; these are not
searched for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, drop_scratch, materialize, n_shuffle, ship
from .components import connected_components

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
_LENGTH = MIN_WORDS - SHINGLE + 1
#: Shingles that two passages share at least: s / (2 * _LENGTH - s) >= SIMILARITY.
_SHARED = -(-8 * _LENGTH // 9)
#: Equal shingles in a row that two near passages have at least.
RUN = -(-_SHARED // (_SHARED // 36 + 1))
#: Equal shingles beside the least one of such a run, on one side at least.
SIDE = (RUN - 1) // 2
#: Shingles on both sides of a centre: a passage of up to twice the least length that holds it.
AROUND = 2 * _LENGTH - 1
#: Words around a centre.
_WIDTH = 2 * AROUND + SHINGLE
#: Members of a group that one task holds, twice.
BLOCK = 1 << 14
#: Members of a part of a group that are compared pair by pair.
SMALL = 16
#: Members of a component that others are tried with first.
_PROBES = 8
#: Pairs that are verified at once, and members that are gathered before.
_CHUNK = 1 << 12
#: Texts that are cut into windows at once.
_TEXTS = 32
#: Pairs that are aligned with shifts at once.
_SHIFTED = 1 << 8
#: Values of the fixed-size prefilter of texts that are fetched for verification.
FETCH_BUCKETS = 1 << 17
#: What a shingle that only one text has costs, when a shared one scores 1: shared / union >= SIMILARITY.
GAP = 4
#: Words that one text may have more than the other in a near passage.
SHIFT = (2 * AROUND + 1) // GAP - 2 * (SHINGLE - 1)
_NONE = -(1 << 20)
_PRIME = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
_POWER = np.cumprod(np.full(256, 0xD6E8FEB86659FD93, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
_FAR = np.cumprod(np.full(_WIDTH, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A hash of each byte.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words along the last axis."""
    m = words.shape[-1] - n + 1
    if m <= 0:
        return np.zeros((*words.shape[:-1], 0), dtype=np.uint64)
    out = np.zeros((*words.shape[:-1], m), dtype=np.uint64)
    for j in range(n):
        out += words[..., j : j + m] * _PRIME[j]
    return out


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space, A-Z in lower case, and the place of each word's first byte."""
    data = np.frombuffer(text.lower(), dtype=np.uint8)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    number = np.cumsum(first[inside]) - 1
    begin = np.flatnonzero(first[inside])
    place = np.arange(len(number)) - begin[number]
    power = _POWER if place.max() < len(_POWER) else np.cumprod(np.full(int(place.max()) + 1, _POWER[0], dtype=np.uint64))
    return _mix(np.add.reduceat(_BYTE[data[inside]] * power[place], begin)), starts


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    return _mix(_runs(words, SHINGLE)) | np.uint64(1)


def compact_windows(hashes: np.ndarray, length: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian tree's nodes that span ``length`` or more; r is exclusive, ties go left.

    A zero is no shingle but the border between two texts.
    """
    bound = np.concatenate([[np.uint64(0)], hashes, [np.uint64(0)]])
    real = np.flatnonzero(hashes) + 1
    left, right = np.arange(len(bound)) - 1, np.arange(len(bound)) + 1
    for to, beyond in ((left, np.greater), (right, np.greater_equal)):
        # everything between a place and where it points to is larger, so a pointer may follow that of its end
        todo = real
        while len(todo):
            at = to[todo]
            on = beyond(bound[at], bound[todo]) & (bound[at] > 0)
            todo, at = todo[on], at[on]
            to[todo] = to[at]
    wide = real[right[real] - left[real] - 1 >= length]
    return left[wide], wide - 1, right[wide] - 1


NODE_SCHEMA = "value long, sig long, c int, reach int, left int, right int"


def nodes_of(texts: list[bytes], sigs: np.ndarray) -> dict[str, np.ndarray]:
    """Compact windows of some texts as columns: min-hash, text, place, the window's reach on both sides, the shingles beside it."""
    words, starts = word_hashes(b"\n".join(texts))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    size = np.diff(ends, prepend=0)
    hashes = np.zeros(len(words), dtype=np.uint64)
    hashes[: max(len(words) - SHINGLE + 1, 0)] = shingle_hashes(words)
    hashes[np.repeat(size < MIN_WORDS, size)] = 0
    for j in range(1, SHINGLE):
        hashes[ends[size >= MIN_WORDS] - j] = 0  # shingles that reach into the next text
    l, c, r = compact_windows(hashes)
    owner = np.searchsorted(ends, c, side="right")
    beside = (_mix(_runs(words, SIDE + SHINGLE - 1)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    # ten shingles end before the centre, or begin after it
    left = np.where(c - l >= SIDE, beside[np.clip(c - SIDE, 0, max(len(beside) - 1, 0))], 0) if len(c) else c.astype(np.int32)
    right = np.where(r - 1 - c >= SIDE, beside[np.clip(c + 1, 0, max(len(beside) - 1, 0))], 0) if len(c) else c.astype(np.int32)
    reach = np.minimum(c - l, AROUND) << 8 | np.minimum(r - 1 - c, AROUND)
    # of the places of a short phrase that is repeated on and on, the first and the last are enough
    by = np.lexsort((c, left, right, hashes[c], owner))
    step = np.diff(c[by])
    step[np.any([np.diff(v[by].astype(np.int64)) != 0 for v in (owner, hashes[c].view(np.int64), left, right)], axis=0) | (step > 2 * SIDE + SHINGLE)] = 0
    between = np.zeros(len(c), dtype=bool)
    between[by[1:-1]] = (step[1:] == step[:-1]) & (step[1:] > 0)
    l, c, r, owner, left, right, reach = (v[~between] for v in (l, c, r, owner, left, right, reach))
    start = ends - size
    return {
        "value": _mix(hashes[c]).view(np.int64),
        "sig": sigs[owner],
        "c": (c - start[owner]).astype(np.int32),
        "reach": reach.astype(np.int32),
        "left": left.astype(np.int32),
        "right": right.astype(np.int32),
    }


def windows(texts: DataFrame) -> DataFrame:
    """Compact windows of ``texts(sig, text)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                found = nodes_of(part.column(1).to_pylist(), part.column(0).to_numpy())
                if len(found["c"]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], list(found))

    return texts.select("sig", "text").mapInArrow(make, NODE_SCHEMA)


# --- verification -----------------------------------------------------------


def match(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether words around aligned centres (one pair a row) have a near passage without a shift that holds the centre.

    Returns (found, first shingle, last shingle, shared shingles, whether the run of equal shingles holds the centre's shingle just once).
    """
    equal = (x == y) & (x != 0)
    shared = equal[:, : 2 * AROUND + 1].copy()
    for j in range(1, SHINGLE):
        shared &= equal[:, j : j + 2 * AROUND + 1]
    both = (x != 0) & (y != 0)
    there = both[:, : 2 * AROUND + 1] & both[:, SHINGLE - 1 :]
    # 9 * shared >= 8 * length, as a sum over places
    weight = np.where(shared, 1, -8).astype(np.int32)
    after = np.cumsum(weight[:, AROUND:], axis=1)
    before = np.concatenate([np.zeros((len(x), 1), dtype=np.int32), np.cumsum(weight[:, AROUND - 1 :: -1], axis=1)], axis=1)
    none = np.int32(-(1 << 20))
    # a passage begins and ends with equal words
    after = np.where(equal[:, AROUND + SHINGLE - 1 :] & there[:, AROUND:], after, none)
    before = np.where(equal[:, AROUND::-1][:, : AROUND + 1] & there[:, AROUND::-1], before, none)
    best_after = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
    need = np.maximum(_LENGTH - 1 - np.arange(AROUND + 1), 0)
    total = before + best_after[:, need]
    k = total.argmax(axis=1)
    row = np.arange(len(x))
    found = (total[row, k] >= 0) & shared[:, AROUND]
    want = best_after[row, need[k]]
    far = AROUND - (after[:, ::-1] == want[:, None]).argmax(axis=1)
    length = k + far + 1
    end = np.ones((len(x), 1), dtype=bool)
    behind = np.argmax(np.concatenate([~shared[:, AROUND:], end], axis=1), axis=1)
    ahead = np.argmax(np.concatenate([~shared[:, AROUND::-1], end], axis=1), axis=1)
    again = np.ones((len(x), 2 * AROUND + 1), dtype=bool)
    for j in range(SHINGLE):
        again &= x[:, j : j + 2 * AROUND + 1] == x[:, AROUND + j, None]
    place = np.arange(2 * AROUND + 1)
    once = (again & (place > AROUND - ahead[:, None]) & (place < AROUND + behind[:, None])).sum(axis=1) == 1
    return found, AROUND - k, AROUND + far, (total[row, k] + 8 * length) // 9, once


def _aligned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(row, places behind the centre in x, shift in y): the best score of an alignment from the centre to there.

    x and y hold the centre's shingle at 0. A shared shingle scores 1, one that
    only either text has costs 4, so that a passage is near when its sum is 0
    or more. Only places where equal words end have a score.
    """
    n, m = len(x), AROUND + 1
    width = 2 * SHIFT + 1
    pad = np.zeros((n, SHIFT), dtype=x.dtype)
    wide = np.concatenate([pad, y, pad], axis=1)
    beyond = np.arange(width, dtype=np.int32) * GAP
    least = np.int32(_NONE)
    now = np.where(np.arange(width) >= SHIFT, SHIFT * GAP - beyond, least).astype(np.int32) + np.zeros((n, 1), dtype=np.int32)
    out = np.full((n, m, width), least, dtype=np.int32)
    out[:, 0, SHIFT] = 0
    equal = np.stack([(x[:, j, None] == wide[:, j : j + width]) & (x[:, j, None] != 0) for j in range(m + SHINGLE - 1)], axis=1)
    shared = equal[:, :m].copy()
    for j in range(1, SHINGLE):
        shared &= equal[:, j : j + m]
    for k in range(1, m):
        best = now - GAP  # x alone goes on, which shifts y back
        best[:, :-1] = best[:, 1:]
        best[:, -1] = least
        best = np.maximum(best, np.where(shared[:, k], now + 1, least))
        # y alone goes on
        now = np.maximum(np.maximum.accumulate(best + beyond, axis=1) - beyond, least)
        out[:, k] = np.where(equal[:, k + SHINGLE - 1] & (wide[:, k : k + width] != 0), now, least)
    return out


def match_shifted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """As :func:`match`, with words that one text has more than the other.

    Returns (found, first shingle in x, last in x, first in y, last in y, shared shingles).
    """
    sides = []
    for flip in (False, True):
        u, v = (w[:, ::-1] if flip else w for w in (x, y))
        score = _aligned(u[:, AROUND:], v[:, AROUND:])
        k, shift = np.arange(AROUND + 1)[:, None], np.arange(-SHIFT, SHIFT + 1)
        reach = np.minimum(k, k + shift)  # of the text that goes less far
        flat = score.reshape(len(x), -1)
        order = np.argsort(-np.maximum(reach, 0).ravel(), kind="stable")
        # the best score of those that reach at least so far
        best = np.maximum.accumulate(flat[:, order], axis=1)
        last = np.searchsorted(-np.maximum(reach, 0).ravel()[order], -np.arange(AROUND + 1), side="right") - 1
        sides.append((flat, best[:, last], np.maximum(reach, 0).ravel()))
    (flat_r, right, reach), (flat_l, left, _) = sides
    need = np.maximum(_LENGTH - 1 - np.arange(AROUND + 1), 0)
    total = left + right[:, need]
    u = total.argmax(axis=1)
    row = np.arange(len(x))
    found = total[row, u] >= 0
    places = []
    for flat, want, least in ((flat_l, left[row, u], u), (flat_r, right[row, need[u]], need[u])):
        # of equal scores the farthest
        at = np.where((flat == want[:, None]) & (reach >= least[:, None]), reach, -1).argmax(axis=1)
        k, shift = at // (2 * SHIFT + 1), at % (2 * SHIFT + 1) - SHIFT
        places.append((k, k + shift))
    (lx, ly), (rx, ry) = places
    lengths = lx + rx + ly + ry + 2
    # score = shared - GAP * (lengths - 2 * shared); the centre's own shingle scores 1 too
    shared = (total[row, u] + 1 + GAP * lengths) // (2 * GAP + 1)
    return found, AROUND - lx, AROUND + rx, AROUND - ly, AROUND + ry, shared


def run_around(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether ``RUN`` equal shingles in a row hold the centre, for words around aligned centres, one pair a row."""
    lo, hi = AROUND - RUN + 1, AROUND + SHINGLE + RUN - 1
    equal = (x[..., lo:hi] == y[..., lo:hi]) & (x[..., lo:hi] != 0)
    before = np.logical_and.accumulate(equal[..., RUN - 2 :: -1], axis=-1).sum(axis=-1)
    after = np.logical_and.accumulate(equal[..., RUN - 1 :], axis=-1).sum(axis=-1)
    return (after >= SHINGLE) & (before + after >= RUN + SHINGLE - 1)


def _numbered(words: np.ndarray) -> np.ndarray:
    """Sorted codes of each row's shingles, where the n-th of equal ones has a code of its own; 0 beyond the text."""
    tokens = shingle_hashes(words.astype(np.uint64))
    tokens[(words[:, : tokens.shape[1]] == 0) | (words[:, SHINGLE - 1 :] == 0)] = 0
    tokens.sort(axis=1)
    place = np.arange(tokens.shape[1])
    new = np.ones(tokens.shape, dtype=bool)
    new[:, 1:] = tokens[:, 1:] != tokens[:, :-1]
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    return np.where(tokens > 0, _mix(tokens + nth.astype(np.uint64) * _PRIME[1]), 0)


def shared_elsewhere(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two texts share ``_SHARED`` shingles around aligned centres, and some of them at places that are not aligned."""
    tokens = 2 * AROUND + 1
    aligned = (x == y) & (x != 0)
    diagonal = aligned[:, :tokens].copy()
    for j in range(1, SHINGLE):
        diagonal &= aligned[:, j : j + tokens]
    both = np.sort(np.concatenate([_numbered(x), _numbered(y)], axis=1), axis=1)
    count = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).sum(axis=1)
    return (count >= _SHARED) & (count > diagonal.sum(axis=1))


class _Links:
    """Members of groups, and which of them are linked. A member is a place of a text with the words around it."""

    def __init__(self, sig: np.ndarray, reach: np.ndarray, words: np.ndarray):
        self.sig, self.words = sig, words
        self.before, self.after = reach >> 8, reach & 255
        self.root = list(range(len(sig)))
        #: (member, its first word, word after its last, the same of another member, similarity), words by their place around the centre
        self.edges: list[tuple[np.ndarray, ...]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def roots(self, of: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, of.tolist()), dtype=np.int64, count=len(of))

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are not linked."""
        on = self.roots(x) != self.roots(y)
        return x[on], y[on]

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = self.find(p), self.find(q)
            self.root[max(p, q)] = min(p, q)

    def attempt(self, x: np.ndarray, y: np.ndarray) -> None:
        """Compare members x and y pair by pair, where their texts differ and their windows overlap enough."""
        meet = np.minimum(self.before[x], self.before[y]) + np.minimum(self.after[x], self.after[y]) + 1 >= RUN
        meet &= self.sig[x] != self.sig[y]
        x, y = x[meet], y[meet]
        # a near passage has a run of equal shingles; it is found at the centre of that run
        meet = [run_around(self.words[x[at : at + _CHUNK]], self.words[y[at : at + _CHUNK]]) for at in range(0, len(x), _CHUNK)]
        if meet:
            x, y = x[np.concatenate(meet)], y[np.concatenate(meet)]
        shifted = [np.zeros((0, 2), dtype=np.int64)]
        for at in range(0, len(x), _CHUNK):
            p, q = x[at : at + _CHUNK], y[at : at + _CHUNK]
            found, lo, hi, shared, single = match(self.words[p], self.words[q])
            other = ~found & single
            shifted.append(np.stack([p[other], q[other]], axis=1))
            i, j, lo, hi, shared = p[found], q[found], lo[found], hi[found] + 1, shared[found]
            self._join(i, j)
            self.edges.append((i, lo, hi + SHINGLE - 1, j, lo, hi + SHINGLE - 1, shared / (2 * (hi - lo) - shared)))
        x, y = self.apart(*np.concatenate(shifted).T)
        for at in range(0, len(x), _SHIFTED):
            p, q = self.apart(x[at : at + _SHIFTED], y[at : at + _SHIFTED])
            on = shared_elsewhere(self.words[p], self.words[q])
            p, q = p[on], q[on]
            if not len(p):
                continue
            found, *places, shared = match_shifted(self.words[p], self.words[q])
            i, j, shared = p[found], q[found], shared[found]
            lx, rx, ly, ry = (v[found] for v in places)
            self._join(i, j)
            self.edges.append((i, lx, rx + SHINGLE, j, ly, ry + SHINGLE, shared / (rx - lx + ry - ly + 2 - shared)))


def _parts_of(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members in the order of (group, key), without those that have no key, and start and size of each part with two or more."""
    order = np.lexsort((key, group))
    order = order[key[order] != 0]
    if not len(order):
        return order, order, order
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(key[order]) != 0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    return order, start[size > 1], size[size > 1]


def link_members(group: np.ndarray, sig: np.ndarray, reach: np.ndarray, left: np.ndarray, right: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Edges by which every near passage around the centres of each group is linked; members come in the order of their groups."""
    links = _Links(sig, reach, words)
    sides = [_parts_of(group, key) for key in (left, right)]
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for order, start, size in sides:
        inside = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hub, member = order[np.repeat(start, size)], order[inside]
        pairs.append(np.stack([hub, member], axis=1)[hub != member])
    x, y = np.unique(np.concatenate(pairs), axis=0).T
    links.attempt(x, y)
    # then all that are not linked yet
    rest = [np.zeros((0, 2), dtype=np.int64)]
    crowds = []
    for order, start, size in sides:
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            part = order[s : s + n]
            if n > SMALL:
                crowds.append(part)
                continue
            root = links.roots(part)
            if (root != root[0]).any():
                i, j = np.triu_indices(n, 1)
                apart = (root[i] != root[j]) & (i > 0)
                rest.append(np.stack([part[i[apart]], part[j[apart]]], axis=1))
    x, y = np.unique(np.concatenate(rest), axis=0).T
    links.attempt(x, y)
    for part in crowds:
        _link_crowd(links, part)
    return links.edges


def _often(tokens: np.ndarray) -> np.ndarray:
    """For each token, whether two members (rows) or more have it; zeros are none."""
    n, m = tokens.shape
    key = np.unique(tokens, return_inverse=True)[1].reshape(n, m).astype(np.int64)
    seen = np.unique(key * n + np.arange(n)[:, None])
    return (np.bincount(seen // n, minlength=key.max() + 1)[key] > 1) & (tokens != 0)


def _may_match(often: np.ndarray) -> np.ndarray:
    """Rows where the tokens that others have too stand close enough for a passage that holds the centre."""
    weight = np.where(often, 1, -8).astype(np.int32)
    after = np.cumsum(weight[:, AROUND:], axis=1)
    before = np.concatenate([np.zeros((len(often), 1), dtype=np.int32), np.cumsum(weight[:, AROUND - 1 :: -1], axis=1)], axis=1)
    best = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
    need = np.maximum(_LENGTH - 1 - np.arange(AROUND + 1), 0)
    return (before + best[:, need]).max(axis=1) >= 0


def _link_crowd(links: _Links, part: np.ndarray) -> None:
    """Link a large part: its members share the centre and its side.

    Passages share ``_SHARED`` shingles, so of each member's shingles, the
    rarest of the crowd first, all but ``_SHARED - 1`` lead to every partner.
    """
    # members with the same words around them: two, of different texts, stand for all
    alike = np.unique(np.ascontiguousarray(links.words[part]).view(f"V{4 * _WIDTH}").ravel(), return_index=True, return_inverse=True)
    first = part[alike[1]][alike[2].ravel()]
    links.attempt(*links.apart(first, part))
    other = np.flatnonzero(links.sig[first] != links.sig[part])
    second = part[other[np.unique(first[other], return_index=True)[1]]]
    part = np.unique(np.concatenate([first, second]))
    while True:
        root = links.roots(part)
        if (root == root[0]).all():
            return
        words = links.words[part]
        tokens = shingle_hashes(words.astype(np.uint64))
        tokens[(words[:, : tokens.shape[1]] == 0) | (words[:, SHINGLE - 1 :] == 0)] = 0
        # passages of others hold shingles that others have
        often = _often(tokens)
        keep = _may_match(often)
        if keep.all():
            break
        part = part[keep]
        if len(part) < 2:
            return
    n = len(part)
    key = np.unique(np.where(often, tokens, 0), return_inverse=True)[1].reshape(tokens.shape).astype(np.int64)
    count = np.bincount(key.ravel())
    owner = np.repeat(np.arange(n), tokens.shape[1])[often.ravel()]
    key = key[often]
    by = np.lexsort((key, count[key], owner))
    key, owner = key[by], owner[by]
    size = np.bincount(owner, minlength=n)
    rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    table = np.full((n, int(size.max())), key.max() + 1, dtype=np.int64)
    table[owner, rank] = key
    lead = rank <= size[owner] - _SHARED
    by = np.lexsort((owner[lead], key[lead]))
    key, owner = key[lead][by], owner[lead][by]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    length = np.diff(np.append(start, len(key)))
    # each with the first of a shingle that it shares most, which links most of a crowd of near copies
    head = np.repeat(owner[start], length)
    codes, times = np.unique(owner * n + head, return_counts=True)
    x, y = codes // n, codes % n
    apart = root[x] != root[y]
    x, y, times = x[apart], y[apart], times[apart]
    by = np.lexsort((y, -times, x))
    x, y = x[by], y[by]
    first = np.append(True, x[1:] != x[:-1])[: len(x)]
    links.attempt(part[x[first]], part[y[first]])
    # as long as it links most, the others with some of the largest component
    for turn in range(n):
        names, number = np.unique(links.roots(part), return_inverse=True)
        most = number == np.bincount(number).argmax()
        rest, some = np.flatnonzero(~most), np.flatnonzero(most)
        if not len(rest):
            return
        step = -(-len(some) // _PROBES)
        some = some[turn % step :: step]
        links.attempt(*links.apart(part[np.repeat(rest, len(some))], part[np.tile(some, len(rest))]))
        if 2 * (len(names) - len(np.unique(links.roots(part)))) < len(names):
            break
    # then those of every lead that are apart still, from the smaller sides
    root = links.roots(part)
    partners: dict[int, list[np.ndarray]] = {}
    for s, m in zip(start.tolist(), length.tolist()):
        mine = owner[s : s + m]
        names, number = np.unique(root[mine], return_inverse=True)
        if len(names) > 1:
            most = np.bincount(number).argmax()
            for i in mine[number != most].tolist():
                partners.setdefault(i, []).append(mine)
    mark = np.zeros(int(table.max()) + 1, dtype=bool)
    todo = [np.zeros((0, 2), dtype=np.int64)]
    for i in sorted(partners):
        met = root != root[i]
        shares = np.zeros(n, dtype=bool)
        for mine in partners.pop(i):
            shares[mine] = True
        others = np.flatnonzero(shares & met)
        others = others[links.sig[part[others]] != links.sig[part[i]]]
        others = others[run_around(words[others], words[i])]
        mark[table[i, : size[i]]] = True
        others = others[mark[table[others]].sum(axis=1) >= _SHARED]
        mark[table[i, : size[i]]] = False
        todo.append(np.stack([np.full(len(others), part[i]), part[others]], axis=1))
        if not partners or sum(map(len, todo)) >= _CHUNK:
            links.attempt(*links.apart(*np.concatenate(todo).T))
            todo = todo[:1]
            root = links.roots(part)


# --- tables ----------------------------------------------------------------

_MEMBER = ("value", "c", "reach", "left", "right")
_AROUND_SCHEMA = "value long, c int, reach int, left int, right int, sig long, doc_id long, words binary"
LINK_SCHEMA = "doc_a long, start_a long, end_a long, doc_b long, start_b long, end_b long, similarity double"


def surroundings(texts: DataFrame) -> DataFrame:
    """A row for each of the centres ``own`` of ``texts(sig, doc_id, text, own)``, with 32-bit hashes of the words around it; 0 where the text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                own = row.column(3).flatten()
                words = (word_hashes(row.column(2)[0].as_py())[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                padded = np.concatenate([np.zeros(AROUND, np.uint32), words, np.zeros(AROUND + SHINGLE, np.uint32)])
                around = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH)
                own = own.take(pa.array(np.argsort(own.field(1).to_numpy(), kind="stable")))
                centres = own.field(1).to_numpy()
                # of a text's places with the same words around, the first stands for all
                codes = [(around[centres[lo : lo + _CHUNK]] * _FAR).sum(axis=1, dtype=np.uint64) for lo in range(0, len(own), _CHUNK)]
                own = own.take(pa.array(np.sort(np.unique(np.concatenate(codes), return_index=True)[1])))
                for lo in range(0, len(own), _CHUNK):
                    some = [own.field(i).slice(lo, _CHUNK) for i in range(len(_MEMBER))]
                    n = len(some[0])
                    data = np.ascontiguousarray(around[some[1].to_numpy()])
                    ends = np.arange(n + 1, dtype=np.int32) * (4 * _WIDTH)
                    binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                    same = [pa.array(np.full(n, row.column(i)[0].as_py(), dtype=np.int64)) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*some, *same, binary], [*_MEMBER, "sig", "doc_id", "words"])

    return texts.select("sig", "doc_id", "text", "own").mapInArrow(run, _AROUND_SCHEMA)


def _link_table(table: pa.Table) -> pa.RecordBatch | None:
    """Links of whole groups; their rows stand together."""
    column = lambda name: table.column(name).to_numpy()
    value, low, high = column("value"), column("low"), column("high")
    new = np.zeros(len(value), dtype=np.int64)
    new[1:] = (value[1:] != value[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), dtype=np.uint32).reshape(len(value), _WIDTH)
    edges = link_members(np.cumsum(new), column("sig"), column("reach"), column("left"), column("right"), words)
    x, lo, hi, y, lo2, hi2, similarity = (np.concatenate(e) for e in zip(*edges)) if edges else [np.zeros(0, dtype=np.int64)] * 7
    doc, first = column("doc_id"), column("c").astype(np.int64) - AROUND
    columns = [doc[x], first[x] + lo, first[x] + hi, doc[y], first[y] + lo2, first[y] + hi2, similarity.astype(float)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in LINK_SCHEMA.split(", ")])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups, whose rows come together; a group's rows may go over several batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _CHUNK:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(k).to_numpy() for k in ("value", "low", "high")]
        last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        if len(last):
            cut = int(last[-1]) + 1
            yield _link_table(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows -= cut
    if rows:
        yield _link_table(pa.Table.from_batches(held))


def link(members: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """``LINK_SCHEMA`` rows: near passages of two texts, by which all near passages around the centres of ``members`` are linked.

    ``members`` has the columns of ``_MEMBER`` and sig; ``reps(sig, doc_id)`` names
    the row of ``texts(sig, doc_id, text)`` that stands for a signature.
    """
    spark = members.sparkSession
    own = members.groupBy("sig").agg(F.collect_list(F.struct(*_MEMBER)).alias("own")).join(reps, "sig")
    around = surroundings(texts.join(own, ["sig", "doc_id"]))
    # beyond a block, every two blocks of a group meet
    sizes = members.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    none = F.lit(0)
    if sizes.isEmpty():
        dealt = around.withColumn("low", none).withColumn("high", none)
    else:
        dealt = around.join(broadcast_if_small(sizes), "value", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
        dealt = dealt.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("mine", "other", "blocks")
    keys = ["value", "low", "high"]
    together = dealt.repartition(n_shuffle(spark), *keys).sortWithinPartitions(*keys, "sig", "c")
    return together.mapInArrow(_link_groups, LINK_SCHEMA)


def passages_of(links: DataFrame) -> DataFrame:
    """doc_id, start, n_words, rep_doc_id, rep_start, similarity: the passages of ``links`` with their classes.

    A passage's similarity is that to the passage it is most similar to.
    """
    spark = links.sparkSession
    side = lambda s: links.select(F.col(f"doc_{s}").alias("doc_id"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end"), "similarity")
    # parts of a text that overlap are one passage
    parts = side("a").unionByName(side("b")).groupBy("doc_id", "start").agg(F.max("end").alias("end"), F.max("similarity").alias("similarity"))
    own = Window.partitionBy("doc_id").orderBy("start")
    new = F.coalesce(F.col("start") >= F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    first = F.max(F.when(F.col("new"), F.col("start"))).over(own)
    parts = materialize(parts.withColumn("new", new).withColumn("first", first).drop("new"), "parts")
    spans = parts.groupBy("doc_id", "first").agg(F.max("end").alias("end"), F.max("similarity").alias("similarity"))
    spans = materialize(spans.withColumn("id", F.monotonically_increasing_id()), "spans")
    named = materialize(parts.join(spans.select("doc_id", "first", "id"), ["doc_id", "first"]).select("doc_id", "start", "id"), "places")
    place = lambda s: named.select(F.col("doc_id").alias(f"doc_{s}"), F.col("start").alias(f"start_{s}"), F.col("id").alias(s))
    edges = links.select("doc_a", "start_a", "doc_b", "start_b").distinct()
    edges = edges.join(place("a"), ["doc_a", "start_a"]).join(place("b"), ["doc_b", "start_b"]).select("a", "b")
    roots = connected_components(edges, "passages").withColumnRenamed("node", "id")
    classed = spans.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classed.groupBy("root").agg(F.min(F.struct("doc_id", "first")).alias("rep"))
    return classed.join(least, "root").select(
        "doc_id", F.col("first").alias("start"), (F.col("end") - F.col("first")).alias("n_words"), F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.first").alias("rep_start"), "similarity"
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words, rep_doc_id, rep_start, similarity, kind: 'passage', or 'copy' for a whole text.

    ``start`` and ``n_words`` count words. A class is named by its first passage,
    the one with the smallest (rep_doc_id, rep_start).
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = own.select(F.xxhash64("text").alias("sig"), "doc_id", "text")
    every = materialize(windows(own), "compact")

    # min-hashes that two different texts have, with equal shingles on a side; copies count as one text
    two = [F.min("sig").alias("s"), F.max("sig").alias("t")]
    shared = every.groupBy("value").agg(*two).where("s <> t").select("value")
    whole = materialize(every.join(shared, "value"), "met")
    drop_scratch(every)
    met = whole.dropDuplicates(["value", "sig", "c"])

    def beside(side: str) -> DataFrame:
        groups = met.where(f"{side} <> 0").groupBy("value", side).agg(*two).where("s <> t").select("value", side)
        return met.join(groups, ["value", side]).select(*met.columns)

    members = materialize(beside("left").unionByName(beside("right")).dropDuplicates(["value", "sig", "c"]), "members")
    drop_scratch(whole)

    # one text of each signature that is needed; the prefilter has a fixed size and only saves shuffling texts that are not
    named = materialize(members.select("sig").distinct(), "named")
    firsts = materialize(own.groupBy("sig").agg(F.min("doc_id").alias("rep_doc_id"), F.max("doc_id").alias("last")), "firsts")
    bucket = F.pmod(F.col("sig"), F.lit(FETCH_BUCKETS))
    near = own.withColumn("bucket", bucket).join(F.broadcast(named.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")
    reps = firsts.select("sig", F.col("rep_doc_id").alias("doc_id"))
    links = materialize(link(members, reps, near), "links")
    drop_scratch(members)
    passages = passages_of(links).withColumn("kind", F.lit("passage"))

    several = broadcast_if_small(firsts.where("rep_doc_id <> last").select("sig", "rep_doc_id"))
    zero = F.lit(0).cast("long")
    words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long")
    copies = own.join(several, "sig").select("doc_id", zero.alias("start"), words.alias("n_words"), "rep_doc_id", zero.alias("rep_start"), F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind"))
    return passages.unionByName(copies.where(F.col("n_words") >= MIN_WORDS).distinct())
