"""The lattice of all ways to cut byte strings into pieces of a fixed vocabulary, for many strings at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from leafmill.llm import wordhash as W

#: Longer strings are split where no piece reaches across; longer ones still are run in blocks of SPAN bytes, STRETCH bytes at
#: a time. Sums are rescaled every RESCALE bytes, so chances must be at least 1e-9 for pieces of up to 25 bytes.
BULK, LONG, SPAN, STRETCH, RESCALE = 32, 1024, 128, 1 << 15, 4
LOG2 = math.log(2)
_P = np.uint64(0x9E3779B97F4A7C15)
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Pieces:
    """Byte strings by id. `spelling[id]` is b"" for pieces that take no part; every single byte has a piece."""

    def __init__(self, spelling: list[bytes]):
        self.spelling, self.ids = spelling, {}
        for i, x in enumerate(self.spelling):  # of two pieces for one byte the later, a character, wins over the byte
            if x:
                self.ids[x] = i
        #: Longest piece in bytes (a space counts as one).
        self.widest = max(map(len, self.ids), default=1)
        self._perfect_hash()

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a SentencePiece model file; "▁" stands for a space. Control pieces take no part, nor would pieces with a
        space behind another character."""
        import sentencepiece

        model, found = sentencepiece.SentencePieceProcessor(model_file=path), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                found.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or "▁" in piece.lstrip("▁"):
                found.append(b"")
            else:
                found.append(piece.replace("▁", " ").encode())
        return cls(found)

    def _perfect_hash(self) -> None:
        """Slots without collisions: a displacement for each of 2,048 buckets, largest bucket first."""
        self.bits = max(16, (4 * len(self.ids)).bit_length())
        hashes = np.zeros(len(self.ids), dtype=np.uint64)
        for k, x in enumerate(self.ids):
            h = 0
            for b in x:
                h = (h * int(_P) + b + 1) % (1 << 64)
            hashes[k] = h
        numbers = np.fromiter(self.ids.values(), np.int32, len(self.ids))
        spread = hashes * _C
        bucket = (spread >> np.uint64(53)).astype(np.int64)
        self.displaced = np.zeros(2048, dtype=np.uint64)
        self.keys, self.slots = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        taken = np.zeros(1 << self.bits, dtype=bool)
        order = np.argsort(bucket, kind="stable")
        begins = np.searchsorted(bucket[order], np.arange(2049))
        for b in np.argsort(-np.diff(begins), kind="stable"):
            own = order[begins[b] : begins[b + 1]]
            for d in range(1, 1 << 20):
                at = self._at(spread[own], W.mix(np.array([d], dtype=np.uint64)))
                if not taken[at].any() and len(np.unique(at)) == len(at):
                    break
            self.displaced[b] = W.mix(np.array([d], dtype=np.uint64))[0]
            taken[at], self.keys[at], self.slots[at] = True, hashes[own], numbers[own]
        self.seen = np.zeros((self.widest, 1 << 16), dtype=bool)  # answers most lookups of a width
        self.seen[np.fromiter(map(len, self.ids), np.int64, len(self.ids)) - 1, spread >> np.uint64(48)] = True

    def _at(self, spread: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        return ((spread ^ displaced) * _D) >> np.uint64(64 - self.bits)

    def lookup(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, ids) of the hashes that are those of pieces of this width."""
        spread = hashes * _C
        at = np.flatnonzero(self.seen[width - 1].take(spread >> np.uint64(48)))
        spread, hashes = spread[at], hashes[at]
        slot = self._at(spread, self.displaced[spread >> np.uint64(53)])
        found = self.keys[slot] == hashes
        return at[found], self.slots[slot[found]]

    def cuts(self, strings: np.ndarray) -> np.ndarray:
        """[L, widths, n] ids for strings [n, L]: of the piece of k + 1 bytes that ends at byte j (inclusive), or -1."""
        n, size = strings.shape
        wide = min(self.widest, size)
        out = np.full((size, wide, n), -1, dtype=np.int32)
        places, hashes = np.ascontiguousarray(strings.T).astype(np.uint64) + np.uint64(1), np.zeros((size, n), dtype=np.uint64)
        for k in range(wide):
            hashes = hashes[: size - k] * _P + places[k:]
            at, ids = self.lookup(hashes.ravel(), k + 1)
            out[at // n + k, k, at % n] = ids
        return out

    def split(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the same strings, those of more than BULK bytes cut at every place that no piece reaches across. Every
        segmentation has a cut there, so sums over a string are products over its parts, and draws are independent."""
        long = np.flatnonzero(end - start > BULK)
        if not len(long):
            return start, end
        size = (end - start)[long]
        ends = np.cumsum(size)
        of = np.repeat(ends - size, size)  # where each byte's string begins among the long ones
        place = np.arange(int(ends[-1])) - of + np.repeat(start[long], size)
        raw, begins = data[place], np.empty(len(place), dtype=np.int64)
        for lo in range(0, len(raw), STRETCH):
            hi, before = min(len(raw), lo + STRETCH), max(0, lo - self.widest + 1)
            begins[lo:hi], hashes = np.arange(lo, hi), np.zeros(hi - before, dtype=np.uint64)
            places = raw[before:hi].astype(np.uint64) + np.uint64(1)
            for k in range(min(self.widest, hi - before)):
                hashes = hashes[: len(places) - k] * _P + places[k:]
                at = self.lookup(hashes, k + 1)[0] + before
                at = at[(at + k >= lo) & (at >= of[np.minimum(at + k, len(of) - 1)])]
                begins[at + k] = at
        free = np.minimum.accumulate(begins[::-1])[::-1] >= np.arange(len(raw))
        opens = np.concatenate([np.delete(start, long), place[free]])
        opens.sort()
        closes = np.concatenate([np.delete(end, long), place[np.append(np.flatnonzero(free)[1:], len(raw)) - 1] + 1])
        closes.sort()
        return opens, closes


def forward(cuts: np.ndarray, chances: np.ndarray, near: np.ndarray, first: np.ndarray | None = None, reach: int = 1, told: Callable | None = None) -> np.ndarray:
    """Sums over all segmentations, byte by byte, of n strings that end together.

    cuts: [L, widths, n]; chances: [pieces + 1, languages], the last row zeros. near: [before + L, n, lanes, languages], row
    before - 1 + j for the sums at position j, filled in up to where each string begins (`first`, ascending; 0 without
    it); `reach` is the number of rows filled in that aren't zeros. Rows are scaled by powers of two as they go, which is exact; the result are the
    exponents [n, lanes, languages] of the last rows, as many as stand before the first byte. told(j, terms, sums, exponents) sees every step."""
    (size, wide, n), before = cuts.shape, len(near) - len(cuts)
    exponents = np.zeros(near.shape[1:], dtype=np.int64)
    single = np.ascontiguousarray(chances[:, 0]) if chances.shape[1] == 1 else None
    for j in range(size):
        m, k = n if first is None else int(np.searchsorted(first, j, side="right")), min(wide, j + reach)
        ids = cuts[j, :k, :m]
        chance = single.take(ids)[:, :, None, None] if single is not None else chances.take(ids, axis=0)[:, :, None, :]
        terms = near[j + before - k : j + before, :m][::-1] * chance
        sums = terms.sum(axis=0)
        near[j + before, :m] = sums
        if told:
            told(j, terms, sums, exponents)
        if j % RESCALE == RESCALE - 1 or j == size - 1:
            by = np.frexp(sums)[1]
            rows = near[j + 1 : j + before + 1, :m]
            np.ldexp(rows, -by, out=rows)
            exponents[:m] += by
    return exponents


def begun(size: int, wide: int, first: np.ndarray, languages: int) -> np.ndarray:
    """near[] for forward(): strings that begin at `first`."""
    near = np.zeros((wide + size, len(first), 1, languages))
    near[wide - 1 + first, np.arange(len(first))] = 1
    return near


def groups(size: np.ndarray, wide: int, entries: int = 500_000) -> Iterator[np.ndarray]:
    """Indices of strings of up to LONG bytes, the longest first, in groups of similar length with about `entries` cuts."""
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -LONG) : np.count_nonzero(size)]
    falling, lo = -size[order], 0
    while lo < len(order):
        longest = -int(falling[lo])
        hi = min(int(np.searchsorted(falling, -(longest * 4 // 5))), lo + max(1, entries // (longest * min(wide, longest))))
        yield order[lo:hi]
        lo = hi


def aligned(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes [n, L], first): strings by falling length, their ends aligned; what stands before `first` isn't theirs."""
    size = end - start
    return data[np.maximum(end[:, None] - size[0] + np.arange(size[0]), 0)], size[0] - size


def log_sums(pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, chances: np.ndarray, languages: int = 8) -> np.ndarray:
    """[strings, languages]: logarithm of the summed probability of all segmentations of each string."""
    out, size = np.zeros((len(start), chances.shape[1])), end - start
    parts = [np.ascontiguousarray(chances[:, lo : lo + languages]) for lo in range(0, chances.shape[1], languages)]
    for own in groups(size, pieces.widest):
        strings, first = aligned(data, start[own], end[own])
        cuts = pieces.cuts(strings)
        for i, part in enumerate(parts):
            near = begun(cuts.shape[0], cuts.shape[1], first, part.shape[1])
            exponents = forward(cuts, part, near, first)
            out[own, i * languages : (i + 1) * languages] = (np.log(near[-1]) + exponents * LOG2)[:, 0]
    for s in np.flatnonzero(size > LONG):
        for i, part in enumerate(parts):
            for *_, log in _stretches(pieces, data[start[s] : end[s]], part):
                out[s, i * languages : (i + 1) * languages] = log
    return out


def _weights(cuts: np.ndarray, chance: np.ndarray, near: np.ndarray, first: np.ndarray | None, reach: int) -> np.ndarray:
    """[L, widths, n]: the probability that the piece which ends at byte j has k + 1 bytes, if one ends there."""
    out = np.zeros(cuts.shape)

    def told(j: int, terms: np.ndarray, sums: np.ndarray, exponents: np.ndarray) -> None:
        out[j, : terms.shape[0], : terms.shape[1]] = (terms / sums)[:, :, 0, 0]

    forward(cuts, chance, near, first, reach, told)
    return out


def expected(pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray, times: np.ndarray, chance: np.ndarray, unit: int) -> np.ndarray:
    """[pieces]: how often each piece is expected in all strings, each of which counts `times`, in units of 1 / unit.
    chance: [pieces + 1], the last zero. Every string's numbers are rounded before they are added."""
    out, size, column = np.zeros(len(chance), dtype=np.int64), end - start, chance[:, None]
    for own in groups(size, pieces.widest):
        strings, first = aligned(data, start[own], end[own])
        cuts = pieces.cuts(strings)
        length, wide, n = cuts.shape
        weights = _weights(cuts, column, begun(length, wide, first, 1), first, 1)
        passed = np.zeros((length + wide, n))  # how likely a cut is at each position, from the end on; rows as in near[]
        passed[-1] = 1
        for j in range(length - 1, -1, -1):
            weights[j] *= passed[j + wide]
            passed[j : j + wide] += weights[j, ::-1]
        counted = np.rint(weights * unit) * times[own]
        out += np.bincount(cuts.ravel() + 1, weights=counted.ravel(), minlength=len(out)).astype(np.int64)
    for i in np.flatnonzero(size > LONG):
        for ids, weights in long_expected(pieces, data[start[i] : end[i]], column):
            out += np.bincount(ids + 1, weights=np.rint(weights * unit) * times[i], minlength=len(out)).astype(np.int64)
    return out[1:]


# A string of more than LONG bytes goes in stretches, a stretch in blocks of SPAN bytes side by side. What a block makes
# of the sums before it is linear in the last `widths` of them; so it is run once for each of these, and the blocks are chained.


def _ending(pieces: Pieces, string: np.ndarray, lo: int, hi: int, back: bool = False) -> np.ndarray:
    """[hi - lo, widths] ids of the pieces that end at the bytes lo to hi; with `back`, of the reversed string and pieces."""
    reach = pieces.widest - 1
    if not back:
        before = max(0, lo - reach)
        return pieces.cuts(string[None, before:hi])[lo - before :, :, 0]
    lo, hi = len(string) - hi, len(string) - lo
    found = pieces.cuts(string[None, lo : hi + reach])[:, :, 0]
    out = np.full((hi - lo, found.shape[1]), -1, dtype=np.int32)
    for k in range(found.shape[1]):
        own = found[k : k + hi - lo, k]
        out[: len(own), k] = own
    return out[::-1]


def _blocks(pieces: Pieces, string: np.ndarray, lo: int, hi: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(cuts [SPAN, widths, blocks], first) of a stretch. Its first block may be short and stands last."""
    ids = _ending(pieces, string, lo, hi, back)
    wide = 1 + int(np.flatnonzero((ids >= 0).any(axis=0)).max())
    blocks = -(-(hi - lo) // SPAN)
    filled = np.full((blocks * SPAN, wide), -1, dtype=np.int32)
    filled[blocks * SPAN - (hi - lo) :] = ids[:, :wide]
    first = np.zeros(blocks, dtype=np.int64)
    first[-1] = blocks * SPAN - (hi - lo)
    return np.ascontiguousarray(np.roll(filled.reshape(blocks, SPAN, wide), -1, axis=0).transpose(1, 2, 0)), first


def _stretches(pieces: Pieces, string: np.ndarray, chances: np.ndarray, back: bool = False) -> Iterator[tuple]:
    """(lo, hi, cuts, first, entering, logs, log) of each stretch of one string: its blocks, the sums before each of them
    [blocks, widths, languages], nearest first, and their logarithms, and that of the sum at hi. The first stretch is the short one."""
    window, log = np.zeros((pieces.widest, chances.shape[1])), np.zeros(chances.shape[1])
    window[0], lo = 1, 0
    for hi in range(len(string) % STRETCH or STRETCH, len(string) + 1, STRETCH):
        cuts, first = _blocks(pieces, string, lo, hi, back)
        _, wide, blocks = cuts.shape
        near = np.zeros((pieces.widest + SPAN, blocks, wide, chances.shape[1]))
        for i in range(wide):
            near[pieces.widest - 1 - i + first, np.arange(blocks), i] = 1
        rise = forward(cuts, chances, near, first, wide) * LOG2  # [block, window before, languages]
        made = near[-pieces.widest :][::-1]  # [window after, block, window before, languages]
        entering, logs = np.zeros((blocks, wide, chances.shape[1])), np.zeros((blocks, chances.shape[1]))
        for b in range(blocks):
            at = (b - 1) % blocks
            entering[at], logs[at] = window[:wide], log
            top = np.where((window[:wide] > 0) & (made[:, at] > 0).any(axis=0), rise[at], -np.inf).max(axis=0)
            after = (made[:, at] * (window[:wide] * np.exp(np.minimum(rise[at] - top, 0)))).sum(axis=1)
            window, log = after / after[0], log + top + np.log(after[0])
        yield lo, hi, cuts, first, entering, logs, log
        lo = hi


def _entered(cuts: np.ndarray, first: np.ndarray, entering: np.ndarray) -> np.ndarray:
    """near[] of one language for the blocks of a stretch, with the sums before each block filled in."""
    near = np.zeros((cuts.shape[1] + SPAN, cuts.shape[2], 1, 1))
    for i in range(cuts.shape[1]):
        near[cuts.shape[1] - 1 - i + first, np.arange(len(first)), 0, 0] = entering[:, i, 0]
    return near


def _in_order(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[SPAN, ..., blocks] as [bytes of the stretch, ...]."""
    return np.roll(np.moveaxis(values, -1, 0), 1, axis=0).reshape(-1, *values.shape[1:-1])[first[-1] :]


def _position_logs(pieces: Pieces, string: np.ndarray, chance: np.ndarray, back: bool = False) -> tuple[np.ndarray, float]:
    """(logarithms of the sums at all L + 1 positions, the last of them)."""
    out = np.zeros(len(string) + 1)
    for lo, hi, cuts, first, entering, logs, _ in _stretches(pieces, string, chance, back):
        here = np.zeros((SPAN, len(first)))

        def told(j: int, terms: np.ndarray, sums: np.ndarray, exponents: np.ndarray, here=here, logs=logs) -> None:
            m = terms.shape[1]
            here[j, :m] = np.log(sums[:, 0, 0]) + exponents[:m, 0, 0] * LOG2 + logs[:m, 0]

        forward(cuts, chance, _entered(cuts, first, entering), first, cuts.shape[1], told)
        out[lo + 1 : hi + 1] = _in_order(here, first)
    return out, float(out[-1])


def long_expected(pieces: Pieces, string: np.ndarray, chance: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, how often each is expected) for one string of any length, a stretch of it at a time; an id comes repeatedly."""
    ahead, total = _position_logs(pieces, string, chance)
    behind = _position_logs(pieces, string, chance, back=True)[0][::-1]
    for lo in range(0, len(string), STRETCH):
        ids = _ending(pieces, string, lo, min(len(string), lo + STRETCH))
        at, k = np.nonzero(ids >= 0)
        found = ids[at, k]
        with np.errstate(divide="ignore"):
            yield found, np.exp(ahead[at + lo - k] + np.log(chance[found, 0]) + behind[at + lo + 1] - total)


def uniform(seeds: np.ndarray, token: np.ndarray, at: int | np.ndarray) -> np.ndarray:
    """In [0, 1): a hash of (seed, token, at)."""
    x = W.mix(seeds ^ W.mix(np.asarray(token).astype(np.uint64) * _C + np.uint64(1) + np.asarray(at).astype(np.uint64) * _D))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(pieces: Pieces, chances: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of each string, their ids in order): one segmentation of each string, drawn from all in proportion to
    the product of its pieces' chances (one column). Sums run forward over distinct strings; draws run backward
    for each string, with a number for each place that is its own, so equal seeds and tokens give equal segmentations
    wherever they run."""
    _, own_first, which = np.unique(W.span_hashes(data, start, end) ^ (end - start).astype(np.uint64), return_index=True, return_inverse=True)
    turn = np.argsort(which, kind="stable")
    begins = np.searchsorted(which[turn], np.arange(len(own_first) + 1))
    counts, drawn = np.zeros(len(start), dtype=np.int64), []
    size = (end - start)[own_first]
    for own in groups(size, pieces.widest):
        strings, first = aligned(data, start[own_first[own]], end[own_first[own]])
        cuts = pieces.cuts(strings)
        length, wide, _ = cuts.shape
        weights = _weights(cuts, chances, begun(length, wide, first, 1), first, 1)
        sums = np.ascontiguousarray(weights.transpose(2, 0, 1))
        np.cumsum(sums, axis=2, out=sums)
        sums /= np.where(sums[:, :, -1:] > 0, sums[:, :, -1:], 1)
        cuts = np.ascontiguousarray(cuts.transpose(2, 0, 1))
        times = begins[own + 1] - begins[own]
        string = np.repeat(np.arange(len(own)), times)
        each = turn[np.repeat(begins[own] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(string))]
        for lo in range(0, len(each), 200_000):
            occurrence, row = each[lo : lo + 200_000], string[lo : lo + 200_000]
            at, step = np.full(len(occurrence), length - 1), 0
            while len(occurrence):
                k = (sums[row, at] <= uniform(seeds[occurrence], token[occurrence], at - first[row])[:, None]).sum(axis=1)
                drawn.append((occurrence, np.full(len(occurrence), step, dtype=np.int32), cuts[row, at, k]))
                counts[occurrence] += 1
                at, step = at - k - 1, step + 1
                on = at >= first[row]
                occurrence, row, at = occurrence[on], row[on], at[on]
    for s in np.flatnonzero(size > LONG):
        places = turn[begins[s] : begins[s + 1]]
        for i, ids in zip(places.tolist(), long_samples(pieces, chances, data[start[places[0]] : end[places[0]]], seeds[places], token[places]), strict=True):
            drawn.append((np.full(len(ids), i), np.arange(len(ids), dtype=np.int32), np.array(ids, dtype=np.int32)))
            counts[i] = len(ids)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for occurrence, step, ids in drawn:
        out[ends[occurrence] - 1 - step] = ids
    return counts, out


def long_samples(pieces: Pieces, chances: np.ndarray, string: np.ndarray, seeds: np.ndarray, token: np.ndarray) -> list[list[int]]:
    """sample() for one string of any length under several seeds; ids from the last to the first."""
    out, at = [[] for _ in seeds], [len(string)] * len(seeds)
    for lo, hi, entering in reversed([(lo, hi, entering) for lo, hi, _, _, entering, _, _ in _stretches(pieces, string, chances)]):
        cuts, first = _blocks(pieces, string, lo, hi)
        sums = np.cumsum(_in_order(_weights(cuts, chances, _entered(cuts, first, entering), first, cuts.shape[1]), first), axis=1)
        sums /= sums[:, -1:]
        ids = _in_order(cuts, first)
        for i in range(len(seeds)):
            k = (sums <= uniform(seeds[i : i + 1], token[i : i + 1], np.arange(lo, hi))[:, None]).sum(axis=1)
            chosen, step, here = ids[np.arange(len(ids)), k].tolist(), (k + 1).tolist(), at[i] - lo
            while here > 0:
                out[i].append(chosen[here - 1])
                here -= step[here - 1]
            at[i] = here + lo
    return out
