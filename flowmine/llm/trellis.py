"""Lattices of many units at once: Viterbi, least losses and path sums on arrays.

Units of like length are stacked; all their positions walk the tree of pieces
together, one character a step, so that step L gives the pieces of length L at
every position. The recursions then run over positions for the whole stack.
"""

from __future__ import annotations

import numpy as np

from flowmine.llm.pieces import MARK, Pieces

#: Longest unit that is stacked, and the cells (units times positions) of a stack.
LONGEST, CELLS = 48, 120_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class _Table:
    """Exact lookup of int64 keys: a slot per key, keys that clash go to the next table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.append(keys, -1)
        self.slots = []
        left = np.arange(len(keys))
        for m in _MULTIPLIERS * 8:
            slot = self._slot(self.keys[left], m)
            table = np.full(1 << self.bits, len(keys), np.int32)
            table[slot[::-1]] = left[::-1]
            self.slots.append((m, table))
            left = left[table[slot] != left]
            if not len(left):
                break
        else:
            raise ValueError("keys clash in every table")

    def _slot(self, keys: np.ndarray, m: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(m)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or the number of keys where it is absent."""
        out = np.full(len(keys), len(self.keys) - 1, np.int64)
        open_ = np.arange(len(keys))
        for m, table in self.slots:
            at = table[self._slot(keys[open_], m)]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (at < len(self.keys) - 1)]
            if not len(open_):
                break
        return out


class Trellis:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        prefixes = sorted(pieces.prefixes)
        state = {"": 0, **{p: i + 1 for i, p in enumerate(prefixes)}}
        alphabet = sorted({c for p in prefixes for c in p})
        self.codes = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.width = len(alphabet) + 1
        keys = np.array([state[p[:-1]] * self.width + self.codes[ord(p[-1])] for p in prefixes], np.int64)
        self.table = _Table(keys)                          # entry i leads to the state of prefix i
        self.score = np.array([pieces.log_p.get(p, -np.inf) for p in prefixes] + [-np.inf])
        self.piece = np.array([pieces.ids.get(p, -1) for p in prefixes] + [-1], np.int32)
        self.longest = max(map(len, prefixes))
        low = np.zeros(0x3000, np.int32)
        for c, i in self.codes.items():
            if c < len(low):
                low[c] = i
        low[ord(" ")], low[ord(MARK)] = self.codes.get(ord(MARK), 0), 0    # a mark of the text has no piece
        self.low = low

    def _coded(self, points: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(points, len(self.low) - 1)]
        high = np.flatnonzero(points >= len(self.low))
        if len(high):
            out[high] = [self.codes.get(c, 0) for c in points[high].tolist()]
        return out

    def stacks(self, units: list[str]):
        """(numbers of the units, their lattices) for stacks of units of one length, at most ``LONGEST``."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order) and (n := int(lengths[order[at]])) <= LONGEST:
            stop = int(np.searchsorted(lengths[order], n, side="right"))
            for lo in range(at, stop, max(1, CELLS // n)):
                rows = order[lo:min(stop, lo + max(1, CELLS // n))]
                text = "".join([units[i] for i in rows.tolist()])
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
                yield rows, self._lattice(points)
            at = stop

    def _lattice(self, points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """points, scores by piece length (positions x units) and the pieces themselves."""
        m, n = points.shape
        points = np.ascontiguousarray(points.T).astype(np.int64)         # by position, then unit
        codes = self._coded(points.ravel()).astype(np.int64)
        cells = np.flatnonzero(codes)
        states = np.zeros(len(cells), np.int64)
        scores, ids = [], []
        for size in range(1, min(self.longest, n) + 1):
            inside = cells + (size - 1) * m < m * n
            cells, states = cells[inside], states[inside]
            code = codes[cells + (size - 1) * m]
            found = self.table.find(states * self.width + code)
            alive = (found < len(self.score) - 1) & (code > 0)
            cells, found = cells[alive], found[alive]
            if not len(cells) and size > 1:
                break
            score, piece = np.full(m * n, -np.inf), np.full(m * n, -1, np.int32)
            score[cells], piece[cells] = self.score[found], self.piece[found]
            if size == 1:                                            # no piece of its own: spelt in bytes
                bare = np.flatnonzero(np.isneginf(score))
                p = points.ravel()[bare]
                score[bare] = (1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)) * self.pieces.byte_log_p
                piece[bare] = -2 - p
            states = found + 1
            scores.append(score.reshape(n, m))
            ids.append(piece.reshape(n, m))
        return points, scores, ids

    def _spell(self, code: int) -> list[int]:
        if code >= 0:
            return [code]
        return [self.pieces.byte_ids[b] for b in chr(-2 - code).encode("utf-8", "surrogatepass")]

    def best_paths(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all best paths, their bounds by unit, the scores and the losses of the second path."""
        total, loss = np.zeros(len(units)), np.full(len(units), np.inf)
        counts = np.zeros(len(units), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, (_, scores, pieces) in self.stacks(units):
            n, m = scores[0].shape
            best, choice = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
            best[0] = 0.0
            for j in range(1, n + 1):
                for size in range(min(j, len(scores)), 0, -1):
                    s = best[j - size] + scores[size - 1][j - size]
                    better = s > best[j]
                    best[j][better], choice[j][better] = s[better], size
            rest = np.full((n + 1, m), -np.inf)
            rest[n] = 0.0
            for i in range(n - 1, -1, -1):
                for size in range(1, min(n - i, len(scores)) + 1):
                    np.maximum(rest[i], scores[size - 1][i] + rest[i + size], out=rest[i])
            used = np.zeros((n + 1, m), np.int64)                       # length of the best path's piece by start
            at, live, step = np.full(m, n), np.arange(m), 0
            while len(live):
                size = choice[at[live], live]
                at[live] -= size
                used[at[live], live] = size
                counts[rows[live]] += 1
                for k in np.unique(size):
                    own = live[size == k]
                    found.append((rows[own], np.full(len(own), step), pieces[k - 1][at[own], own]))
                live = live[at[live] > 0]
                step += 1
            second = np.full(m, np.inf)
            for size in range(1, len(scores) + 1):
                through = best[:n + 1 - size] + scores[size - 1][:n + 1 - size] + rest[size:]
                through[used[:n + 1 - size] == size] = -np.inf
                np.minimum(second, (best[n] - through).min(axis=0), out=second)
            total[rows], loss[rows] = best[n], np.maximum(second, 0.0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        flat = np.zeros(bounds[-1], np.int64)
        if found:
            unit, step, piece = (np.concatenate(x) for x in zip(*found))
            flat[bounds[unit + 1] - 1 - step] = piece
        return self._spelt(flat, bounds, len(units)) + (total, loss)

    def _spelt(self, flat: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte spellings put in the place of characters without a piece."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, bounds
        spelt = [self._spell(c) for c in flat[odd].tolist()]
        extra = np.zeros(len(flat) + 1, np.int64)
        extra[odd + 1] = [len(s) - 1 for s in spelt]
        moved = np.arange(len(flat) + 1) + np.cumsum(extra)
        out = np.zeros(moved[-1], np.int64)
        out[moved[:-1]] = flat
        for i, s in zip(moved[odd].tolist(), spelt):
            out[i:i + len(s)] = s
        return out, moved[bounds]

    def log_sums(self, units: list[str]) -> np.ndarray:
        """Log of the summed probability of all paths of each unit: forward recursion in log space."""
        out = np.zeros(len(units))
        for rows, (_, scores, _) in self.stacks(units):
            n, m = scores[0].shape
            reach = np.full((n + 1, m), -np.inf)
            reach[0] = 0.0
            for j in range(1, n + 1):
                ways = [reach[j - size] + scores[size - 1][j - size] for size in range(1, min(j, len(scores)) + 1)]
                top = np.maximum.reduce(ways)
                reach[j] = top + np.log(sum(np.exp(w - top) for w in ways))
            out[rows] = reach[n]
        return out
