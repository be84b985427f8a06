"""Evidence of two raw names for many pairs at once, with the values of ``similarity.pair_evidence``."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from itertools import chain

import numpy as np

from . import similarity as S

#: Windows share matrices by these lengths; words longer than the last are compared one by one (difflib treats them differently).
_LENGTHS = np.array([3, 6, 12, 31, 199])
#: Pairs of windows that are compared at once, and words of a left name.
_ROWS, _GROUP = 8192, 32
#: After so many records with a word it is held against all names.
_USES = 3
#: Longest words whose common subsequences are counted: as many bits as a number has.
_BITS = 63
#: Bytes of matches that are held for words met lately.
_HELD = 64 << 20
#: So near to a tie in the eighth place a value is computed anew, as for a single pair.
_NEAR = 1e-5


def _block(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of columns of codes the longest common block, of equal ones the first in ``x`` and then in ``y``: its length and its ends.

    A cell is a number that holds a block's length and then its ends, counted backwards.
    """
    bits, kind = (5, np.int16) if max(len(x), len(y)) < 32 else (8, np.int32)
    top, one = (1 << bits) - 1, kind(1 << 2 * bits)
    end = top - np.arange(len(y), dtype=kind)[:, None]
    run, best, more = np.zeros((len(y) + 1, y.shape[1]), kind), np.zeros(y.shape[1], kind), np.empty(y.shape, kind)
    for i in range(len(x)):
        np.add(run[:-1], one, out=more)
        mask = (y == x[i]).astype(kind)
        np.negative(mask, out=mask)
        np.bitwise_and(more, mask, out=run[1:])
        np.add(run[1:], end + kind((top - i) << bits), out=more)
        np.maximum(best, more.max(axis=0), out=best)
    best = best.astype(np.int64)
    return best >> 2 * bits, top + 1 - (best >> bits & top), top + 1 - (best & top)


def _matched(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Characters in the matching blocks that difflib finds in each pair of windows of the codes ``a`` and ``b``; a block leaves a left and a right pair."""
    owner, out = np.arange(len(a_at)), np.zeros(len(a_at), np.int64)
    while len(owner):
        size, i, j = (np.zeros(len(owner), np.int64) for _ in range(3))
        kind = np.searchsorted(_LENGTHS, a_len) * len(_LENGTHS) + np.searchsorted(_LENGTHS, b_len)
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for s in range(lo, hi, _ROWS):
                t = order[s : min(s + _ROWS, hi)]
                side = []
                for codes, at, n, pad in ((a, a_at[t], a_len[t], 0), (b, b_at[t], b_len[t], 1)):
                    place = np.arange(n.max())[:, None]
                    side.append(np.where(place < n, codes.take(at + place, mode="clip"), codes.dtype.type(pad)))
                size[t], i[t], j[t] = _block(*side)
        out += np.bincount(owner, size, len(out)).astype(np.int64)
        left = np.flatnonzero((size > 0) & (i > size) & (j > size))
        right = np.flatnonzero((size > 0) & (i < a_len) & (j < b_len))
        parts = (owner, owner), (a_at, a_at + i), (i - size, a_len - i), (b_at, b_at + j), (j - size, b_len - j)
        owner, a_at, a_len, b_at, b_len = (np.concatenate([p[left], q[right]]) for p, q in parts)
    return out


class _Words:
    """Distinct words, shortest first, and how many characters of them match another word."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, np.array([len(w) for w in words], np.int64)
        self.code = {c: k + 2 for k, c in enumerate(sorted({c for w in words for c in w}))}
        self.start = np.cumsum(self.length) - self.length
        codes = np.array([self.code[c] for w in words for c in w], np.int64)
        self.codes = self._small(codes)
        self.known: dict[str, np.ndarray] = {}

    def _small(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.uint8 if len(self.code) < 253 else np.int32)

    def _row(self, x: str) -> np.ndarray:
        """What was counted for ``x``, -1 where it was not; held for the next record with this word."""
        got = self.known.pop(x, None)
        if got is None:
            got = np.full(len(self.words), -1, np.int32)
            while self.known and (len(self.known) + 1) * got.nbytes > _HELD:
                del self.known[next(iter(self.known))]
        self.known[x] = got
        return got

    def _common(self, x: str, words: np.ndarray) -> np.ndarray:
        """No fewer than match: the longest common subsequence with each word, where neither is long.

        The bits of a number are the places of ``x``; each character of a word is one step for all words (Hyyrö).
        """
        if len(x) > _BITS:
            return np.minimum(self.length[words], len(x))
        table = np.zeros(len(self.code) + 2, np.uint64)
        for i, c in enumerate(x):
            if c in self.code:
                table[self.code[c]] |= np.uint64(1 << i)
        length, start = self.length[words], self.start[words]
        bits = np.full(len(words), (1 << len(x)) - 1, np.uint64)
        short = int(np.searchsorted(length, _BITS, side="right"))
        for j in range(int(length[short - 1]) if short else 0):
            k = int(np.searchsorted(length, j, side="right"))
            v = bits[k:short]
            u = v & table.take(self.codes.take(start[k:short] + j))
            np.bitwise_or(v + u, v - u, out=v)
        free = np.bitwise_count(bits & np.uint64((1 << len(x)) - 1)).astype(np.int64)
        return np.concatenate([len(x) - free[:short], np.minimum(length[short:], len(x))])

    def _need(self, own: list[str], rows: list[np.ndarray], need: list[np.ndarray]) -> None:
        """Counts the words ``need`` of each of ``own``."""
        which = np.concatenate(need)
        if not len(which):
            return
        lengths = np.array([len(x) for x in own])
        mine = np.repeat(np.arange(len(own)), [len(n) for n in need])
        # 0 is no character of any word
        codes = self._small(np.array([self.code.get(c, 0) for x in own for c in x], np.int64))
        n = np.zeros(len(which), np.int64)
        short = (lengths[mine] <= _LENGTHS[-1]) & (self.length[which] <= _LENGTHS[-1])
        m, w = mine[short], which[short]
        n[short] = _matched(codes, (np.cumsum(lengths) - lengths)[m], lengths[m], self.codes, self.start[w], self.length[w])
        for k in np.flatnonzero(~short).tolist():
            n[k] = sum(b.size for b in SequenceMatcher(None, own[mine[k]], self.words[which[k]]).get_matching_blocks())
        upto = np.cumsum([0, *[len(x) for x in need]])
        for k, (row, w) in enumerate(zip(rows, need, strict=True)):
            row[w] = n[upto[k] : upto[k + 1]]

    def like(self, x: str, which: np.ndarray) -> np.ndarray:
        """difflib's ratio of ``x`` and each of the words."""
        got = self._row(x)
        self._need([x], [got], [np.unique(which[got[which] < 0])])
        return 2.0 * got[which] / (len(x) + self.length[which])

    def best(self, own: list[str], flat: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each of ``own`` its largest ratio with the words of each list (``flat``, each from ``first`` on).

        Common subsequences bound a ratio: first the words with the largest bound of each list are counted, then those
        whose bound is above what their list has.
        """
        mark = np.zeros(len(self.words), bool)
        mark[flat] = True
        words = np.flatnonzero(mark)
        back, size = (np.cumsum(mark) - 1)[flat], np.diff(np.append(first, len(flat)))
        rows, bounds = [self._row(x) for x in own], []
        totals = [len(x) + self.length[words] for x in own]

        def have(k: int) -> np.ndarray:
            return np.maximum(2.0 * rows[k][words] / totals[k], 0.0)[back]

        need = []
        for x, row, total in zip(own, rows, totals, strict=True):
            n = row[words]
            bound = 2.0 * np.where(n < 0, self._common(x, words), n) / total
            # of equal bounds one word is first in all lists
            order = np.argsort(bound, kind="stable")
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            first_of = np.zeros(len(words), bool)
            first_of[order[np.maximum.reduceat(rank[back], first)]] = True
            bounds.append(bound)
            need.append(words[first_of & (n < 0)])
        self._need(own, rows, need)
        need, out = [], []
        for k, bound in enumerate(bounds):
            now = have(k)
            out.append(np.maximum.reduceat(now, first))
            # words above what any list has need no look at the lists
            open_ = (rows[k][words] < 0) & (bound > out[k].min())
            if open_.any():
                mark = np.zeros(len(words), bool)
                mark[back[np.where(open_, bound, 0.0)[back] > np.repeat(out[k], size)]] = True
                need.append(words[mark & open_])
            else:
                need.append(words[:0])
        self._need(own, rows, need)
        return [np.maximum.reduceat(have(k), first) if len(need[k]) else out[k] for k in range(len(own))]


class _Lists:
    """Lists of words of each name, one after the other."""

    def __init__(self, lists: list[list[int]]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.array([w for x in lists for w in x], np.int64)

    def of(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of names that all have some, and where each name's begin."""
        size = self.size[names]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[names] - first, size) + np.arange(size.sum())], first


def _label(domain: str) -> str:
    return domain.split(".")[0].replace("-", " ") if "." in domain else ""


class Evidence:
    """Many right names, held against one left name after the other."""

    def __init__(self, names: list[str]):
        codes = {x: k for k, x in enumerate(dict.fromkeys(names))}
        self.name, self.names = np.array([codes[x] for x in names], np.int64), list(codes)
        domains = [S.embedded_domain(x) for x in self.names]
        labels = [_label(d) for d in domains]
        words, theirs = [sorted(S.words(x)) for x in self.names], [sorted(S.words(x)) for x in labels]
        at = {w: k for k, w in enumerate(sorted({w for many in (words, theirs, [[x] for x in labels if x]) for x in many for w in x}, key=lambda w: (len(w), w)))}
        self.all = _Words(list(at))
        self.words, self.label_words = (_Lists([[at[w] for w in x] for x in many]) for many in (words, theirs))
        self.domain = np.array([bool(d) for d in domains], bool)
        self.label = np.array([at[x] if x else -1 for x in labels], np.int64)
        self.some = np.flatnonzero(self.words.size)
        self.uses: Counter[str] = Counter()
        self.full: dict[str, np.ndarray] = {}

    def _often(self, x: str) -> np.ndarray | None:
        """A frequent word's largest ratios for all names."""
        self.uses[x] += 1
        if len(self.uses) > 1 << 20:
            self.uses.clear()
        got = self.full.pop(x, None)
        if got is None and self.uses[x] > _USES:
            got = np.zeros(len(self.names))
            got[self.some] = self.all.best([x], self.words.flat, self.words.start[self.some])[0]
            while self.full and (len(self.full) + 1) * got.nbytes > _HELD:
                del self.full[next(iter(self.full))]
        if got is not None:
            self.full[x] = got
        return got

    def _best(self, own: list[str], lists: _Lists, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directed similarity and coverage."""
        soft, cover = np.zeros(len(names)), np.zeros(len(names))
        some = np.flatnonzero(lists.size[names])
        if own and len(some):
            flat, first = lists.of(names[some])
            total, good = np.zeros(len(some)), np.zeros(len(some), np.int64)
            full = [self._often(x) if lists is self.words else None for x in own]
            rest = [x for x, f in zip(own, full, strict=True) if f is None]
            groups = (self.all.best(rest[k : k + _GROUP], flat, first) for k in range(0, len(rest), _GROUP))
            for best in chain((f[names[some]] for f in full if f is not None), chain.from_iterable(groups)):
                total += best
                good += best >= 0.85
            soft[some], cover[some] = total / len(own), good / len(own)
        return soft, cover

    def of(self, left: str, at: np.ndarray) -> list[np.ndarray]:
        """``similarity.EXTRA`` of ``left`` and each of the names at these places."""
        names, back = np.unique(self.name[at], return_inverse=True)
        domain = S.embedded_domain(left)
        label, theirs = _label(domain), self.domain[names]
        soft, cover = self._best(sorted(S.words(left)), self.words, names)
        same = np.zeros(len(names))
        both = np.flatnonzero(self.label[names] >= 0)
        if label and len(both):
            same[both] = self.all.like(label, self.label[names[both]])
        label_cover = self._best(sorted(S.words(label)), self.label_words, names)[1]
        out = np.stack([soft, cover, theirs | bool(domain), np.full(len(names), bool(domain)), theirs, same, label_cover, np.maximum(soft, same)]).astype(np.float64)
        scaled = out * 1e8
        near = np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < _NEAR).any(axis=0))
        out = np.rint(scaled) / 1e8
        for k in near.tolist():
            out[:, k] = S.pair_evidence(left, self.names[names[k]])
        return list(out[:, back])
