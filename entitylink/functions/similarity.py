"""Similarities of strings, token sets and evidence.  Sets are arrays; what Catalyst lacks is an Arrow function."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from . import tables as T
from .text import strip_marks

# -- native -----------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of the elements as sets; 0 when both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def set_jaccard(a: Column, b: Column) -> Column:
    """The same for arrays without repeats: one intersection, no union."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if either is empty."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def edit_similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """0 if either is empty; ``distance`` where it is known already."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - (F.levenshtein(a, b) if distance is None else distance) / n))


def max_containment(a: Column, b: Column) -> Column:
    """The larger of the shares of each side that the other holds; 0 if either is empty."""
    both, x, y = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(F.greatest(both / x, both / y))


def edits(a: str, b: str) -> int:
    """Levenshtein's distance, as ``F.levenshtein`` has it; a column of the table is the bits of two numbers (Myers, Hyyrö)."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    code = np.frombuffer(a.encode("utf-32-le"), np.uint32)
    at = {c: int.from_bytes(np.packbits(code == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    full = (1 << len(a)) - 1
    up, down = full, 0
    for c in b:
        eq = at[c]
        x = ((eq & up) + up ^ up) | eq
        right, left = (down | full ^ (x | up) & full) << 1 | 1, (up & x) << 1
        eq |= down
        up, down = (left | full ^ (eq | right) & full) & full, right & eq & full
    return len(b) + up.bit_count() - down.bit_count()


#: Numbers of 64 bits that a shorter name may have to be compared with many pairs at once, and for each of them the pairs from which this is faster.
_WIDE, _MANY = 16, 12


def edits_of_many(pairs: list[tuple[str, str]]) -> list[int]:
    """``edits`` of each pair; pairs whose shorter names have as many numbers of 64 bits are computed at once in arrays."""
    out, alike = [0] * len(pairs), {}
    for k, (a, b) in enumerate(pairs):
        words = (min(len(a), len(b)) + 63) // 64
        if 0 < words <= _WIDE and a != b:
            alike.setdefault(words, []).append(k)
        else:
            out[k] = edits(a, b)
    for words, ks in alike.items():
        some = [pairs[k] for k in ks]
        for k, d in zip(ks, _edits(some, words) if len(ks) >= _MANY * words else [edits(*p) for p in some], strict=True):
            out[k] = d
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters in one array, and where each begins."""
    size = np.array([len(x) for x in texts])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(size) - size


def _edits(pairs: list[tuple[str, str]], words: int) -> list[int]:
    """The distances in arrays of numbers: a number's carries go to the next one as the difference at its last row (Myers, Hyyrö)."""
    pairs = [(b, a) if len(a) > len(b) else (a, b) for a, b in pairs]
    size = np.array([len(b) for _, b in pairs])
    order = np.argsort(-size, kind="stable")
    pairs, size = [pairs[k] for k in order.tolist()], size[order]
    short = list(dict.fromkeys(a for a, _ in pairs))
    place = {a: k for k, a in enumerate(short)}
    row = np.array([place[a] for a, _ in pairs])
    code, start = _codes(short)
    letters, code = np.unique(code, return_inverse=True)
    if len(pairs) > 1 and len(short) * (len(letters) + 1) * words > 4 * _PLACES:
        half = len(pairs) // 2
        out = np.empty(len(pairs), np.int64)
        out[order] = [*_edits(pairs[:half], words), *_edits(pairs[half:], words)]
        return out.tolist()
    length = np.array([len(a) for a in short])
    at = np.arange(len(code)) - np.repeat(start, length)
    table = np.zeros((len(short), len(letters) + 1, words), np.uint64)
    one = np.uint64(1)
    np.bitwise_or.at(table, (np.repeat(np.arange(len(short)), length), code, at >> 6), one << (at & 63).astype(np.uint64))
    text, begin = _codes([b for _, b in pairs])
    found = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
    text = np.where(letters[found] == text, found, len(letters))
    n = length[row]
    last, d = ((n - 1) & 63).astype(np.uint64), n.astype(np.int64)
    top = np.uint64(63)
    ups, downs = np.full((words, len(pairs)), ~np.uint64(0)), np.zeros((words, len(pairs)), np.uint64)
    live = len(pairs)
    for j in range(int(size[0])):
        while size[live - 1] <= j:
            live -= 1
        rows = table[row[:live], text[begin[:live] + j]]
        more, less = np.ones(live, np.uint64), np.zeros(live, np.uint64)
        for w in range(words):
            eq, up, down = rows[:, w], ups[w, :live], downs[w, :live]
            x = eq | down
            eq = eq | less
            h = ((eq & up) + up ^ up) | eq
            plus, minus = down | ~(h | up), up & h
            if w == words - 1:
                d[:live] += (plus >> last[:live] & one).astype(np.int64) - (minus >> last[:live] & one).astype(np.int64)
            right, left = plus << one | more, minus << one | less
            more, less = plus >> top, minus >> top
            ups[w, :live] = left | ~(x | right)
            downs[w, :live] = right & x
    out = np.empty(len(pairs), np.int64)
    out[order] = d
    return out.tolist()


# -- Jaro-Winkler -----------------------------------------------------------------------------


def jaro(a: str, b: str) -> float:
    """Half a transposition counts as half.  The free places of each character of ``b`` are the bits of a number."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, int] = {}
    if len(b) > 512:
        code = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in set(a):
            if c in b:
                places[c] = int.from_bytes(np.packbits(code == ord(c), bitorder="little").tobytes(), "little")
    else:
        for j, c in enumerate(b):
            places[c] = places.get(c, 0) | 1 << j
    # no more characters can have a place than occur in both
    most = sum(min(a.count(c), places[c].bit_count()) for c in places)
    taken, mine = 0, []
    for i, c in enumerate(a):
        if free := places.get(c, 0) & ~taken & (1 << i + reach + 1) - 1 >> max(0, i - reach) << max(0, i - reach):
            taken |= free & -free
            mine.append(c)
        if len(mine) == most or i > len(b) + reach:
            break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, bit in zip(b, reversed(f"{taken:0{len(b)}b}"), strict=True) if bit == "1"]
    t = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2.0
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    p = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        p += 1
    return min(1.0, s + p * 0.1 * (1 - s))


#: Names up to so many characters are compared many pairs at once; longer ones pair by pair.
_LONGEST = 1024
#: Pairs that are compared at once, numbers in their tables, and for each number of a right name the pairs from which this is faster.
_PAIRS, _PLACES, _FEW = 2048, 1 << 20, 16


def _padded(codes: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, pad: int) -> np.ndarray:
    at = np.arange(width)
    within = at < size[:, None]
    return np.where(within, codes[np.where(within, start[:, None] + at, 0)], pad)


def _many(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, kinds: int) -> np.ndarray:
    """As ``jaro_winkler`` of rows of codes that aren't equal; free places are the bits of a few numbers a row."""
    n, words = len(a), b.shape[1] // 64
    one = np.uint64(1)
    row, j = np.nonzero(np.arange(b.shape[1]) < lb[:, None])
    cell, bit = (b[row, j] * n + row).astype(np.int64), one << (j % 64).astype(np.uint64)
    places = []
    for w in range(words):
        places.append(np.zeros((kinds + 1) * n, np.uint64))
        np.add.at(places[w], cell[j // 64 == w], bit[j // 64 == w])
    cells = np.ascontiguousarray(a.T) * n + np.arange(n)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    first = np.arange(a.shape[1] + int(reach.max()) + 2)  # how many places lie before the end of a window
    low = []  # as many lowest bits of each number
    for w in range(words):
        k = np.clip(first - 64 * w, 0, 64).astype(np.uint64)
        low.append(np.where(k == 64, ~np.uint64(0), (one << (k % np.uint64(64))) - one))
    free, mine = [np.full(n, ~np.uint64(0)) for _ in range(words)], np.zeros((a.shape[1], n), bool)
    for i in range(a.shape[1]):
        high, below, found = i + reach + 1, np.maximum(i - reach, 0), mine[i]
        for w in range(words):
            got = places[w].take(cells[i])
            got &= free[w]
            got &= low[w].take(high)
            got &= ~low[w].take(below)
            got &= ~got + one  # the first bit
            if w:
                got[found] = 0
            free[w] ^= got
            found |= got != 0
    mine, free = np.ascontiguousarray(mine.T), np.stack(free, axis=1)
    theirs = np.unpackbits((~free).astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
    m = mine.sum(axis=1)
    odd = np.concatenate([np.zeros(1, np.int64), np.cumsum(a[mine] != b[theirs], dtype=np.int64)])
    ends = np.cumsum(m)
    t, m_ = (odd[ends] - odd[ends - m]) / 2.0, np.maximum(m, 1)
    s = np.where(m > 0, (m / la + m / lb + (m - t) / m_) / 3, 0.0)
    p = np.cumprod(a[:, :4] == b[:, : min(4, a.shape[1])], axis=1).sum(axis=1)
    return np.where(s <= 0.7, s, np.minimum(1.0, s + p * 0.1 * (1 - s)))


def jaro_winklers(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``jaro_winkler`` of each pair, many at once."""
    out = np.zeros(len(pairs))
    names = {x: k for k, x in enumerate(dict.fromkeys(x for p in pairs for x in p))}
    size = np.array([len(x) for x in names], np.int64)
    if not size.any():
        return out
    short = [x if len(x) <= _LONGEST else "" for x in names]
    kept = np.where(size <= _LONGEST, size, 0)
    char, codes = np.unique(np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    start, kinds = np.cumsum(kept) - kept, len(char)
    x, y = (np.array([names[p[k]] for p in pairs], np.int64) for k in (0, 1))
    la, lb = size[x], size[y]
    out[x == y] = np.where(la[x == y] > 0, 1.0, 0.0)
    open_ = (x != y) & (la > 0) & (lb > 0)
    for k in np.flatnonzero(open_ & ((la > _LONGEST) | (lb > _LONGEST))).tolist():
        out[k] = jaro_winkler(*pairs[k])
    open_ &= (la <= _LONGEST) & (lb <= _LONGEST)
    for w in (1, 2, 4, 8, 16):
        at = np.flatnonzero(open_ & (lb <= 64 * w) & (lb > (32 * w if w > 1 else 0)))
        at, k = at[np.argsort(la[at], kind="stable")], 0
        while k < len(at):
            step = min(_PAIRS, _PLACES // ((kinds + 1) * w), _PLACES // int(la[at[k : k + _PAIRS]].max()))
            r = at[k : k + max(1, step)]
            k += len(r)
            if len(r) < _FEW * w:
                out[r] = [jaro_winkler(*pairs[i]) for i in r.tolist()]
                continue
            # no place has the code that fills up a left name; a right one's own is never looked at
            out[r] = _many(_padded(codes, start[x[r]], la[r], int(la[r].max()), kinds), _padded(codes, start[y[r]], lb[r], 64 * w, kinds + 1), la[r], lb[r], kinds)
    return out


@pandas_udf(DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of a batch is computed once."""
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    known = {pair: k for k, pair in enumerate(dict.fromkeys(pairs))}
    got = jaro_winklers(list(known))
    return pd.Series(got[[known[p] for p in pairs]], dtype="float64")


# -- evidence ---------------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+")
_HOST = re.compile(T.EVIDENCE_DOMAIN, re.IGNORECASE)


def evidence_text(s: str | None) -> str:
    """Without marks, case-folded; everything but word characters is one space."""
    s = (s or "").strip()
    s = strip_marks(s).casefold()
    return " ".join(re.sub(r"[^\w\s]", " ", s).split())


def evidence_tokens(s: str | None) -> list[str]:
    """Distinct words of the text, in order."""
    return list(dict.fromkeys(_WORD.findall(evidence_text(s))))


def like(a: str, b: str) -> float:
    """difflib's ratio."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def sequence_similarity(left: str | None, right: str | None) -> float:
    """Of the evidence texts; 0 if one is empty."""
    a, b = evidence_text(left), evidence_text(right)
    return like(a, b) if a and b else 0.0


def _best(x: str, others) -> float:
    return max((like(x, y) for y in others), default=0.0)


def _smaller_first(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    return (b, a) if len(a) > len(b) else (a, b)


def soft_similarity(a: list[str], b: list[str]) -> float:
    """Mean of the best match of each token of the smaller side."""
    a, b = _smaller_first(a, b)
    return sum(_best(x, b) for x in a) / len(a) if a and b else 0.0


def soft_coverage(a: list[str], b: list[str], least: float = 0.80) -> float:
    """Share of the smaller side's tokens whose best match is good enough."""
    a, b = _smaller_first(a, b)
    return sum(_best(x, b) >= least for x in a) / len(a) if a and b else 0.0


def host(value: str | None) -> str:
    """The host of a domain or URL, without www."""
    m = _HOST.match((value or "").strip().casefold())
    return m.group(1).strip(".").removeprefix("www.") if m else ""


def domain_tokens(value: str | None) -> list[str]:
    """Letters and digits of a domain's first label, cut at everything else."""
    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", host(value).split(".", 1)[0]) if t))


def domain_name_similarity(domain: str | None, name: str | None) -> float:
    """The better of token by token and as one word."""
    d, n = domain_tokens(domain), evidence_tokens(name)
    return max(soft_similarity(d, n), like("".join(d), "".join(n))) if d and n else 0.0


def domain_coverage(domain: str | None, name: str | None, least: float = 0.80) -> float:
    """1 if both resemble each other as one word; else the smaller side's share of tokens with a good match."""
    d, n = domain_tokens(domain), evidence_tokens(name)
    if not d or not n:
        return 0.0
    return 1.0 if like("".join(d), "".join(n)) >= least else soft_coverage(d, n, least)


def name_coverage(name: str | None, domain: str | None, least: float = 0.80) -> float:
    """1 if both resemble each other as one word; else the share of the name's words that the domain contains or resembles."""
    n, d = evidence_tokens(name), domain_tokens(domain)
    if not d or not n:
        return 0.0
    whole = "".join(d)
    if like("".join(n), whole) >= least:
        return 1.0
    return sum(t in whole or _best(t, d) >= least for t in n) / len(n)


def combined_evidence(name: str | None, domain: str | None) -> float:
    return max(domain_name_similarity(domain, name), domain_coverage(domain, name), name_coverage(name, domain))


#: The vector's names (fixed: stored features name them).
SECONDARY = (
    "soft_token_similarity", "soft_token_coverage", "domain_name_similarity_left_domain", "domain_name_similarity_right_domain", "domain_name_coverage_left_domain",
    "domain_name_coverage_right_domain", "name_domain_coverage_left_name", "name_domain_coverage_right_name", "combined_name_domain_evidence",
)


def secondary(left: str | None, right: str | None, left_domain: str | None, right_domain: str | None) -> list[float]:
    """The nine values of ``SECONDARY``: a side's domain is held against the other side's name."""
    a, b = evidence_tokens(left), evidence_tokens(right)
    return [
        soft_similarity(a, b), soft_coverage(a, b), domain_name_similarity(left_domain, right), domain_name_similarity(right_domain, left),
        domain_coverage(left_domain, right), domain_coverage(right_domain, left), name_coverage(left, right_domain), name_coverage(right, left_domain),
        max(combined_evidence(right, left_domain), combined_evidence(left, right_domain)),
    ]


def _doubles(names: tuple[str, ...]) -> StructType:
    """A type object: worker processes have no session to parse a string with."""
    return StructType([StructField(c, DoubleType()) for c in names])


@pandas_udf(_doubles(SECONDARY))
def secondary_of(left: pd.Series, right: pd.Series, left_domain: pd.Series, right_domain: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([secondary(*r) for r in zip(left, right, left_domain, right_domain, strict=True)], columns=list(SECONDARY), dtype="float64")


EXTRA = ("soft_token_similarity", "soft_token_coverage", "embedded_domain_present", "embedded_domain_left_present", "embedded_domain_right_present", "embedded_domain_name_similarity", "embedded_domain_name_coverage", "combined_name_domain_evidence")
_EMBEDDED = re.compile(T.EMBEDDED_DOMAIN, re.IGNORECASE)


def embedded_domain(name: str | None) -> str:
    """The first domain within a name."""
    m = _EMBEDDED.search(name or "")
    return m.group(1).casefold() if m else ""


def words(s: str | None) -> set[str]:
    return {w.casefold() for w in _WORD.findall(s or "")}


def directed_similarity(a: set[str], b: set[str]) -> float:
    """Mean of the best match of each word of the left side."""
    return math.fsum(_best(x, b) for x in a) / len(a) if a and b else 0.0


def directed_coverage(a: set[str], b: set[str], least: float = 0.85) -> float:
    """Share of the left side's words that the right side covers."""
    return sum(_best(x, b) >= least for x in a) / len(a) if a and b else 0.0


def pair_evidence(left: str | None, right: str | None) -> list[float]:
    """The eight values of ``EXTRA`` from two raw names, to 8 places."""
    dl, dr = embedded_domain(left), embedded_domain(right)
    label = lambda d: d.split(".")[0].replace("-", " ") if "." in d else ""
    ll, lr = label(dl), label(dr)
    same = like(ll, lr) if ll and lr else 0.0
    soft = directed_similarity(words(left), words(right))
    out = [soft, directed_coverage(words(left), words(right)), float(bool(dl or dr)), float(bool(dl)), float(bool(dr)), same, directed_coverage(words(ll), words(lr)), max(soft, same)]
    return [round(v, 8) for v in out]


@pandas_udf(_doubles(EXTRA))
def pair_evidence_of(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pair_evidence(x, y) for x, y in zip(left, right, strict=True)], columns=list(EXTRA), dtype="float64")
