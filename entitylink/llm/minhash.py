"""MinHash near-duplicates: universal hash minima, banding, signature check, confirmation on full sets, components.

A text's words are the maximal runs without ASCII white space, A-Z lower-cased; its set holds the
distinct runs of ``SHINGLE`` words (all words as one, if there are fewer), as 64-bit hashes.  A signature
has ``BANDS * ROWS`` minima of multiply-shift hashes (universal: (a * x + b) mod 2^64, upper half), and
each band of ROWS minima is a bucket key.  Documents with equal sets are one node, so groups of exact
copies cost one comparison.

Buckets are compared in two steps, so that no task sees a bucket whole and dense groups don't emit all
pairs:

1. every member against the smallest node of its bucket; confirmed links give components;
2. what is still in different components within a bucket, without that smallest node: members outside the
   bucket's largest component must still meet the others.  Both are dealt into blocks of ``BLOCK`` with
   their sets, and each pair of blocks that holds one of the former is one group of rows; a pair is compared
   once, in the first band that its members share, and only links that unite are emitted.

Where a bucket, a bucket's smallest node, a set or a component holds more than a thousandth of the rows
of a join, its rows are dealt over many tasks.

Pairs whose signatures agree less than ``SLACK`` standard errors below the threshold are dropped (a true
link fails that once in millions); the others are confirmed on the full sets by exact counts.  Components
come from alternating large-star and small-star steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, hot_keys, lean, meet, raw
from .components import components

SHINGLE, BANDS, ROWS, SLACK, BLOCK = 5, 24, 5, 5.0, 256
PIECE = 1 << 22
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, BANDS * ROWS, dtype=np.uint64)
_T = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_T[65:91] = _T[97:123]
_WS = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("r", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("r", _R), ("i", _RINV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["r"], _POWERS["i"]


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of the bytes."""
    white = _WS[b]
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    r, inv = _powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_T[b] * r[: len(b)], dtype=np.uint64)])
    return starts, _mix((total[ends] - total[starts]) * inv[starts])


def _runs(w: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words."""
    out = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        out = out * np.uint64(0x2545F4914F6CDD1D) + w[j : len(w) - SHINGLE + 1 + j]
    return _mix(out)


def sets(b: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a buffer."""
    if len(b) > PIECE:  # a very long text: words piece by piece, cut at white space
        for i in range(len(ends) - 1):
            t, at, ws = b[ends[i] : ends[i + 1]], 0, []
            while at < len(t):
                to = min(len(t), at + PIECE)
                while to < len(t) and not _WS[t[to]]:
                    to += 1
                ws.append(word_hashes(t[at:to])[1])
                at = to
            yield _set(np.concatenate(ws) if ws else np.zeros(0, np.uint64))
        return
    # a space after each text, so that no word crosses texts
    n = len(ends) - 1
    spaced = np.full(len(b) + n, 32, np.uint8)
    keep = np.ones(len(spaced), bool)
    keep[ends[1:] + np.arange(n)] = False
    spaced[keep] = b
    starts, h = word_hashes(spaced)
    at = np.searchsorted(starts, ends + np.arange(n + 1))
    shingled = _runs(h) if len(h) >= SHINGLE else np.zeros(0, np.uint64)
    for i in range(n):
        k = at[i + 1] - at[i]
        yield np.unique(shingled[at[i] : at[i + 1] - SHINGLE + 1]) if k >= SHINGLE else _set(h[at[i] : at[i + 1]])


def _set(w: np.ndarray) -> np.ndarray:
    if len(w) >= SHINGLE:
        return np.unique(_runs(w))
    if not len(w):
        return np.zeros(0, np.uint64)
    x = np.full(1, len(w), np.uint64)
    for v in w:
        x = _mix(x * np.uint64(0x2545F4914F6CDD1D) + v)
    return x


def signature(s: np.ndarray) -> np.ndarray:
    """The minima as 32-bit numbers; s is not empty."""
    x = s >> np.uint64(32)
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at : at + 1024, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    x = np.zeros(BANDS, np.uint64)
    for c in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        x = _mix(x * np.uint64(0x2545F4914F6CDD1D) + c + np.uint64(1))
    return x.view(np.int64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set; 0 and 0 for the empty one."""
    return (int(np.sum(_mix(s)).view(np.int64)), int(np.bitwise_xor.reduce(_mix(s * _R)).view(np.int64))) if len(s) else (0, 0)


_SIGNED = "doc_id long, n_shingles long, fp_a long, fp_b long, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in blocks(batches):
        n, a, c, sig = [], [], [], []
        for x in sets(*raw(s.column(1))):
            n.append(len(x))
            fp = _fingerprint(x)
            a.append(fp[0])
            c.append(fp[1])
            sig.append(signature(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp_a", "fp_b", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            s = batch.slice(at, 2000)
            node = s.column(0).to_numpy(zero_copy_only=False)
            keys = np.stack([band_keys(np.frombuffer(x, np.uint32)) for x in s.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(node))), pa.array(keys.ravel())], ["node", "band", "key"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(_same(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _same(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked, by exact counts."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _agree(least: int, percent: int):
    """Within runs of rows sorted by (band, key, one, two): links between the blocks ``one`` and ``two``.

    Pairs in falling order of agreement; a pair that earlier links of the run have united already is passed
    over, so a run gives fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def compare() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            band, _, one, two = key
            node, side = np.array([h[0] for h in held]), np.array([h[2] for h in held])
            comp = np.unique([h[1] for h in held], return_inverse=True)[1]
            sig = np.stack([np.frombuffer(h[3], np.uint32) for h in held])
            i, j = np.flatnonzero(side == one), np.flatnonzero(side == two)
            found: list[tuple[int, int, int]] = []
            for a in i:
                others = j[(comp[j] != comp[a]) & ((node[j] > node[a]) if one == two else True)]
                if not len(others):
                    continue
                same = sig[others] == sig[a]
                n = same.sum(1)
                ok = n >= least
                others, same, n = others[ok], same[ok], n[ok]
                if len(others):
                    # each pair once: in the first band that it shares
                    first = same.reshape(len(others), BANDS, ROWS).all(2).argmax(1) == band
                    found += [(-int(m), int(a), int(o)) for m, o in zip(n[first], others[first], strict=True)]
            up = list(range(int(comp.max()) + 1))

            def find(c: int) -> int:
                while up[c] != c:
                    up[c] = up[up[c]]
                    c = up[c]
                return c

            out = []
            for _, a, o in sorted(found):
                x, y = find(int(comp[a])), find(int(comp[o]))
                if x != y and _same(np.frombuffer(held[a][4], np.uint64), np.frombuffer(held[o][4], np.uint64), percent):
                    up[x] = y
                    out.append((max(node[a], node[o]), min(node[a], node[o])))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"]) if out else None

        for batch in batches:
            for band, k, one, two, node, comp, block, sig, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (band, k, one, two) != key:
                    if (got := compare()) is not None:
                        yield got
                    key, held = (band, k, one, two), []
                held.append((node, comp, block, sig, members))
        if (got := compare()) is not None:
            yield got

    return run


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``docs`` with fp_a and fp_b, which name the set of each row's text."""
    from pyspark.sql.types import LongType, StructField, StructType

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in blocks(batches):
            fp = [_fingerprint(x) for x in sets(*raw(s.column(at)))]
            yield pa.RecordBatch.from_arrays([*s.columns, *(pa.array([f[k] for f in fp], pa.int64()) for k in (0, 1))], [*s.schema.names, "fp_a", "fp_b"])

    return lean(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField("fp_a", LongType()), StructField("fp_b", LongType())]))


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = 85, fingerprints: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and fp_a and fp_b if wanted.

    Documents are linked when 100 * intersection >= percent * union of their sets.  Texts that are null or
    without words have an empty set and link with nothing; neither do rows with a null id, whose component
    is null and which are kept.  Rows that repeat an id are documents of their own: equal ones share a set and
    a component.  An empty table gives no rows; other columns are not looked at.
    """
    est = percent / 100
    least = math.ceil((est - SLACK * math.sqrt(est * (1 - est) / (BANDS * ROWS))) * BANDS * ROWS)
    text = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(text.mapInArrow(_sign, _SIGNED), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    fp = ["fp_a", "fp_b", "n_shingles"]
    # a node is a set; its number is dense, its rep the smallest document with that set
    slim = full.groupBy(*fp).agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.save(slim.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = scratch.save(nodes.select("node", "sig").mapInArrow(_bands, "node long, band int, key long"), "bands")
    # members of buckets with company, each with the bucket's smallest node
    bucket = ["band", "key"]
    pivots = scratch.save(banded.groupBy(*bucket).agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pivots")
    member = scratch.save(meet(banded, pivots, bucket, hot_keys(pivots, bucket), ["node"]), "members")
    scratch.drop("bands")
    wanted = member.select("node").distinct().join(nodes.select("node", "rep", "fp_a", "fp_b"), "node")
    # the texts of those nodes again, for their full sets: joined by id, checked by fingerprint where an id repeats
    ids = full.select("doc_id", "fp_a", "fp_b").distinct().join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "fp_a", "fp_b"]).select("doc_id", "node", "fp_a")
    some = text.join(ids, "doc_id").select("doc_id", "node", "text", "fp_a").distinct().select("node", "text", "fp_a")
    members = scratch.save(_checked(some), "sets")
    sig = nodes.select("node", "sig")
    star = member.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    hubs = hot_keys(pivots.groupBy(F.col("pivot").alias("v")).agg(F.sum("n").alias("n")), ["v"])
    pairs = meet(star, sig.select(F.col("node").alias("v"), F.col("sig").alias("sv")), ["v"], hubs, ["u"]).join(sig.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
    pairs = pairs.mapInArrow(_alike(least), "u long, v long")
    a, b = members.select(F.col("node").alias("u"), F.col("members").alias("x")), members.select(F.col("node").alias("v"), F.col("members").alias("y"))
    both = meet(pairs, b, ["v"], hubs, ["u"]).join(a, "u").select("u", "v", "x", "y")
    first = scratch.save(both.mapInArrow(_confirm(percent), "u long, v long"), "links-1")
    comp = components(first, scratch, "comp-1")
    # step 2: buckets whose members, the pivot apart, are in several components
    rest = member.where("node <> pivot AND n > 2").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = scratch.save(rest.select(*bucket, "node", "component"), "rest")
    per = rest.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("c"))
    split = per.groupBy(*bucket).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "component")).alias("top")).where("parts > 1")
    blocks_ = lambda n: F.ceil(n / BLOCK).cast("int")
    split = scratch.save(split.select(*bucket, "n", F.col("top.component").alias("main"), blocks_(F.col("n") - F.col("top.c")).alias("nb"), blocks_(F.col("top.c")).alias("nm")), "split")
    open_ = meet(rest, split.drop("n"), bucket, hot_keys(split, bucket), ["node"])
    main, h = F.col("component") == F.col("main"), F.xxhash64("node")
    open_ = open_.withColumn("block", F.when(main, F.col("nb") + F.pmod(h, F.col("nm"))).otherwise(F.pmod(h, F.col("nb"))).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.when(main, F.col("nb")).otherwise(F.col("nb") + F.col("nm")) - 1))
    open_ = open_.join(sig, "node").join(members, "node").withColumn("other", partner).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    open_ = open_.select("band", "key", "one", "two", "node", "component", "block", "sig", "members")
    found = open_.repartition("band", "key", "one", "two").sortWithinPartitions("band", "key", "one", "two").mapInArrow(_agree(least, percent), "u long, v long")
    second = scratch.save(found, "links-2")
    comp = components(first.unionByName(second), scratch, "comp-2")
    known = scratch.save(nodes.select(*fp, "node", "rep", "copies").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    small = known.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(small, ["component"])
    copied = hot_keys(known.select("fp_a", "fp_b", F.col("copies").alias("n")), ["fp_a", "fp_b"])
    known = meet(known.select(*fp, "component"), small.drop("n"), ["component"], hot, ["fp_a"]).drop("component")
    out = meet(full.drop("sig"), known, fp, copied, ["doc_id"], on=["fp_a", "fp_b"])
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").drop("sig").withColumn("component_id", F.col("doc_id"))
    out = out.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *(("fp_a", "fp_b") if fingerprints else ()))


def _alike(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ["u", "v", "su", "sv"]
        for batch in batches:
            batch = batch.select(cols)
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x, np.uint32) for x in batch.column(k).to_pylist()]) for k in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(1) >= least))

    return run


def _checked(some: DataFrame) -> DataFrame:
    """(node, text, fp_a), distinct -> one (node, members) for each node; texts of another fingerprint, under a repeated id, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in blocks(batches):
            fp = s.column(2).to_pylist()
            got = [x.tobytes() if len(x) and int(np.sum(_mix(x)).view(np.int64)) == f else None for x, f in zip(sets(*raw(s.column(1))), fp, strict=True)]
            ok = pa.array([g is not None for g in got])
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(got, pa.binary())], ["node", "members"]).filter(ok)

    return some.mapInArrow(run, "node long, members binary")
