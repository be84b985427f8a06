"""Embedding near-duplicates through hierarchical navigable small-world graphs.

Vectors with the same label are compared by cosine.  Equal vectors become one node first.  The nodes
of a label are dealt by hash into shards of at most ``SHARD`` nodes and ``SHARD_BYTES``; the task that
receives a shard builds its graph and leaves it in the shared folder.  Every node queries every shard of
its label: its own as the graph is built, the others by pairs of shards.  A task takes one shard and up to
``PARTNERS`` others, whose graphs it reads from the folder one after another; what is shuffled for it is
names of files, and its memory holds two graphs whatever a label's size.

A query is a beam search down the layers, then a walk along links for as long as it meets vectors
above the threshold or a little below it, so a group of near copies larger than the beam is still found
whole.  The beam of each shard is widened until an audit passes (``RECALL``, the mean over queries, for
members and for vectors moved away from members to a cosine just above the threshold, against brute
force); at the width of the shard, the search is exhaustive.  Cosines are verified in double precision.
A link that either end finds counts for both.  Links are united within a task, which names each pair of
united groups once; components come from alternating star steps.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, lean, meet, trim
from .components import components
from .token_output import _get, _put
from .topk import usable

SHARD, SHARD_BYTES, PARTNERS = 16384, 64 << 20, 8
LINKS, BUILD_BEAM, BEAM, RECALL, AUDITS, BATCH = 12, 48, 32, 0.99, 128, 512
#: A walk along links also goes through members that are so far below the threshold.
STEP = 0.02


def _dots(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(queries, w, d) and (queries, d) -> (queries, w) inner products."""
    return (v @ q[:, :, None])[:, :, 0]


class Graph:
    """x: unit vectors (n, d) in float64; layers[l]: (n, links) neighbours, -1 for none."""

    def __init__(self, x: np.ndarray, threshold: float, layers=None, entry: int = 0, beam: int = BEAM, order=None):
        self.x, self.f, self.threshold = x, x.astype(np.float32), threshold
        self.layers, self.entry, self.beam = layers or [], entry, beam
        if layers is None:
            self._build()

    # -- search -------------------------------------------------------------------------------

    def _beam(self, q: np.ndarray, layer: np.ndarray, start: np.ndarray, width: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query, best first; -1 for empty places."""
        n, (k, e) = len(q), start.shape
        ids = np.full((n, max(width, e)), -1, np.int64)
        ids[:, :e] = start
        sims = np.where(ids >= 0, _dots(self.f[ids], q), -3).astype(np.float32)
        seen = np.zeros((n, upto + 1), bool)  # the last column takes the empty places
        np.put_along_axis(seen, np.where(ids < 0, upto, ids), True, 1)
        open_ = ids >= 0
        while True:
            s = np.where(open_, sims, -3)
            take = min(4, s.shape[1])
            best = np.argpartition(-s, take - 1, axis=1)[:, :take]
            live = np.take_along_axis(s, best, 1) > -2.5
            a = np.flatnonzero(live.any(1))
            if not len(a):
                break
            best, live = best[a], live[a]
            here = open_[a]
            np.put_along_axis(here, best, False, 1)
            open_[a] = here
            nb = np.where(live[:, :, None], layer[np.take_along_axis(ids[a], best, 1)], -1).reshape(len(a), -1)
            nb = np.sort(nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[a[:, None], np.where(nb < 0, upto, nb)]] = -1
            seen[a[:, None], np.where(nb < 0, upto, nb)] = True
            most = int((nb >= 0).sum(1).max(initial=0))
            if not most:
                continue
            nb = -np.sort(-nb, axis=1)[:, :most]
            sn = np.where(nb >= 0, _dots(self.f[nb], q[a]), -3).astype(np.float32)
            ci, cs = np.concatenate([ids[a], nb], 1), np.concatenate([sims[a], sn], 1)
            co = np.concatenate([open_[a], nb >= 0], 1)
            keep = np.argpartition(-cs, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[a], sims[a], open_[a] = (np.take_along_axis(c, keep, 1) for c in (ci, cs, co))
        order = np.argsort(-sims, axis=1)[:, :width]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _descend(self, q: np.ndarray, width: int, upto: int, bottom: int = 0) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry, np.int64)
        for layer in self.layers[:bottom:-1]:
            at, _ = self._beam(q, layer, at, 4, upto)
        return self._beam(q, self.layers[bottom], at, width, upto)

    def links(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """For each query (unit vectors), the members at the threshold or above."""
        n, low = len(self.x), self.threshold - STEP
        for at in range(0, len(q), BATCH):
            qs = q[at : at + BATCH]
            qf = qs.astype(np.float32)
            if self.beam >= n:
                near = qf @ self.f.T >= self.threshold - 1e-5
                found = [np.flatnonzero(r) for r in near]
            else:
                ids, sims = self._descend(qf, self.beam, n)
                found = []
                for i in range(len(qs)):
                    got = ids[i][sims[i] >= low]
                    if len(got) > 1:  # else there is nowhere to walk
                        got = self._walk(qf[i], got, low)
                    found.append(got)
            for i, got in enumerate(found):
                yield np.sort(got[self.x[got] @ qs[i] >= self.threshold]) if len(got) else got

    def _walk(self, q: np.ndarray, got: np.ndarray, low: float) -> np.ndarray:
        seen = np.zeros(len(self.x) + 1, bool)
        seen[got] = True
        front, all_ = got, [got]
        while len(front):
            nb = np.unique(self.layers[0][front])
            nb = nb[(nb >= 0) & ~seen[nb]]
            seen[nb] = True
            front = nb[self.f[nb] @ q >= low] if len(nb) else nb
            all_.append(front)
        return np.concatenate(all_)

    # -- building -----------------------------------------------------------------------------

    def _choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours: first those nearer to the node than to any chosen before, then the nearest of the others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        n, k = ids.shape
        v = self.f[ids]
        cross = v @ v.transpose(0, 2, 1)
        chosen, count = np.zeros((n, k), bool), np.zeros(n, int)
        for c in range(k):
            near = np.where(chosen[:, :c], cross[:, c, :c], -3).max(1, initial=-3)
            ok = (ids[:, c] >= 0) & (near < sims[:, c]) & (count < most)
            chosen[:, c] = ok
            count += ok
        rank = np.where(ids < 0, 3 * k, np.where(chosen, 0, k) + np.arange(k))
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, keep, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _build(self) -> None:
        n = len(self.x)
        rng = np.random.default_rng(n)
        order = rng.permutation(n)
        level = np.minimum(6, (-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int))
        self.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int64) for k in range(int(level.max(initial=0)) + 1)]
        top, done = -1, 0
        while done < n:
            new = order[done : done + min(BATCH, max(64, done // 2))]
            for k in range(int(level[new].max()), -1, -1):
                own = new[level[new] >= k]
                parts_i, parts_s = [], []
                if done and top >= k:
                    at = np.full((len(own), 1), self.entry, np.int64)
                    for upper in range(top, k, -1):
                        at, _ = self._beam(self.f[own], self.layers[upper], at, 4, n)
                    i, s = self._beam(self.f[own], self.layers[k], at, BUILD_BEAM, n)
                    parts_i.append(i)
                    parts_s.append(s)
                s = self.f[own] @ self.f[own].T
                np.fill_diagonal(s, -3)
                m = min(len(own), BUILD_BEAM)
                j = np.argpartition(-s, m - 1, axis=1)[:, :m]
                s = np.take_along_axis(s, j, 1)
                parts_i.append(np.where(s > -2.5, own[j], -1))
                parts_s.append(s)
                ids, sims = np.concatenate(parts_i, 1), np.concatenate(parts_s, 1)
                self.layers[k][own, :LINKS] = self._choose(self.f[own], ids, sims, LINKS)
                self._back(k, own)
            best = int(level[new].max())
            if best > top:
                top = best
                self.entry = int(new[level[new].argmax()])
            done += len(new)

    def _back(self, k: int, own: np.ndarray) -> None:
        """Links back from the new nodes' neighbours; a full list is chosen anew."""
        layer = self.layers[k]
        width = layer.shape[1]
        src = np.repeat(own, LINKS)
        dst = layer[own, :LINKS].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, n = np.unique(dst, return_index=True, return_counts=True)
        by_size = np.argsort(n, kind="stable")
        at = 0
        while at < len(to):  # targets with about as many new links go together
            part = by_size[at : at + BATCH]
            part = part[n[part] <= max(width, 2 * n[part[0]])]
            at += len(part)
            place = np.arange(n[part].max())
            new = np.where(place < n[part][:, None], src[np.minimum(first[part][:, None] + place, len(src) - 1)], -1)
            have = layer[to[part]]
            new[(new[:, :, None] == have[:, None, :]).any(2)] = -1
            ids = np.concatenate([have, new], 1)
            over = (ids >= 0).sum(1) > width
            kept = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, :width]
            if over.any():
                sims = np.where(ids[over] >= 0, _dots(self.f[ids[over]], self.f[to[part][over]]), -3)
                kept[over] = self._choose(self.f[to[part][over]], ids[over], sims, width)
            layer[to[part]] = kept

    def audit(self) -> float:
        """Widens the beam until queries find what brute force finds; the last recall, the mean over the worse kind of queries."""
        n, d = self.x.shape
        rng = np.random.default_rng(n + d)
        pick = rng.permutation(n)[:AUDITS]
        away = rng.normal(size=(len(pick), d))
        away -= (away * self.x[pick]).sum(1, keepdims=True) * self.x[pick]
        away /= np.maximum(1e-12, np.linalg.norm(away, axis=1, keepdims=True))
        c = min(1.0, self.threshold + 0.002)
        moved = c * self.x[pick] + math.sqrt(max(0.0, 1 - c * c)) * away
        moved /= np.linalg.norm(moved, axis=1, keepdims=True)
        kinds = [(q, [np.flatnonzero(r) for r in q @ self.x.T >= self.threshold]) for q in (moved, self.x[pick])]
        while True:
            recall = 1.0
            for q, truth in kinds:
                got = [len(np.intersect1d(a, b)) / len(a) for a, b in zip(truth, self.links(q), strict=True) if len(a)]
                recall = min(recall, sum(got) / len(got) if got else 1.0)
            if recall >= RECALL or self.beam >= n:
                return recall
            self.beam *= 2

    def bits(self, q: np.ndarray) -> np.ndarray:
        """(queries, members / 8): a bit for each link."""
        out, row = [], np.zeros((BATCH, len(self.x)), bool)
        for k, got in enumerate(self.links(q)):
            row[k % BATCH, got] = True
            if k % BATCH == BATCH - 1:
                out.append(np.packbits(row, axis=1))
                row[:] = False
        out.append(np.packbits(row[: len(q) % BATCH], axis=1))
        return np.concatenate(out)

    def save(self, **more: np.ndarray) -> bytes:
        f = io.BytesIO()
        np.savez(f, x=self.x, scalars=np.array([self.threshold, self.entry, self.beam]), n_layers=len(self.layers), **{f"layer{k}": a.astype(np.int32) for k, a in enumerate(self.layers)}, **more)
        return f.getvalue()

    @staticmethod
    def load(data: bytes) -> tuple["Graph", dict[str, np.ndarray]]:
        z = np.load(io.BytesIO(data))
        threshold, entry, beam = z["scalars"]
        layers = [z[f"layer{k}"].astype(np.int64) for k in range(int(z["n_layers"]))]
        return Graph(z["x"], float(threshold), layers, int(entry), int(beam)), {c: z[c] for c in ("uids", "cnts", "links", "roots")}


def either(a: np.ndarray, b: np.ndarray, n: int, m: int, step: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of links found from both sides, as bits (n, m / 8) and (m, n / 8): runs of (first row, row, column) of the links that either found."""
    for at in range(0, n, step):
        rows = np.unpackbits(a[at : at + step], axis=1, count=m).astype(bool)
        back = np.unpackbits(b[:, at // 8 : (at + step) // 8], axis=1)[:, : len(rows)].astype(bool)
        r, c = np.nonzero(rows | back.T)
        yield at, r, c


def _unite(labels: np.ndarray, group: np.ndarray) -> None:
    """The members ``group`` and all that share a label with them get the smallest of their labels."""
    own = labels[group]
    if len(own) and (own != own[0]).any():
        own = np.unique(own)
        labels[np.isin(labels, own)] = own[0]


_MANIFEST = "grp string, shard long, n_shards long, name string, recall double"
_HIT = "uid long, n long, other long, recall double"


def _build(folder: str, threshold: float):
    """Rows (grp, shard, n_shards, uid, cnt, v) sorted by (grp, shard) to a graph file and a row for each shard."""

    def made(key: tuple, held: list) -> pa.RecordBatch:
        uid, cnt, v = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        x = v / np.linalg.norm(v, axis=1, keepdims=True)
        g = Graph(x, threshold)
        recall = g.audit()
        found, n = g.bits(x), len(x)
        links, labels = cnt - 1, np.arange(n)
        for at, r, c in either(found, found, n, n):
            apart = r + at != c
            r, c = r[apart], c[apart]
            links[at : at + 128] += np.bincount(r, cnt[c], min(128, n - at)).astype(np.int64)
            ends = np.searchsorted(r, np.arange(min(128, n - at) + 1))
            for k in np.flatnonzero(np.diff(ends)):
                _unite(labels, np.append(c[ends[k] : ends[k + 1]], at + k))
        name = uuid.uuid4().hex  # a task that runs again leaves another file and names that one
        _put(folder, name, [g.save(uids=uid, cnts=cnt, links=links, roots=uid[labels])])
        del g, found
        trim()
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key, name, recall), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], [c.split()[0] for c in _MANIFEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            uid, cnt = (batch.column(k).to_numpy() for k in (3, 4))
            col = batch.column(5)
            flat, ends = col.flatten().to_numpy(), col.offsets.to_numpy() - col.offsets[0].as_py()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[i] != key:
                    if held:
                        yield made(key, held)
                    key, held = keys[i], []
                held.append((uid[i:j].copy(), cnt[i:j].copy(), flat[ends[i] : ends[j]].reshape(j - i, -1).astype(float)))
        if held:
            yield made(key, held)

    return run


def _hits(uid=(), n=(), other=(), recall=None) -> pa.RecordBatch:
    k = len(uid)
    nothing = lambda t: pa.nulls(k, t)
    return pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(n, pa.int64()) if len(n) else pa.array(np.zeros(k, np.int64)), pa.array(other, pa.int64()) if len(other) else nothing(pa.int64()), nothing(pa.float64()) if recall is None else pa.array(np.full(k, recall))], ["uid", "n", "other", "recall"])


def _load(folder: str, name: str) -> tuple[Graph, dict[str, np.ndarray]]:
    return Graph.load(_get(folder, name, "u1").tobytes())


def _own(folder: str):
    """The links within each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, z = _load(folder, r["name"])
                yield _hits(z["uids"], z["links"], z["roots"], r["recall"])

    return run


def _cross(folder: str):
    """The links between a shard and each later one of ``partners``: counts for both sides, and a row for each pair of united groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                g, own = _load(folder, r["name"])
                n, mine = len(g.x), np.zeros(len(g.x), np.int64)
                for p in r["partners"]:
                    if p["shard"] <= r["shard"]:
                        continue
                    h, z = _load(folder, p["name"])
                    m, theirs, pairs = len(h.x), np.zeros(len(h.x), np.int64), set()
                    for at, i, j in either(h.bits(g.x), g.bits(h.x), n, m):
                        i = i + at
                        mine += np.bincount(i, z["cnts"][j], n).astype(np.int64)
                        theirs += np.bincount(j, own["cnts"][i], m).astype(np.int64)
                        if len(i):
                            pairs |= set(map(tuple, np.unique(np.stack([own["roots"][i], z["roots"][j]], 1), axis=0).tolist()))
                    some = theirs > 0
                    yield _hits(z["uids"][some], theirs[some])
                    if pairs:
                        u, v = zip(*sorted(pairs), strict=True)
                        yield _hits(u, other=v)
                    del h
                    trim()
                some = mine > 0
                yield _hits(own["uids"][some], mine[some])

    return run


def _ready(rows: DataFrame) -> DataFrame:
    """Adds grp (dimension and label; null for rows that link with nothing), v and its hash h.

    Vectors are scaled by their largest component, so that no square of a tiny or huge one leaves the range of doubles.
    """
    ok = F.col("label").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    df = rows.withColumn("m", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("ok", ok)
    df = df.withColumns({"grp": F.when(F.col("ok"), F.concat_ws(":", F.size("v").cast("string"), "label")), "v": F.when(F.col("ok"), F.transform("v", lambda x: x / F.col("m") + 0.0))})
    return df.drop("m", "ok").withColumn("h", F.xxhash64("grp", "v"))


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept, shard_recall.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing; vectors of different dimensions do not either.  Rows that repeat an id are vectors of their own;
    equal vectors are all linked with each other.  A null id counts as a vector but names no component: one of
    null ids alone has the component null, and such rows are kept.  An empty table gives no rows; other columns
    are not looked at.  ``shard_recall`` is what the audit of the vector's shard measured, null where there is none.
    """
    rows = lean(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    rows = _ready(rows).drop("label")
    nodes = rows.where("grp IS NOT NULL").groupBy("grp", "h", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt")).withColumn("uid", F.monotonically_increasing_id())
    nodes = scratch.save(nodes, "nodes")
    fit = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(SHARD_BYTES) / (12 * F.max(F.size("v")) + 8 * LINKS + 64))))
    counts = scratch.save(nodes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / fit).cast("long").alias("n_shards")), "counts")
    n = counts.agg(F.sum("n_shards")).first()[0] or 0
    # the counts of groups are repeated for each of 32 salts, so a hot label's rows meet them in 32 tasks
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    dealt = nodes.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(32)).cast("int")).join(salted, ["grp", "salt"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(17), "uid"), F.col("n_shards"))).select("grp", "shard", "n_shards", "uid", "cnt", "v")
    folder = scratch.path("graphs")
    # four tasks for each shard while there are few, so that hashing seldom deals two of them to one
    dealt = dealt.repartition(int(max(1, min(n, 100_000), min(4 * n, 2_000))), "grp", "shard").sortWithinPartitions("grp", "shard", "uid")
    built = scratch.save(dealt.mapInArrow(_build(folder, threshold), _MANIFEST), "built")
    own = built.select("name", "recall").repartition(int(max(1, min(n, 1_000)))).mapInArrow(_own(folder), _HIT)
    several = built.where("n_shards > 1").withColumn("block", F.floor(F.col("shard") / PARTNERS))
    partners = several.groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("shard", "name"))).alias("partners"), F.max("shard").alias("last"))
    tasks = scratch.save(several.select("grp", "shard", "name").join(partners.drop("block"), "grp").where("shard < last").select("shard", "name", "partners"), "tasks")
    k = tasks.count()
    hits = scratch.save(own.unionByName(tasks.repartition(int(max(1, min(k, 100_000)))).mapInArrow(_cross(folder), _HIT)), "hits")
    comp = components(hits.where("other IS NOT NULL").select(F.col("uid").alias("u"), F.col("other").alias("v")).distinct(), scratch)
    per = hits.groupBy("uid").agg(F.sum("n").alias("n_links"), F.max("recall").alias("shard_recall")).join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    known = scratch.save(nodes.select("uid", "h", "rep", "cnt").join(per, "uid"), "known")
    first = known.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = meet(known, first.drop("n"), ["component"], hot_keys(first, ["component"]), ["uid"])
    known = nodes.select("uid", "grp", "v").join(known, "uid").select("h", "grp", "v", "n_links", "component_id", "shard_recall")
    hot = hot_keys(nodes.select("h", F.col("cnt").alias("n")), ["h"])
    out = meet(rows.where("grp IS NOT NULL"), known, ["h", "grp", "v"], hot, ["vec_id"], on=["h"])
    rest = rows.where("grp IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("double").alias("shard_recall"))
    out = out.select("vec_id", "n_links", "component_id", "shard_recall").unionByName(rest)
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"), "shard_recall")
