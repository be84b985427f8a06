"""Pairs that share an uncapped bucket, without a shuffle of pairs.

The targets are numbered in the order of their ids and every uncapped bucket is written once to the shared folder,
as the sorted numbers of its members.  Only keys are joined with buckets; a record's buckets then meet in one row, and
a task adds up their members in an array with a place for each target.  Tasks hold the index for one range of targets
at a time, so their memory doesn't grow with the tables; a pair lies in one range, so it is found whole in one place.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import Evidence
from ..functions.similarity import EXTRA, edits_of_many
from ..sources.scratch import kept

#: Targets of a range; with some 70 keys each, its index takes about 40 MB.
RANGE = 1 << 17
#: Pairs that a task hands over at once.
_ROWS = 1 << 16
#: Candidates of the records whose names are compared at once.
_HELD = 1 << 21
#: Places of a name's counts: of its characters, then of its pairs of characters, by their codes.
_ONES, _TWOS = 64, 256
#: Above the rounding of similarities (8 places) and scores (6 places).
_SLACK = 1e-5
_OVER = "_smart_overflow"
_COLUMNS = {"source1_id": "string", "target_source": "string", "target_id": "string", "strategy": "string", "hits": "long", "edits": "long"}
_LAST: dict[tuple, "_Index"] = {}


class _Index:
    """The members of each bucket within one range of targets, and the targets' ids."""

    def __init__(self, targets: str, buckets: str, firsts: dict[int, int], low: int, high: int):
        parts = [(b.column(0).to_numpy(), b.column(1), b.column(2)) for b in _batches(targets, ["no", "target_source", "target_id"])]
        at = [np.array([firsts[p] for p in (no >> 33).tolist()], np.int64) + (no & ((1 << 33) - 1)) for no, _, _ in parts]
        within = [(a >= low) & (a < high) for a in at]
        order = np.argsort(np.concatenate([a[w] for a, w in zip(at, within, strict=True)]))
        self.source, self.id = (pa.concat_arrays([p[c].filter(pa.array(w)) for p, w in zip(parts, within, strict=True)]).take(pa.array(order)) for c in (1, 2))
        del parts, at
        ids, sizes, values = [], [], []
        for b in _batches(buckets, ["bucket", "members"]):
            ends, flat = b.column(1).offsets.to_numpy().astype(np.int64), b.column(1).values.to_numpy()
            keep = (flat >= low) & (flat < high)
            upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep, dtype=np.int64)])
            n = np.diff(upto[ends])
            ids.append(b.column(0).to_numpy()[n > 0])
            sizes.append(n[n > 0])
            keep[: ends[0]] = keep[ends[-1] :] = False
            values.append((flat[keep] - low).astype(np.int32))
        none = np.zeros(0, np.int64)
        ids, sizes = np.concatenate([none, *ids]), np.concatenate([none, *sizes])
        starts, order = np.cumsum(sizes) - sizes, np.argsort(ids)
        self.bucket, self.start, self.size = ids[order], starts[order], sizes[order]
        self.members = np.concatenate([np.zeros(0, np.int32), *values])
        self.low, self.n = low, len(self.id)
        self._looks: tuple[str, _Looks] | None = None
        self._names: tuple[str, Evidence] | None = None
        # targets of different sources may have the same id
        self.again = np.zeros(self.n, bool)
        if self.n > 1:
            self.again[1:] = pc.equal(self.id[1:], self.id[:-1]).to_numpy(zero_copy_only=False)

    def looks(self, path: str) -> _Looks:
        if self._looks is None or self._looks[0] != path:
            self._looks = path, _Looks(path, self.low, self.n)
        return self._looks[1]

    def names(self, path: str) -> Evidence:
        if self._names is None or self._names[0] != path:
            names = [""] * self.n
            for b in _batches(path, ["no", "name"]):
                for no, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if 0 <= no - self.low < self.n:
                        names[no - self.low] = name
            self._names = path, Evidence(names)
        return self._names[1]

    def find(self, buckets: np.ndarray) -> np.ndarray:
        """Places of the buckets, -1 where none of their members is here."""
        if not len(self.bucket):
            return np.full(len(buckets), -1)
        at = np.minimum(np.searchsorted(self.bucket, buckets), len(self.bucket) - 1)
        return np.where(self.bucket[at] == buckets, at, -1)

    def gather(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *[self.members[s : s + k] for s, k in zip(self.start[at].tolist(), self.size[at].tolist(), strict=True)]])


def _counts(names: list[str]) -> np.ndarray:
    """Of each name, how often each character and each pair of characters occurs, by hashed codes; more than 30,000 is 30,000."""
    out = np.empty((len(names), _ONES + _TWOS), np.int16)
    for k in range(0, len(names), 2048):
        part = names[k : k + 2048]
        code = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        one = np.bincount(row * _ONES + code % _ONES, minlength=len(part) * _ONES).reshape(len(part), _ONES)
        same = row[1:] == row[:-1]
        two = np.bincount((row[1:] * _TWOS + (code[1:] * 31 + code[:-1]) % _TWOS)[same], minlength=len(part) * _TWOS).reshape(len(part), _TWOS)
        out[k : k + 2048] = np.minimum(np.concatenate([one, two], axis=1), 30_000)
    return out


class _Looks:
    """The streets' words and the names of one range of targets, and what bounds their scores against a record."""

    def __init__(self, path: str, low: int, n: int):
        parts = [(b.column(0).to_numpy(), b.column(1), b.column(2)) for b in _batches(path, ["no", "name", "words"])]
        within = [(no >= low) & (no < low + n) for no, _, _ in parts]
        at = np.concatenate([np.zeros(0, np.int64), *[no[w] - low for (no, _, _), w in zip(parts, within, strict=True)]]).astype(np.int64)
        self.length, self.words = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.counts = np.zeros((n, _ONES + _TWOS), np.int16)
        names = [x for p, w in zip(parts, within, strict=True) for x in p[1].filter(pa.array(w)).to_pylist()]
        self.counts[at], self.length[at] = _counts(names), [len(x) for x in names]
        codes = {x: k for k, x in enumerate(dict.fromkeys(names))}
        self.names, self.name = list(codes), np.zeros(n, np.int64)
        self.name[at] = [codes[x] for x in names]
        self.known: dict[tuple[str, int], int] = {}
        words = [p[2].filter(pa.array(w)) for p, w in zip(parts, within, strict=True)]
        sizes = np.concatenate([np.zeros(0, np.int64), *[pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in words]]).astype(np.int64)
        self.words[at] = sizes
        flat = np.concatenate([np.zeros(0, np.int64), *[pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in words]]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.holder = np.repeat(at, sizes)[order].astype(np.int32)
        self.word, start = np.unique(flat[order], return_index=True)
        self.start = np.append(start, len(flat))

    def edits(self, asked: list[tuple[str, np.ndarray]]) -> list[np.ndarray]:
        """Of each name the distances to the names with the codes, each pair of names once."""
        if len(self.known) > 100_000:
            self.known.clear()
        each = [(name, *np.unique(codes, return_inverse=True)) for name, codes in asked]
        new = list(dict.fromkeys((name, c) for name, one, _ in each for c in one.tolist() if (name, c) not in self.known))
        self.known.update(zip(new, edits_of_many([(name, self.names[c]) for name, c in new]), strict=True))
        return [np.array([self.known[name, c] for c in one.tolist()], np.int64)[place] for name, one, place in each]

    def at_once(self, each: list) -> list:
        """The results of ``_most`` or ``_top`` for many records; the distances that they ask for are computed together."""
        out, asked = [None] * len(each), {}

        def step(k: int, got: np.ndarray | None) -> None:
            try:
                asked[k] = each[k].send(got)
            except StopIteration as end:
                out[k] = end.value

        for k in range(len(each)):
            step(k, None)
        while asked:
            now, asked = asked, {}
            for k, d in zip(now, self.edits(list(now.values())), strict=True):
                step(k, d)
        return out

    def most(self, *own) -> tuple[np.ndarray, np.ndarray]:
        return self.at_once([self._most(*own)])[0]

    def top(self, *own) -> tuple[np.ndarray, np.ndarray]:
        return self.at_once([self._top(*own)])[0]

    def _most(self, got: np.ndarray, name: str, words: np.ndarray, least: float, held: np.ndarray | None = None) -> Generator:
        """Those of the targets ``got`` whose score against the record may be ``least``, and their names' distances; none is left out that reaches it.

        The words' shared share is counted (one more than it is where hashes meet).  An edit changes one character and
        two pairs at most, so differences of the counts bound the names' similarity from above.
        """
        both = (self._both(words) if held is None else held)[got]
        if 2 * least - _SLACK > 1:
            got, both = got[both > 0], both[both > 0]
        need = 2 * least - _SLACK - both / np.maximum(self.words[got] + len(words) - both, 1)
        ok = need <= 1
        got, need = got[ok], need[ok]
        length = np.maximum(self.length[got], len(name))
        # a name without characters resembles none
        full = (self.length[got] > 0) & (len(name) > 0)
        ok = (need <= 0) | full & (length - np.abs(self.length[got] - len(name)) >= need * length)
        got, need, length = got[ok], need[ok], length[ok]
        own = _counts([name])[0]
        for some, each in ((slice(0, _ONES), 1), (slice(_ONES, None), 2)):
            d = self.counts[got, some] - own[some]
            bound = np.maximum(np.maximum(d, 0).sum(axis=1, dtype=np.int64), np.maximum(-d, 0).sum(axis=1, dtype=np.int64)) / each
            ok = length - bound >= need * length
            got, need, length = got[ok], need[ok], length[ok]
        d = (yield name, self.name[got]) if len(got) else got
        ok = length - d >= need * length
        return got[ok], d[ok]

    def _both(self, words: np.ndarray) -> np.ndarray:
        """How many of the words each target has."""
        held = [np.zeros(0, np.int32)]
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
            held += [self.holder[self.start[k] : self.start[k + 1]] for k in at[self.word[at] == words].tolist()]
        return np.bincount(np.concatenate(held), minlength=len(self.length))

    def _top(self, got: np.ndarray, name: str, words: np.ndarray, least: float, margin: float, start: float, alone: bool = True) -> Generator:
        """As ``_most``, and of a record whose best score is under ``least`` but reaches ``start``, the best pair and those found within ``margin`` of it.

        If there are any but the best, one at least is found: candidates are looked at by falling bounds, until none of
        the others can come within the margin of the best, or, when one has, none can be best by more than the margin.
        Unless this is the only range (``alone``), the best one is looked for in that case too, as it may be second to
        that of another range.
        """
        both = self._both(words)
        sure, d_sure = yield from self._most(got, name, words, least, both)

        def scores(t: np.ndarray, alike: np.ndarray) -> np.ndarray:
            full = (self.length[t] > 0) & (len(name) > 0)
            return (both[t] / np.maximum(self.words[t] + len(words) - both[t], 1) + np.where(full, alike, 0.0)) / 2

        def bound(t: np.ndarray, some: slice, each: int) -> np.ndarray:
            length = np.maximum(np.maximum(self.length[t], len(name)), 1)
            e = self.counts[t, some] - own[some]
            return scores(t, 1 - np.maximum(np.maximum(e, 0).sum(axis=1, dtype=np.int64), np.maximum(-e, 0).sum(axis=1, dtype=np.int64)) / each / length)

        def found(t: np.ndarray, d: np.ndarray) -> np.ndarray:
            return scores(t, 1 - d / np.maximum(np.maximum(self.length[t], len(name)), 1))

        s = found(sure, d_sure)
        if len(s) and s.max() >= least + _SLACK:
            return sure, d_sure
        # what is under the start may come within the margin of the best
        own, least_of_all = _counts([name])[0], start - margin - 2 * _SLACK
        rest = np.setdiff1d(got, sure, assume_unique=True)
        high = bound(rest, slice(0, _ONES), 1)
        rest, high = rest[high >= least_of_all], high[high >= least_of_all]
        order = np.argsort(-high, kind="stable")
        rest, high, at, step = rest[order], high[order], 0, 16
        # the limit also falls: those that were under it are looked at later
        aside, low = rest[:0], high[:0]
        t, d = sure, d_sure
        while True:
            best, limit = np.sort(s)[-2:][::-1], start - _SLACK
            if len(best) and best[0] >= start - _SLACK:
                dead = len(best) > 1 and best[0] - best[1] < margin - _SLACK
                limit = best[0] + (margin if alone else 0) - _SLACK if dead else best[0] - margin - _SLACK
            end = min(at + step, int(np.searchsorted(-high, -limit, side="right")))
            if end > at:
                more, at, step = rest[at:end], end, 2 * step
                tight = bound(more, slice(_ONES, None), 2)
                aside, low = np.concatenate([aside, more[tight < limit]]), np.concatenate([low, tight[tight < limit]])
                more = more[tight >= limit]
            elif (low >= limit).any():
                more = aside[low >= limit]
                aside, low = aside[low < limit], low[low < limit]
            else:
                break
            d_more = (yield name, self.name[more]) if len(more) else more
            t, d, s = np.concatenate([t, more]), np.concatenate([d, d_more]), np.concatenate([s, found(more, d_more)])
        keep = np.zeros(len(t), bool)
        keep[: len(sure)] = True
        if len(s) and s.max() >= start - _SLACK:
            keep |= s >= s.max() - margin - _SLACK
        order = np.argsort(t[keep], kind="stable")
        return t[keep][order], d[keep][order]


def _batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path if ":" in path else "file://" + path)
    data = ds.dataset(at, format="parquet", filesystem=fs)
    yield from data.to_batches(columns=columns, batch_size=1 << 15, batch_readahead=1, fragment_readahead=1, use_threads=False)


def _joined(rows, columns: list[str], make) -> Iterator[pa.RecordBatch]:
    """Batches of many records' pairs: source1_id, target_source, target_id as asked for, all else from ``make`` (column, rows held)."""

    def batch(held: list) -> pa.RecordBatch:
        ix = held[0][0]
        got = pa.array(np.concatenate([r[3] for r in held]))
        made = []
        for c in columns:
            if c == "source1_id":
                one = pa.array([r[1].column(0)[r[2]].as_py() for r in held], pa.string())
                made.append(one.take(pa.array(np.repeat(np.arange(len(held)), [len(r[3]) for r in held]))))
            else:
                made.append(ix.source.take(got) if c == "target_source" else ix.id.take(got) if c == "target_id" else make(c, held))
        return pa.RecordBatch.from_arrays(made, columns)

    held, total = [], 0
    for r in rows:
        if held and (held[0][0] is not r[0] or total + len(r[3]) > _ROWS):
            yield batch(held)
            held, total = [], 0
        held.append(r)
        total += len(r[3])
    if held:
        yield batch(held)


def _index(*key) -> _Index:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = _Index(*key[:2], dict(key[2]), *key[3:])
    return _LAST[key]


def _folder(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0]


class Probe:
    """The index of ``targets`` and the buckets of each record of ``s1``, both written; tables of pairs are made from them."""

    def __init__(self, own: DataFrame, posts: DataFrame, cap: int, strategies: tuple[str, ...], overflowing: tuple[str, ...], specific: tuple[str, ...], capped: DataFrame | None = None):
        """``own`` (source1_id, ordinal, strategy, key), ``posts`` (target_source, target_id, strategy, key).

        A capped bucket of an ``overflowing`` strategy is searched through the record's ``specific`` ones.  ``capped``
        (strategy, key) stands in for the buckets of more than ``cap`` targets.
        """
        self.spark = own.sparkSession
        self.names = (*strategies, *(s + _OVER for s in strategies))
        self.specific = [k for k, s in enumerate(strategies) if s in specific]
        key = ["strategy", "key"]
        posts = kept(posts.distinct(), "postings")
        ids = posts.select("target_source", "target_id").distinct().orderBy("target_id", "target_source")
        self.targets = kept(ids.withColumn("no", F.monotonically_increasing_id()), "targets")
        counted = sorted((r["p"], r["n"]) for r in self.targets.groupBy(F.shiftright("no", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        self.firsts, self.n = {}, 0
        for p, n in counted:
            self.firsts[p], self.n = self.n, self.n + n
        if capped is None:
            capped = posts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
        capped = kept(capped.select(*key), "capped")
        members = posts.join(F.broadcast(capped), key, "left_anti").join(self._numbers(), ["target_source", "target_id"])
        members = members.groupBy(*key).agg(F.sort_array(F.collect_list("no")).alias("members"))
        self.buckets = kept(members.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
        code = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(strategies) for x in (s, k)]), F.col("strategy")).alias("code")
        found = own.join(self.buckets.select(*key, "bucket"), key).select("source1_id", "ordinal", code, "bucket")
        if specific:
            full = own.where(F.col("strategy").isin(*overflowing)).join(F.broadcast(capped), key).select("source1_id", "ordinal", code, F.lit(-1).cast("long").alias("bucket"))
            found = found.unionByName(full)
        self.lists = kept(found.groupBy("source1_id").agg(F.collect_list(F.struct("ordinal", "code", "bucket")).alias("keys")), "lists")

    def _numbers(self) -> DataFrame:
        """(target_source, target_id, no), gapless in the order of ids."""
        first = F.create_map(*[F.lit(x) for p, n in self.firsts.items() for x in (p, n)]) if self.firsts else F.lit(None).cast("map<int,int>")
        part = F.shiftright("no", 33).cast("int")
        return self.targets.select("target_source", "target_id", (F.element_at(first, part) + F.col("no").bitwiseAND((1 << 33) - 1)).cast("int").alias("no"))

    def _run(self, made, schema: str, wanted: DataFrame | None = None, every: DataFrame | None = None, like: tuple[DataFrame, DataFrame, float] | None = None, names: DataFrame | None = None, best: tuple[float, float] | None = None, tasks: int = 2) -> DataFrame:
        """``made`` turns rows (index, batch of records, row in it, targets, their first strategies, their hits) into batches.

        Records without targets are left out unless ``every``, all records with their ids in front, is given.
        """
        rows, ranges = self.lists, max(1, -(-self.n // RANGE))
        if every is not None:
            rows = every.join(rows, "source1_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast(rows.schema["keys"].dataType)))
        whole = every is not None
        row = F.col("row_seq") if whole else F.lit(0)
        if wanted is not None:
            w = wanted.select("source1_id", "target_source", "target_id").distinct().join(self._numbers(), ["target_source", "target_id"])
            rows = rows.join(w.groupBy("source1_id").agg(F.collect_list("no").alias("wanted")), "source1_id")
        else:
            rows = rows.withColumn("wanted", F.lit(None).cast("array<int>"))
        looks, least = "", 0.0
        if like is not None:
            words = F.transform(F.array_distinct("street_tokens"), lambda w: F.xxhash64(w)).alias("words")
            name = F.coalesce("name_core", F.lit("")).alias("name")
            own = like[0].where("entity_id IS NOT NULL").select(F.col("entity_id").alias("source1_id"), name, words)
            rows, least = rows.join(own, "source1_id"), like[2]
            theirs = like[1].select(F.col("source").alias("target_source"), F.col("entity_id").alias("target_id"), name, words)
            looks = _folder(kept(theirs.join(self._numbers(), ["target_source", "target_id"]).select("no", "name", "words"), "looks"))
        elif names is not None:
            rows = rows.join(names.select(F.col("source1_id"), F.col("name")), "source1_id").withColumn("words", F.lit(None).cast("array<long>"))
        else:
            rows = rows.withColumns({"name": F.lit(None).cast("string"), "words": F.lit(None).cast("array<long>")})
        if ranges > 1:
            rows = rows.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).withColumn("task", F.col("range") * 16 + F.pmod(F.xxhash64("source1_id"), F.lit(16)).cast("int"))
            # a task holds the index of one range alone, and loads it once
            rows = rows.repartitionById(16 * ranges, "task")
        else:
            rows = rows.repartition(max(16, tasks * self.spark.sparkContext.defaultParallelism)).withColumn("range", F.lit(0))
        where = (_folder(self.targets), _folder(self.buckets), tuple(self.firsts.items()))
        # the best pair of a range may be second to that of another one
        rescue = None if best is None else (best[1], best[0] - best[1] * (ranges > 1), ranges == 1)
        specific, n_names, only, size = self.specific, len(self.names) // 2, wanted is not None, RANGE

        def of(batches: Iterator[pa.RecordBatch]):
            if not looks:
                yield from each(batches)
                return
            held, total = [], 0
            for r in each(batches):
                if held and (held[0][0] is not r[0] or total + len(r[3]) > _HELD):
                    yield from alike(held)
                    held, total = [], 0
                # what is kept of a record's candidates until those of many are compared
                held.append((*r[:3], r[3].astype(np.int32), r[4], r[5].astype(np.int32)))
                total += len(r[3])
            if held:
                yield from alike(held)

        def alike(held: list):
            index = held[0][0].looks(looks)
            search = (lambda *own: index._top(*own, *rescue)) if rescue else index._most
            own = [search(got, b.column(5)[k].as_py(), np.array(b.column(6)[k].as_py(), np.int64), least) for _, b, k, got, *_ in held]
            for (ix, b, k, got, first, n), (some, d) in zip(held, index.at_once(own), strict=True):
                if len(some):
                    at = np.searchsorted(got, some)
                    yield ix, b, k, some, first[at], n[at], d

        def each(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                col, ends = b.column(1), b.column(1).offsets.to_numpy()
                ordinal, code, bucket = (x.to_numpy(zero_copy_only=False) for x in col.values.flatten())
                ranges, ids = b.column(3).to_numpy(zero_copy_only=False), b.column(0)
                for k in range(b.num_rows):
                    at = slice(ends[k], ends[k + 1])
                    low = int(ranges[k]) * size
                    ix = _index(*where, low, low + size)
                    o, c, place = ordinal[at], code[at], ix.find(bucket[at])
                    direct = place >= 0
                    seq = np.argsort(-o[direct], kind="stable")
                    o_d, c_d, p_d = o[direct][seq], c[direct][seq], place[direct][seq]
                    hit = ix.gather(p_d)
                    n = np.bincount(hit, minlength=ix.n)
                    first = np.empty(ix.n, np.int32)
                    capped = bucket[at] < 0
                    seen = n
                    if capped.any() and ids[k].is_valid and (spec := np.isin(c_d, specific)).any():
                        # of a record's capped keys the first one counts, and all specific keys search for it
                        j = np.flatnonzero(capped)[o[capped].argmin()]
                        more = ix.gather(p_d[spec])
                        seen = n.copy()
                        seen[more] += 1
                        # the last value put in a place stays, so keys go from the last to the first
                        later = int((o_d > o[j]).sum())
                        sizes = ix.size[p_d]
                        cut = int(sizes[:later].sum())
                        codes = np.repeat(c_d, sizes)
                        first[hit[:cut]] = codes[:cut]
                        first[more] = c[j] + n_names
                        first[hit[cut:]] = codes[cut:]
                    else:
                        first[hit] = np.repeat(c_d, ix.size[p_d])
                    if only:
                        w = np.array(b.column(2)[k].as_py(), np.int64) - low
                        w = np.sort(w[(w >= 0) & (w < ix.n)])
                        got = w[seen[w] > 0]
                    else:
                        got = np.flatnonzero(seen > 0)
                    if len(got) or whole:
                        yield ix, b, k, got, first[got], n[got], None

        return rows.select("source1_id", "keys", "wanted", "range", row.cast("long").alias("row_seq"), "name", "words").mapInArrow(lambda batches: made(of(batches)), schema)

    def pairs(self, columns: list[str] | None = None, wanted: DataFrame | None = None, like: tuple[DataFrame, DataFrame, float] | None = None, best: tuple[float, float] | None = None) -> DataFrame:
        """A row for each pair, or for each pair that is also in ``wanted`` (source1_id, target_source, target_id).

        ``like`` (normalised records, normalised targets, least) leaves out pairs for which the mean of
        name_edit_similarity and address_token_jaccard cannot be ``least``; who asks compares the scores of the others.
        With it, the column ``edits`` may be asked for: Levenshtein's distance of the names.  Both sides have one row
        for each id.  With ``best`` (rescue, margin), of a record without a score of ``least`` there is also the best pair,
        if it scores ``rescue``, and another one within the margin of it, if there is any; two equally good ones count as such.
        """
        columns, names = columns or [c for c in _COLUMNS if c != "edits"], pa.array(self.names)

        def made(rows):
            make = {"strategy": lambda held: names.take(pa.array(np.concatenate([r[4] for r in held]))), "hits": lambda held: pa.array(np.concatenate([r[5] for r in held]).astype(np.int64)), "edits": lambda held: pa.array(np.concatenate([r[6] for r in held]))}
            return _joined(rows, columns, lambda c, held: make[c](held))

        return self._run(made, ", ".join(f"{c} {_COLUMNS[c]}" for c in columns), wanted, like=like, best=best)

    def evidence(self, names: DataFrame) -> DataFrame:
        """The evidence features of each pair (``similarity.EXTRA``) from the records' ``names`` (entity_id, n); a missing name is empty.

        A task holds the words of one range's names and compares a record's words with each of them once.
        """
        of = lambda ids, c: ids.join(names.select(F.col("entity_id").alias("_id"), "n"), F.trim(c) == F.col("_id"), "left").withColumn("name", F.coalesce("n", F.lit("")))
        own = kept(of(self.lists.select("source1_id").where("source1_id IS NOT NULL"), "source1_id").select("source1_id", "name"), "own_names")
        path = _folder(kept(of(self._numbers(), "target_id").select("no", "name"), "names"))

        def made(rows):
            def each():
                for ix, b, k, got, *_ in rows:
                    yield ix, b, k, got, ix.names(path).of(b.column(5)[k].as_py(), got)

            return _joined(each(), columns, lambda c, held: pa.array(np.concatenate([r[4][EXTRA.index(c)] for r in held])))

        columns = ["source1_id", "target_source", "target_id", *EXTRA]
        return self._run(made, ", ".join(f"{c} {_COLUMNS.get(c, 'double')}" for c in columns), names=own, tasks=8)

    def counts(self) -> DataFrame:
        """(source1_id, strategy, n): the pairs of each record by their first strategy, added up for each record and range."""
        names = self.names

        def made(rows):
            for _, b, k, _, code, *_ in rows:
                c, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(c), pa.string()), pa.array([names[x] for x in c.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["source1_id", "strategy", "n"])

        return self._run(made, "source1_id string, strategy string, n long")

    def lists_of_ids(self, s1: DataFrame) -> DataFrame:
        """The rows of ``s1`` (source1_id, row_seq) with ``ids``: distinct target ids, sorted and joined by commas."""

        def made(rows):
            for ix, b, k, got, *_ in rows:
                repeated = ix.again[got]
                # an id may be there before under another source that is no candidate
                repeated[1:] &= got[1:] - 1 == got[:-1]
                repeated[:1] = False
                flat = ix.id.take(pa.array(got[~repeated]))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), ",")
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], b.column(4)[k : k + 1], pa.array([ix.low], pa.int64()), text], ["source1_id", "row_seq", "low", "ids"])

        d = self._run(made, "source1_id string, row_seq long, low long, ids string", every=s1.select("source1_id", "row_seq"))
        if self.n <= RANGE:
            return d.select("source1_id", "row_seq", "ids")
        parts = F.transform(F.sort_array(F.collect_list(F.struct("low", "ids"))), lambda p: p["ids"])
        # an id of two sources may end one range and begin the next
        ids = F.array_distinct(F.split(F.array_join(F.filter(parts, lambda x: x != ""), ","), ","))
        return d.groupBy("source1_id", "row_seq").agg(F.array_join(ids, ",").alias("ids"))
