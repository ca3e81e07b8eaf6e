"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact.

1. Each document becomes its set of distinct word n-grams (64-bit hashes). Equal sets fall together.
2. Sets whose Jaccard similarity reaches num/den differ in few elements. So if the hash range is cut into more parts
   than they can differ in, the two agree on whole parts. Every set emits a key for each part; sets that share a key
   are candidates. There are more parts than needed, so parts that say little, with few n-grams besides very
   frequent ones, need no key: as many of them as there are parts to spare, the emptiest first. Keys are paired inside
   a task first and only one of each goes on, so a key that very many documents share costs one row a task; no key's
   group is expanded into pairs.
3. Candidates' components are the cells. Inside a cell, T-occurrence search finds the links: each set looks for
   earlier sets that hold at least T of its n-grams, merging the short inverted lists with a heap and probing the
   long ones by binary search. Sets already connected need no further link. Cells beyond a bound are cut into
   blocks, and every two blocks of a cell meet apart from the others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, fresh, mix64, salted, sized, stage, stream_groups, utf8, words
from finquarry.llm.components import UnionFind, connected_components

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_hash = xxhash.xxh3_64_intdigest


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams, A-Z lowered; shorter texts are one n-gram, empty ones none."""
    ws = words(text.lower())  # bytes.lower() changes A-Z only
    if not ws:
        return np.array([], dtype=np.uint64)
    h = np.fromiter(map(_hash, ws), dtype=np.uint64, count=len(ws))
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix64(out * _A + h[i : len(h) - k + 1 + i])
    out = np.sort(mix64(out + np.uint64(k)))
    return out if len(out) < 2 else out[np.concatenate([[True], out[1:] != out[:-1]])]


class Threshold:
    """What a Jaccard similarity of num/den asks of sizes and overlaps, in whole numbers."""

    def __init__(self, num: int, den: int, growth: float = 1.5):
        self.num, self.den = num, den
        self.ladder = [1]
        while self.ladder[-1] < 1 << 40:
            self.ladder.append(max(self.ladder[-1] + 1, math.ceil(self.ladder[-1] * growth)))
        self._ladder = np.array(self.ladder)

    def overlap(self, a: int, b: int) -> int:
        """The smallest intersection of sets of a and b elements with that similarity."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, a: int, b: int) -> int:
        """The most elements that only one of two linked sets of a and b elements has."""
        return (a + b) * (self.den - self.num) // (self.num + self.den)

    def level(self, b: int) -> int:
        """Rung whose parts outnumber, with some to spare, what a set of b and one no larger can differ in."""
        most = self.differ(b, b)
        return int(np.searchsorted(self._ladder, most + 2 + most // 8 if most else 1))

    def rungs(self, a: int) -> list[tuple[int, int]]:
        """(parts, parts to spare) under which a set of a elements meets every set that it may be linked to."""
        out, top = [], a * self.den // self.num
        for k in range(self.level(a), self.level(top) + 1):
            low, high = a, top
            while low < high:  # the largest partner on this rung
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.level(mid) <= k else (low, mid - 1)
            out.append((self.ladder[k], self.ladder[k] - 1 - self.differ(a, low)))
        return out


@lru_cache(512)
def _bounds(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)


def part_keys(s: np.ndarray, parts: int, spare: int, rare: np.ndarray, least: int) -> np.ndarray:
    """Keys of the parts of the hash range: equal where two sets agree on the whole part.

    rare: which elements are not very frequent. At most `spare` parts get no key: those with fewer rare elements than a
    bound, which is `least`, or the highest lower one that leaves out no more. Empty parts, on which all small sets
    agree, go first. Of the more than `spare` parts that two linked sets agree on, the set with the higher bound keeps
    one at least, and the other set, with a lower bound and the same elements there, keeps it too.
    """
    at = np.concatenate([[0], np.searchsorted(s, _bounds(parts)), [len(s)]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s), dtype=np.uint64)])
    own = mix64((sums[at[1:]] - sums[at[:-1]]) ^ mix64(np.arange(parts, dtype=np.uint64) * _B + np.uint64(parts)))
    seen = np.concatenate([[0], np.cumsum(rare)])
    held = seen[at[1:]] - seen[at[:-1]]
    return own[held >= min(least, int(np.partition(held, spare)[spare]))]


#: Shingles are counted by this many ranges of their hash, so that very frequent ones are known.
BUCKETS, CHUNK = 1 << 18, 1 << 12


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def frequent(counts: DataFrame, documents: int) -> np.ndarray:
    """Hash ranges that hold far more than their share of all sets' n-grams: over twice the mean, plus one in a
    thousand documents. counts: (chunk, counts binary) of every task, added up by chunk."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, dtype=np.int64) for b in pdf["counts"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [total.tobytes()]})

    seen = np.zeros(BUCKETS, dtype=np.int64)
    for r in counts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():  # BUCKETS numbers in all
        seen[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, dtype=np.int64)
    return seen > 2 * seen.mean() + documents / 1000


def t_occurrence_links(ids: list[int], sets: list[np.ndarray], t: Threshold, side: np.ndarray | None = None, mu: float = 0.0085) -> list[tuple[int, int]]:
    """Spanning links (id, id) among sets with the similarity. side: if given, only sets of unlike sides are compared.

    Lists are probed instead of merged (DivideSkip) for the L longest, L = T / (mu * log2(longest) + 1).
    """
    order = sorted((i for i in range(len(ids)) if len(sets[i])), key=lambda i: (len(sets[i]), ids[i]))
    if len(order) < 2:
        return []
    size = np.array([len(sets[i]) for i in order])
    token, where = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), size)
    uniq, inverse = np.unique(token, return_inverse=True)
    posting = np.sort(inverse.astype(np.int64) * len(order) + where)  # inverted lists, one after the other
    start = np.searchsorted(posting, np.arange(len(uniq) + 1) * len(order))
    length, n = np.diff(start), len(order)
    docs = posting % n
    begin = np.concatenate([[0], np.cumsum(size)])
    links, uf = [], UnionFind(n)
    for q in range(1, n):
        least = -(-t.num * int(size[q]) // t.den)
        low = int(np.searchsorted(size[:q], least))
        if low == q:
            continue
        need = t.overlap(int(size[q]), int(size[low]))
        own = inverse[begin[q] : begin[q + 1]]
        own = own[np.argsort(length[own], kind="stable")]
        skip = max(0, min(need - 1, int(need / (mu * math.log2(max(2, int(length[own[-1]]))) + 1))))
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        lists = []
        for k in short[length[short] > 1].tolist():
            part = docs[start[k] : start[k + 1]]
            a, b = np.searchsorted(part, (low, q))
            if b > a:
                lists.append(part[a:b].tolist())
        long_keys = long.astype(np.int64) * n
        last, count = -1, 0
        for c in [*heapq.merge(*lists), n]:
            if c == last:
                count += 1
                continue
            if last >= 0 and count >= need - skip and (side is None or side[order[last]] != side[order[q]]) and uf.find(last) != uf.find(q):
                goal = t.overlap(int(size[q]), int(size[last]))
                at = np.searchsorted(posting, long_keys + last)
                count += int((posting[np.minimum(at, len(posting) - 1)] == long_keys + last).sum())
                if count >= goal:
                    uf.union(last, q)
                    links.append((ids[order[q]], ids[order[last]]))
            last, count = c, 1
    return links


def _emit_keys(n: int, t: Threshold, hot: np.ndarray, least: int, most: int = 1_000_000):
    """Rows (key, doc, null): the first document of each key in a stretch of documents; (any key, doc, other):
    documents that met inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held, rungs = [], [], 0, lru_cache(10_000)(t.rungs)

        def out():
            k = np.concatenate(keys)
            d = np.repeat(np.array([i for i, _ in ids], dtype=np.int64), [m for _, m in ids])
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            first = np.concatenate([[True], k[1:] != k[:-1]])
            met = _to_first(d, first)
            yield pa.RecordBatch.from_arrays([pa.array(k[first].view(np.int64)), pa.array(d[first]), pa.nulls(int(first.sum()), pa.int64())], ["key", "doc", "other"])
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(mix64(np.ascontiguousarray(met[:, 0]).view(np.uint64)).view(np.int64)), pa.array(np.ascontiguousarray(met[:, 0])), pa.array(np.ascontiguousarray(met[:, 1]))], ["key", "doc", "other"])
            keys.clear(), ids.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                s = shingles(text, n)
                if not len(s):
                    continue
                rare = ~hot[_bucket(s)]
                new = [part_keys(s, parts, spare, rare, least if parts > 2 else 0) for parts, spare in rungs(len(s))]
                m = sum(map(len, new))
                keys.extend(new), ids.append((doc, m))
                held += m
                if held > most:
                    yield from out()
                    held = 0
        if keys:
            yield from out()

    return run


def _sets(n: int):
    """Each document's set size and digest; last, the task's counts by hash range, in chunks (size -1 - chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros(BUCKETS, dtype=np.int64), ["doc_id", "n_shingles", "h1", "h2", "counts"]
        for batch in batches:
            rows, buckets = [], []
            for text in utf8(batch.column(1)):
                s = shingles(text, n)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((len(s), (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
                buckets.append(_bucket(s))
                if len(buckets) == 1000:
                    seen += np.bincount(np.concatenate(buckets), minlength=BUCKETS)
                    buckets = []
            seen += np.bincount(np.concatenate([*buckets, np.zeros(0, np.int64)]), minlength=BUCKETS)
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(len(rows), pa.binary())], names)
        m = BUCKETS // CHUNK
        chunks = [seen[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in range(m)]
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(range(-1, -1 - m, -1), pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(chunks, pa.binary())], names)

    return run


def _search(n: int, t: Threshold):
    """One cell block after the other: the links inside it. i = j: one block; else two, compared across."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, i, j), g in stream_groups(frames, ["cell", "i", "j"]):
            sets = [shingles(x.encode(), n) for x in g["text"]]
            links = t_occurrence_links(g["doc_id"].tolist(), sets, t, g["block"].to_numpy() if i != j else None)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def ngram_join(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, block_rows: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row.

    Two documents are linked when their sets' intersection is at least num/den of their union; component_id is the
    smallest doc_id reached by links. Null or empty texts and texts without words have an empty set and no link;
    texts of fewer than n words are one n-gram. Rows with equal ids are one node; a null id is linked with nothing
    and has a null component. Hashes of 64 bits stand for n-grams, of 128 bits for whole sets.
    """
    t = Threshold(num, den)
    least = 3 if 10 * num >= 9 * den else 2  # parts get smaller with the threshold
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = stage(docs.mapInArrow(_sets(n), "doc_id long, n_shingles long, h1 long, h2 long, counts binary"), "join-sets")
    rows = seen.filter("n_shingles >= 0").drop("counts")
    hot = frequent(seen.filter("n_shingles < 0").select((-1 - F.col("n_shingles")).cast("int").alias("chunk"), "counts"), rows.count())
    usable = rows.filter("doc_id is not null and n_shingles > 0")
    first = usable.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).filter("rep < top").drop("top")
    copies = stage(salted(usable, first, ["n_shingles", "h1", "h2"], ["doc_id"], 64).filter("doc_id > rep").select("doc_id", "rep").distinct(), "join-copies")

    emitted = docs.filter("doc_id is not null").mapInArrow(_emit_keys(n, t, hot, least), "key long, doc long, other long")
    paired = emitted.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_pair, "a long, b long")
    met = stage(paired.distinct(), "join-met")
    cells = connected_components(met)
    cells = cells.join(copies.select(F.col("doc_id").alias("node")), "node", "left_anti")
    cells = stage(cells.withColumnRenamed("component", "cell"), "join-cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    members = stage(cells.join(sizes, "cell").select(F.col("node").alias("doc_id"), "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "join-members")

    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    there = docs.join(sized(members, 48), "doc_id").withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grid = there.select("doc_id", "text", "cell", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    # A set number of partitions: cells cost by their pairs, not by their bytes, so small ones must not be put together.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    found = grid.repartition(tasks, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "doc_id").mapInPandas(_search(n, t), "a long, b long")
    links = stage(found.union(copies.select("doc_id", "rep")), "join-links")
    component = stage(connected_components(links), "join-component").withColumnRenamed("node", "doc_id")
    drop_staged(copies, met, cells, members, links)
    return rows.join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _to_first(d: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs of each document with the first of its run: stars, whose components settle in few rounds."""
    head = d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))]
    return np.unique(np.stack([d[d != head], head[d != head]], axis=1), axis=0)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, doc, other): ready pairs as they are, and each doc with the first one of its key."""
    key_now = doc_first = None
    for batch in batches:
        key, doc, other = batch.columns
        ready = other.is_valid().to_numpy(zero_copy_only=False)
        d, o = doc.to_numpy(), other.fill_null(0).to_numpy(zero_copy_only=False)
        pairs = [np.stack([d[ready], o[ready]], axis=1)]
        k, d = key.to_numpy()[~ready], d[~ready]
        if len(k):
            if key_now == k[0]:
                k, d = np.append(k[:1], k), np.append(np.int64(doc_first), d)
            first = np.concatenate([[True], k[1:] != k[:-1]])
            pairs.append(_to_first(d, first))
            key_now, doc_first = k[-1], d[np.flatnonzero(first)[-1]]
        if len(p := np.unique(np.concatenate(pairs), axis=0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], ["a", "b"])


def one_of_each_group(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their component, with all columns; rows of equal ids stay together.
    Rows with a null id stay."""
    j = ngram_join(docs, n, num, den, id_col=id_col, text_col=text_col)
    name = fresh(docs.columns, "_gone")
    gone = stage(j.filter("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct(), "join-gone")
    return docs.join(sized(gone, 24), F.col(id_col) == F.col(name), "left_anti")
