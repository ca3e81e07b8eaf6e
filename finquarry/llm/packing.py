"""Best-fit packing of tokenised documents by swap-based local search.

Documents become pieces of at most 2048 tokens. Pieces are dealt by hash to groups of bounded size. A group starts with
each piece in a bin of its own. Then bins give to others: a piece moves, or is exchanged one for one, or two for one, or
one for two. The receiver ends fuller than the donor was, so the sum of squared fills grows, until bins are empty; of all
steps of a donor the one that leaves a receiver fullest is taken, so a receiver is a best fit. Passes over all underfull
bins end when none gains. A group's emptiest bins go up a tree and are searched again with those of other groups.
"""

from __future__ import annotations

import os
import threading
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import drop_staged, stage

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "doc_id long, known boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, grp long"


class ChunkIds(dict):
    """Token ids by `tokenizers`, as little-endian bytes, of chunks with the space they begin with; forgets all beyond
    `most` chunks. Special tokens in a text, such as <|endoftext|>, are ids of their own, as the tokenizer does by itself."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.model, self.most, self.ends = Tokenizer.from_file(path), most, {}
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        vocab = self.model.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocab.items() if t[:1] == "\u0120"]] = True  # how the vocabulary writes a space

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, many at a time: a token that begins with a space begins a chunk. The tokenizer's own split
        parts letters from signs behind them, so a word is encoded once whatever follows it."""
        word_of, need = {}, {}
        for c in chunks:
            word = c.rstrip(punctuation)
            if len(word) < len(c) and word[1:].isalpha():
                word_of[c] = word
                if word not in self:
                    need[word] = None
            else:
                need[c] = None
        todo = list(need)
        groups = [todo[i : i + 256] for i in range(0, len(todo), 256)]
        for group, e in zip(groups, self.model.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = array("I", e.ids)
            cuts, ids = (4 * np.flatnonzero(self.begins[np.frombuffer(ids, dtype=np.uint32)])).tolist(), ids.tobytes()
            whole = len(cuts) == len(group)
            self.update(zip(group, (ids[x:y] for x, y in zip(cuts, [*cuts[1:], len(ids)], strict=True)) if whole else self.ids(group), strict=True))
        new = list({c[len(w) :] for c, w in word_of.items()} - self.ends.keys())
        self.ends.update(zip(new, self.ids(new), strict=True))
        self.update({c: self[w] + self.ends[c[len(w) :]] for c, w in word_of.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts. The tokenizer's own split never joins a space to what stands before it, so a text
        is cut before each lone space and equal chunks are encoded once; distinct ones of these texts are looked up. In
        texts with runs of spaces, what follows the first run stays whole, and so do texts with a special token."""
        if len(self) > self.most:
            self.clear()
            self.ends.clear()
        cuts = []
        for t in texts:
            at = t.find("  ")
            at = t.rfind(" ", 0, at) if at > 0 else len(t) if at < 0 else 0
            cuts.append(0 if any(x in t for x in self.special) else max(at, 0))
        parts = [t[:at].encode() for t, at in zip(texts, cuts, strict=True)]
        begins = np.cumsum([0, *map(len, parts)])
        joined = b"".join(parts)
        spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == ord(" "))
        heads = np.searchsorted(spaces, begins[:-1]) + np.arange(len(parts))  # what a text has before its first space
        edges = np.append(np.insert(spaces, heads - np.arange(len(parts)), begins[:-1]), begins[-1])
        chunks = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(joined)]).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.get, distinct))
        self.learn([c for c, x in zip(distinct, ids, strict=True) if x is None and c[:1] == " "])
        rest = [c for c in distinct if c[:1] != " "]
        begun = dict(zip(rest, self.ids(rest), strict=True))
        ids = [(self[c] if c[:1] == " " else begun[c]) if x is None else x for c, x in zip(distinct, ids, strict=True)]
        # Each chunk's stretch of the distinct ones' ids.
        code, known = chunks.indices.to_numpy(), np.frombuffer(b"".join(ids), dtype="<u4")
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        to = np.concatenate([[0], np.cumsum(size[code])])
        every = known[np.repeat((np.cumsum(size) - size)[code] - to[:-1], size[code]) + np.arange(to[-1])]
        bounds = np.append(to[heads], to[-1]).tolist()
        tails = iter(self.ids([t[at:] for t, at in zip(texts, cuts, strict=True) if at < len(t)]))
        return [every[x:y].tobytes() + (next(tails) if at < len(t) else b"") for x, y, t, at in zip(bounds, bounds[1:], texts, cuts, strict=False)]


_LOADED: dict[str, ChunkIds] = {}
_RESTING: list[threading.Timer] = []
#: A worker process keeps its chunks for this long after a task, so that one which idles through later stages holds none.
REST_SECONDS = 10.0


def _loaded(tokenizer: str) -> ChunkIds:
    while _RESTING:
        _RESTING.pop().cancel()
    if tokenizer not in _LOADED:
        _LOADED[tokenizer] = ChunkIds(tokenizer)
    return _LOADED[tokenizer]


def _rest() -> None:
    timer = threading.Timer(REST_SECONDS, _LOADED.clear)
    timer.daemon = True
    timer.start()
    _RESTING.append(timer)


def piece_documents(docs: DataFrame, tokenizer: str, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of each document's ids and a final id 0.

    A longer document is cut into pieces of `most` ids; its first piece takes the remainder. Null text: empty,
    so one piece of one id. Null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _loaded(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), chunks.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    first = n % most or most
                    for k, start in enumerate([0, *range(first, n, most)]):
                        stop = first if not start else start + most
                        rows.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        _rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def local_search(sizes: np.ndarray, bins: np.ndarray, room: int) -> np.ndarray:
    """Empty bins by moves and exchanges, all bins that are not full taking part. Bins are numbered anew.

    Donors come fullest first. A step gives d > 0 tokens to a bin that so gets fuller than the donor was, so the sum of
    squared fills grows by 2d(to + d - from) and the search ends. A donor goes on until it is empty or no step is left;
    a pass over all donors that gains nothing, or as few bins as the tokens need, ends the search.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // room)
    held: list[list[int]] = [[] for _ in fill]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    free_of = room - fill
    used, gained = int((fill > 0).sum()), True
    # Every item of an underfull bin can be exchanged for one of at most its own size plus the bin's free space.
    items = np.flatnonzero(free_of[bins] > 0)
    pairs = _pairs(bins, items)
    while gained and used > least:
        gained = False
        order = np.flatnonzero((fill > 0) & (fill < room))
        for donor in order[np.argsort(-fill[order], kind="stable")].tolist():
            steps = 0
            while 0 < fill[donor] < room and used > least:
                step = _step(sizes, held[donor], bins, items, pairs, free_of, donor)
                if step is None:
                    break
                give, take, to = step
                for i in give:
                    held[donor].remove(i)
                    held[to].append(i)
                    bins[i] = to
                for j in take:
                    held[to].remove(j)
                    held[donor].append(j)
                    bins[j] = donor
                d = int(sizes[list(give)].sum() - sizes[list(take)].sum())
                fill[to] += d
                fill[donor] -= d
                free_of[to], free_of[donor], steps = room - fill[to], room - fill[donor], steps + 1
            if not fill[donor]:
                free_of[donor], used = 0, used - 1
            gained |= steps > 0
            if steps:
                items = items[free_of[bins[items]] > 0]
            if used <= least:
                break
        items = np.flatnonzero(free_of[bins] > 0)
        pairs = _pairs(bins, items)
    return np.unique(bins, return_inverse=True)[1]


def _pairs(bins: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of items that share a bin."""
    order = items[np.argsort(bins[items], kind="stable")]
    a, b, step = [], [], 1
    while len(order) > step and (same := bins[order[step:]] == bins[order[:-step]]).any():
        a.append(order[:-step][same])
        b.append(order[step:][same])
        step += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (items[:0], items[:0])


def _step(sizes, own, bins, items, pairs, free_of, donor):
    """The step out of the donor that leaves a bin fullest, of these the one that gives most tokens: (given items, taken
    items, bin), or None. A piece moves, is exchanged for one or two of another bin, or two are for one."""
    none = int(free_of[donor])  # the receiver must end fuller than the donor was
    best = (none, 0, None)

    def better(left: np.ndarray, size: int, low) -> int | None:
        nonlocal best
        k = int(np.argmin(left))
        key = (int(left[k]), -(size - int(low[k]) if low is not None else size))
        if left[k] < best[0] or (left[k] == best[0] < none and key < best[:2]):
            best = (*key, None)
            return k
        return None

    own = sorted(own, key=lambda i: -sizes[i])
    ok = free_of > 0
    ok[donor] = False
    to_bins = np.flatnonzero(ok)
    if not len(to_bins):
        return None
    space = free_of[to_bins]
    for i in own:
        size = int(sizes[i])
        if (k := better(np.where(space >= size, space - size, none), size, None)) is not None:
            best = (*best[:2], ((i,), (), int(to_bins[k])))
            if not best[0]:
                return best[2]  # a full bin; exchanges would fill none better
    part = items[ok[bins[items]]]
    pa, pb = pairs
    both = (bins[pa] == bins[pb]) & ok[bins[pa]]
    pa, pb = pa[both], pb[both]
    low, low2 = sizes[part], sizes[pa] + sizes[pb]
    high, high2 = low + free_of[bins[part]], low2 + free_of[bins[pa]]
    for i in own:
        size = int(sizes[i])
        if (k := better(np.where((low < size) & (size <= high), high - size, none), size, low)) is not None:
            best = (*best[:2], ((i,), (int(part[k]),), int(bins[part[k]])))
        if len(pa) and (k := better(np.where((low2 < size) & (size <= high2), high2 - size, none), size, low2)) is not None:
            best = (*best[:2], ((i,), (int(pa[k]), int(pb[k])), int(bins[pa[k]])))
    for x in range(len(own)):
        for y in range(x + 1, len(own)):
            size = int(sizes[own[x]] + sizes[own[y]])
            if best[0] == 0 and -best[1] >= size:
                break
            if (k := better(np.where((low < size) & (size <= high), high - size, none), size, low)) is not None:
                best = (*best[:2], ((own[x], own[y]), (int(part[k]),), int(bins[part[k]])))
    return best[2]


def _packer(room: int, level: int, open_bins: int):
    return lambda pdf: _pack(pdf, room, level, open_bins)


def _pack(pdf: pd.DataFrame, room: int, level: int, open_bins: int) -> pd.DataFrame:
    mixed = np.bitwise_xor(pdf["ids_crc32"], pdf["start"] * 40503 + pdf["doc_id"] * 2654435761 % (1 << 32))
    pdf = pdf.assign(o0=mixed).sort_values(["o0", "doc_id", "known", "piece", "length", "ids_crc32"], kind="stable").drop(columns="o0").reset_index(drop=True)
    sizes = pdf["length"].to_numpy().astype(np.int64)
    bins = local_search(sizes, np.arange(len(sizes)), room)
    fill = np.bincount(bins, weights=sizes)
    least = np.argsort(fill, kind="stable")[:open_bins]
    is_open = np.zeros(len(fill), dtype=bool)
    is_open[least[fill[least] < room]] = True
    pdf["bin"] = bins
    pdf["offset"] = pdf.groupby("bin")["length"].cumsum() - pdf["length"]
    pdf["sequence_id"] = (np.int64(level) << 56) + (pdf["grp"].to_numpy().astype(np.int64) << 24) + bins
    return pdf.assign(open=is_open[bins])[["doc_id", "known", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open", "grp"]]


def pack_pieces(pieces: DataFrame, room: int = 2048, group_rows: int = 3_000, fan_in: int = 32, open_bins: int = 64) -> DataFrame:
    """Give each piece a sequence and an offset: (…, sequence_id, offset). Pieces hold 1..room tokens. Ids of any
    size stay exact beside null ones, which travel as a flag: pandas has no whole numbers with gaps.

    Equal pieces are packed like any others. No piece: no row. A task holds about group_rows pieces, or the
    pieces of fan_in * open_bins bins. open_bins bounds what goes up the tree, the emptiest bins of a group; the others
    are final as the search left them.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    dealt = dealt.withColumns({"known": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    level = stage(dealt.groupBy("grp").applyInPandas(_packer(room, 0, open_bins), _PLACED), "pack-level")
    out, k = level.filter(~F.col("open")), 0
    while groups > 1:
        groups, k = -(-groups // fan_in), k + 1
        again = level.filter("open").select("doc_id", "known", "piece", "start", "length", "ids_crc32", F.floor(F.col("grp") / fan_in).cast("long").alias("grp"))
        level = stage(again.groupBy("grp").applyInPandas(_packer(room, k, open_bins), _PLACED), "pack-level")
        out = out.unionByName(level.filter(~F.col("open")))
    out = out.unionByName(level.filter("open"))
    return out.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("open", "grp", "known")


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `room` tokens."""
    pieces = stage(piece_documents(docs, tokenizer, room), "pack-pieces")
    out = pack_pieces(pieces, room)
    drop_staged(pieces)
    return out
