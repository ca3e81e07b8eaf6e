"""Phrase collocations, counted in counting quotient filters.

A word's hash has 64 bits and is checked to be different for every word of the table. Its id is the place of the hash among
those of the frequent words, sent out as a sorted array, or the hash itself where that array would be too large. An
n-gram is its packed ids. An invertible permutation of just these bits gives a quotient and a full remainder, so a filter
holds exact counts in little room. Each task keeps filters of bounded size, writes them out by quotient as sorted
blocks, and the blocks of a quotient are merged as sorted runs.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finquarry.llm.common import joined, mix64, salted, stage, utf8

#: Fixed value: signs that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text that are cut into words at a time; different words, and n-grams, that a task holds before it writes.
CHUNK, WORDS, GRAMS = 2 << 20, 1 << 19, 1 << 21
#: n-grams that a quotient is meant for, and the largest sieve in bits. Fuller sieves let more through, no less.
QUOTIENT, SIEVE_BITS = 1 << 20, 27
#: Frequent words whose hashes are sent to tasks, 8 bytes each; with more, ids are the hashes.
DICTIONARY = 1 << 22
#: Bytes that a row takes in a broadcast table beside its words: two copies of the key's columns, their heads, the index.
ROW = 136
#: Odd multipliers of the permutation.
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLE = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK, _NONE = 0, 1  # ids of words begin at 2


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    """Texts in lower case with breaks as newlines, joined and cut at newlines into chunks; a piece is never cut."""
    held, size = [], 0
    for text in texts:
        text, at = text.translate(_TABLE), 0
        while at < len(text) or not text:
            end = len(text) if len(text) - at <= CHUNK else text.find(b"\n", at + CHUNK)
            end = len(text) if end < 0 else end
            held.append(text[at:end])
            size += end - at
            if size >= CHUNK:
                yield b"\n".join(held)
                held, size = [], 0
            at = end + 1
            if not text:
                break
    if held:
        yield b"\n".join(held)


def word_id(word: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


class Ids(dict):
    """Ids of words, made on demand and forgotten when there are many. With a dictionary, the sorted hashes of the words
    that matter, other words are breaks."""

    def __init__(self, seed: int, dictionary: np.ndarray | None):
        super().__init__()
        self.seed, self.dictionary = seed, dictionary
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[b"\n"], self[b""] = _BREAK, _NONE

    def __missing__(self, word: bytes) -> int:
        found = word_id(word, self.seed)
        if self.dictionary is not None:
            at = int(np.searchsorted(self.dictionary, np.uint64(found)))
            found = at + 2 if at < len(self.dictionary) and int(self.dictionary[at]) == found else _BREAK
        self[word] = found
        return found

    def of(self, chunk: bytes) -> np.ndarray:
        """Ids of a chunk's words in order, 0 between pieces."""
        if len(self) > WORDS:
            self.clear()
        found = chunk.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        return ids[ids != _NONE]


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for b in batches:
        parts = defaultdict(list)
        for lang, text in zip(b.column("lang").to_pylist(), utf8(b.column("text")), strict=True):
            parts[lang].append(text)
        yield from parts.items()


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, f) over (lang, text); task-local counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.binary()), "f": pa.array(list(c.values()), pa.int64())})
            held.clear()

        for lang, texts in by_lang(batches):
            for chunk in chunks(texts):
                held[lang].update(chunk.split())
                if sum(map(len, held.values())) > WORDS:
                    yield from out()
        yield from out()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.fromiter((word_id(w, seed) for w in b.column("word").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids.view(np.int64))], names=[*b.schema.names, "id"])

    counts = docs.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counts.mapInArrow(named, "lang string, word binary, f long, id long")


class Packing:
    """n ids of `width` bits in as few 64-bit columns as hold them whole, the first one permuted: it is hashed with the
    others and scrambled within its own bits, a bijection that unpack() undoes."""

    def __init__(self, n: int, width: int, bits: int):
        per = max(1, 64 // width)
        self.parts = [range(a, min(n, a + per)) for a in range(0, n, per)]
        self.n, self.width, self.sizes = n, width, [len(p) * width for p in self.parts]
        self.first = self.sizes[0]
        self.quotient_bits = min(bits, self.first)
        self.mask, self.shift = np.uint64((1 << self.first) - 1), np.uint64((self.first + 1) // 2)
        self.back = [np.uint64(pow(m, -1, 1 << 64)) for m in ODD]
        self.bytes = [-(-(size - (self.quotient_bits if k == 0 else 0)) // 8) for k, size in enumerate(self.sizes)]

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        cols = []
        for part in self.parts:
            c = ids[part[0]]
            for k in part[1:]:
                c = c << np.uint64(self.width) | ids[k]
            cols.append(c)
        x = cols[0] ^ (fold(cols[1:]) & self.mask) if len(cols) > 1 else cols[0]
        for m in ODD:
            x = (x * np.uint64(m)) & self.mask
            x = x ^ (x >> self.shift)
        return [x, *cols[1:]]

    def unpack(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        x = cols[0]
        for m in reversed(self.back):
            x = x ^ (x >> self.shift)
            x = (x * m) & self.mask
        cols = [x ^ (fold(cols[1:]) & self.mask) if len(cols) > 1 else x, *cols[1:]]
        one = np.uint64((1 << self.width) - 1)
        return [c >> np.uint64(self.width * (len(p) - 1 - k)) & one if len(p) > 1 else c for c, p in zip(cols, self.parts, strict=True) for k in range(len(p))]

    def quotients(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(self.first - self.quotient_bits)).astype(np.int64) if self.quotient_bits else np.zeros(len(first), np.int64)

    def to_block(self, cols: list[np.ndarray], counts: np.ndarray) -> tuple[bytes, bytes]:
        """Remainders in whole bytes, and counters of one byte, longer ones behind them."""
        low = cols[0] & np.uint64((1 << (self.first - self.quotient_bits)) - 1)
        kept = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :size] for c, size in zip([low, *cols[1:]], self.bytes, strict=True)]
        return np.hstack(kept).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()

    def from_block(self, rest: bytes, counters: bytes, entries: int, quotient: int) -> tuple[list[np.ndarray], np.ndarray]:
        rows, at, cols = np.frombuffer(rest, np.uint8).reshape(entries, sum(self.bytes)), 0, []
        for size in self.bytes:
            whole = np.zeros((entries, 8), np.uint8)
            whole[:, :size] = rows[:, at : at + size]
            cols.append(whole.view(np.uint64).ravel())
            at += size
        if self.quotient_bits:
            cols[0] = cols[0] | np.uint64(quotient << (self.first - self.quotient_bits))
        counts = np.frombuffer(counters, np.uint8, entries).astype(np.int64)
        counts[counts == 255] = np.frombuffer(counters, np.int64, offset=entries)
        return cols, counts


def fold(cols: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.uint64(0)
    for c in cols:
        out = mix64(c ^ out)
    return out


def collapse(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal entries added up, in ascending order. Runs that are sorted already are merged."""
    if not len(counts):
        return cols, counts
    order = np.argsort(cols[0], kind="stable")
    cols = [c[order] for c in cols]
    same = [c[1:] == c[:-1] for c in cols]
    if len(cols) > 1 and (same[0] & ~np.logical_and.reduce(same[1:])).any():  # entries that share their first column
        at = np.lexsort(cols[::-1])
        cols, order = [c[at] for c in cols], order[at]
        same = [c[1:] == c[:-1] for c in cols]
    starts = np.flatnonzero(np.r_[True, ~np.logical_and.reduce(same)])
    return [c[starts] for c in cols], np.add.reduceat(counts[order], starts)


class Filter:
    """A task's n-grams of one language and length, counted; flush() gives its blocks by quotient."""

    def __init__(self, packing: Packing):
        self.packing = packing
        self.parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, cols: list[np.ndarray], counts: np.ndarray) -> None:
        self.parts.append((cols, counts))
        self.size += len(counts)

    def settle(self) -> int:
        """Add equal entries up; the number of different ones."""
        if len(self.parts) > 1 or self.size:
            cols, counts = collapse([np.concatenate(c) for c in zip(*(p[0] for p in self.parts), strict=True)], np.concatenate([p[1] for p in self.parts]))
            self.parts, self.size = [(cols, counts)], len(counts)
        return self.size

    def flush(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(quotient, entries, remainders, counters); the filter is empty then."""
        if self.settle():
            cols, counts = self.parts[0]
            quotient = self.packing.quotients(cols[0])
            starts = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(counts)], strict=True):
                yield int(quotient[a]), int(b - a), *self.packing.to_block([c[a:b] for c in cols], counts[a:b])
        self.parts, self.size = [], 0


_BLOCKS = "lang string, n int, quotient long, entries int, rest binary, counters binary"


def gram_blocks(docs: DataFrame, seed: int, lengths: range, width: int, dictionary, sieve, bits: int) -> DataFrame:
    """Blocks of the n-grams of the given lengths whose parts the sieve lets through: words for length 2 (all words that a
    dictionary knows), else pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cells, held = Ids(seed, dictionary and dictionary.value), sieve and sieve.value, {}
        packings = {n: Packing(n, width, bits) for n in lengths}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, n), f in held.items():
                rows = [(lang, n, *block) for block in f.flush()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "n", "quotient", "entries", "rest", "counters"])

        for lang, texts in by_lang(batches):
            salt = np.uint64(word_id(lang.encode(), seed))
            for chunk in chunks(texts):
                w = ids.of(chunk)
                pair = (w[:-1] != _BREAK) & (w[1:] != _BREAK)
                if lengths.start > 2:
                    at = np.flatnonzero(pair)
                    pair[at] = passes(cells, fold([w[at], w[at + 1]]), salt)
                elif cells is not None:
                    known = passes(cells, fold([w]), salt)
                    pair &= known[:-1] & known[1:]
                starts = pair
                for n in range(2, lengths.stop):
                    if n > 2:
                        starts = starts[:-1] & pair[n - 2 :] if len(starts) > 1 else starts[:0]
                    at = np.flatnonzero(starts) if n in lengths else ()
                    if len(at):
                        held.setdefault((lang, n), Filter(packings[n])).add(packings[n].pack([w[at + k] for k in range(n)]), np.ones(len(at), np.int64))
                if sum(f.size for f in held.values()) > GRAMS and sum(f.settle() for f in held.values()) > GRAMS // 2:
                    yield from out()
        yield from out()

    return docs.mapInArrow(run, _BLOCKS)


def merge_blocks(blocks: DataFrame, width: int, dictionary, bits: int, least: int, longest: int) -> DataFrame:
    """(lang, n, w1.., f) of the n-grams that all blocks together hold at least `least` times; w: the words' hashes. The
    blocks of a quotient stream by; what is held is its different n-grams, few by the choice of bits, and a bounded
    number of blocks."""
    words = [f"w{k + 1}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hashes = None, None, dictionary and dictionary.value

        def out() -> Iterator[pa.RecordBatch]:
            if held is not None and held.settle():
                cols, counts = held.parts[0]
                keep = counts >= least
                ids = held.packing.unpack([c[keep] for c in cols])
                ids = ids if hashes is None else [hashes[(c - np.uint64(2)).astype(np.int64)] for c in ids]
                m = len(ids[0])
                ids += [np.zeros(m, np.uint64)] * (longest - len(ids))
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m, pa.string()), pa.array([key[1]] * m, pa.int32()), *(pa.array(c.view(np.int64)) for c in ids), pa.array(counts[keep])], names=["lang", "n", *words, "f"])

        for b in batches:
            for lang, n, q, entries, rest, counters in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (lang, n, q) != key:
                    yield from out()
                    key, held = (lang, n, q), Filter(Packing(n, width, bits))
                held.add(*held.packing.from_block(rest, counters, entries, q))
                if len(held.parts) > 64 or held.size > GRAMS:
                    held.settle()
        yield from out()

    dealt = blocks.repartition("lang", "n", "quotient").sortWithinPartitions("lang", "n", "quotient")
    return dealt.mapInArrow(run, f"lang string, n int, {', '.join(f'{w} long' for w in words)}, f long")


def passes(cells: np.ndarray, hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    at = _spot(hashes, salt, len(cells))
    return (cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _spot(hashes: np.ndarray, salt: np.uint64, cells: int) -> np.ndarray:
    return mix64(hashes ^ salt) >> np.uint64(64 - 6 - (cells.bit_length() - 1))


def sieve_of(frequent: DataFrame, cols: list[str], seed: int, dictionary):
    """A broadcast bitmap of the rows' (lang, words): 16 bits a row up to 2**27, so at most 16 MB. It may let others
    through but stops none of the rows; exact counts decide later."""
    rows = frequent.count()
    cells = 1 << max(4, min(SIEVE_BITS, math.ceil(math.log2(16 * max(1, rows)))) - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = dictionary and dictionary.value
        for b in batches:
            ids = [b.column(c).to_numpy().view(np.uint64) for c in cols]
            ids = ids if hashes is None else [np.searchsorted(hashes, c).astype(np.uint64) + np.uint64(2) for c in ids]
            langs = b.column("lang").to_pylist()
            salts = {x: word_id(x.encode(), seed) for x in set(langs)}
            at = _spot(fold(ids), np.array([salts[x] for x in langs], np.uint64), cells)
            yield pa.RecordBatch.from_pydict({"cell": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    found = frequent.select("lang", *cols).mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most a row a cell
    out = np.zeros(cells, np.uint64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def dictionary_of(common: DataFrame):
    """The hashes of the frequent words in order, broadcast; None if there are more than DICTIONARY of them."""
    hashes = common.select("id").distinct()
    n = hashes.count()
    if n > DICTIONARY:
        return None, 64
    found = hashes.toArrow().column("id").to_numpy().view(np.uint64)  # at most 8 * DICTIONARY bytes
    return common.sparkSession.sparkContext.broadcast(np.sort(found)), max(2, (n + 1).bit_length())


def frequent_grams(docs: DataFrame, words: DataFrame, seed: int, least: int, longest: int) -> DataFrame:
    """(lang, n, w1.., f) of all n-grams of 1 to `longest` words that occur at least `least` times; w: the words' hashes.
    Parts of a frequent n-gram are frequent, so pairs are counted between frequent words and longer ones inside runs of
    frequent pairs."""
    total = words.agg(F.sum("f")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / QUOTIENT))))
    names = [f"w{k + 1}" for k in range(longest)]
    common = words.filter(F.col("f") >= least)
    dictionary, width = dictionary_of(common)
    out = common.select("lang", F.lit(1).alias("n"), F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in names[1:]], "f")
    if longest > 1:
        sieve = None if dictionary else sieve_of(common, ["id"], seed, None)
        pairs = stage(merge_blocks(gram_blocks(docs, seed, range(2, 3), width, dictionary, sieve, bits), width, dictionary, bits, least, longest), "pairs")
        out = out.unionByName(pairs)
    if longest > 2:
        sieve = sieve_of(pairs, ["w1", "w2"], seed, dictionary)
        out = out.unionByName(merge_blocks(gram_blocks(docs, seed, range(3, longest + 1), width, dictionary, sieve, bits), width, dictionary, bits, least, longest))
    return out


def counted_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The words' table and a seed for which no two of its words share a hash and none has the ids of breaks. Words of one
    hash are compared by a second one."""
    for seed in range(8):
        words = stage(word_counts(docs, seed), "words")
        second = F.xxhash64("word")
        twice = words.groupBy("id").agg((F.min(second) != F.max(second)).alias("twice")).filter("twice or id in (0, 1)")
        if twice.isEmpty():
            return words, seed
    raise RuntimeError("no seed tells all words apart")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, share: int = 80, top: int = 2000) -> DataFrame:
    """Each language's best phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages `und`. Text is lower-cased (A-Z) and cut at `[.,;:!?]` and line ends into pieces,
    these at blanks and tabs into words. Phrases need `least` occurrences; l and r count the two parts of the cut with the
    lowest score, the first of equal ones; score is floor(2,000,000 a / (l + r)). A phrase inside a longer one that has
    `share` percent of its occurrences or more goes, whether that one stays or not. The `top` best are returned, by score
    and a, descending, then the phrase's bytes; n counts the language's words. Repeated rows count each time; empty
    tables give none.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, seed = counted_words(docs)
    names = [f"w{k + 1}" for k in range(longest)]
    grams = stage(frequent_grams(docs, words, seed, least, longest), "grams")
    phrases = grams.filter("n > 1").withColumnRenamed("f", "a")
    n_grams, width = grams.count(), ROW + 16 * longest

    def part(lo: int, hi: int) -> list:
        """Words lo to hi, exclusive, as the columns of a gram."""
        return [F.col(names[lo + k]) if lo + k < hi else F.lit(0).cast("long") for k in range(longest)]

    keys = ["lang", *names]
    shorter = F.array(*[F.when(F.col("n") == n, F.array(*[F.struct(*[c.alias(w) for c, w in zip(part(a, a + m), names, strict=True)]) for m in range(2, n) for a in range(n - m + 1)])) for n in range(3, longest + 1)]) if longest > 2 else None
    if shorter is not None:
        inside = phrases.filter("n > 2").select("lang", "a", F.explode(F.flatten(F.filter(shorter, lambda x: x.isNotNull()))).alias("s"))
        inside = inside.groupBy("lang", *[F.col(f"s.{w}").alias(w) for w in names]).agg(F.max("a").alias("longer"))
        kept = joined(phrases, inside, keys, n_grams * width, "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(20,0)") < F.lit(share).cast("decimal(3,0)") * F.col("a").cast("decimal(20,0)"))).drop("longer")
    else:
        kept = phrases

    cuts = F.array(*[F.when(F.col("n") > k, F.struct(F.lit(k).alias("k"), *[c.alias(f"l{w}") for c, w in zip(part(0, k), names, strict=True)], *[_tail(k, names, j).alias(f"r{w}") for j, w in enumerate(names)])) for k in range(1, longest)])
    cut = kept.select("lang", "n", "a", *names, F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias("c")).select("lang", "n", "a", *names, "c.*")
    counts = grams.select("lang", *names, "f")
    for side in ("l", "r"):  # hot words are parts of very many phrases, so the look-up is dealt out
        cut = salted(cut, counts.select("lang", *[F.col(w).alias(side + w) for w in names], F.col("f").alias(side)), ["lang", *[side + w for w in names]], names, width, rows=n_grams)
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = cut.withColumn("score", score).groupBy("lang", "n", "a", *names).agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "n", "a", *names, "best.*")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stage(scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place", "n", "k"), "best")
    used = first.select("lang", F.explode(F.array(*names)).alias("id")).distinct()
    named = stage(joined(words.filter(F.col("f") >= least), used, ["lang", "id"], used.count() * ROW, "left_semi").select("lang", "id", "word"), "best-words")
    n_named, letters = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    for w in names:
        column = named.select("lang", F.col("id").alias(w), F.col("word").alias(f"{w}_word"))
        first = salted(first, column, ["lang", w], [x for x in names if x != w] or names, ROW + 16 + letters // max(1, n_named), "left", rows=n_named)
    first = first.withColumn("phrase", F.concat_ws(" ", *[F.col(f"{w}_word").cast("string") for w in names]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = first.withColumn("rank", rank).filter(F.col("rank") <= top)
    sums = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return joined(out, sums, ["lang"], sums.count() * ROW).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _tail(k: int, names: list[str], j: int):
    """Column j of the words behind the first k; zeros fill the end, as in the n-gram itself."""
    return F.col(names[k + j]) if k + j < len(names) else F.lit(0).cast("long")


def collocation_query(docs: DataFrame) -> DataFrame:
    return collocations(docs)
