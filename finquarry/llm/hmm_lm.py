"""Hidden Markov language model: Baum-Welch over the corpus, scaled forward recursion for exact likelihoods.

The commonest words are symbols of their own; every other word is the symbol of its ending's class, times its smoothed
share of that class, so the words' probabilities sum to one. Counts of all words come from all training documents.
Baum-Welch sums expected counts over whole texts in each task and adds them by symbol range; rounds over all training
documents go on until the likelihood settles. Documents are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import crc_mod, stage, utf8, words

END = 0  # the symbol that ends a text
CLASSES = 64
TEXTS = 1000  # split at once
_hash = xxhash.xxh3_64_intdigest
_PUNCT = b".,;:!?()[]\"'"


def word_class(w: bytes) -> int:
    """Class of a rarer word: a hash of the last bytes of its letters."""
    return _ending(w.rstrip(_PUNCT)[-3:])


@lru_cache(1 << 16)
def _ending(letters: bytes) -> int:
    return xxhash.xxh32_intdigest(letters) % CLASSES


def hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, ws), dtype=np.uint64, count=len(ws)).view(np.int64)


class Tokens:
    """Words of texts, A-Z in lower case: distinct ones, and for each word its place among them and its text's."""

    def __init__(self, column: pa.Array):
        parts = [words(t.lower()) for t in utf8(column)]
        every = [w for ws in parts for w in ws]
        self.word, self.texts = pa.array(every, pa.large_binary()).dictionary_encode().indices.to_numpy(), len(parts)
        some = np.zeros(int(self.word.max(initial=-1)) + 1, dtype=np.int64)
        some[self.word] = np.arange(len(every))  # a place of each distinct word
        self.distinct = [every[i] for i in some.tolist()]
        self.of = np.repeat(np.arange(len(parts)), [len(ws) for ws in parts])


@dataclass
class Lexicon:
    """Counts of the commonest training words (sorted by hash), and totals. Bounded: `known` rows."""

    key: np.ndarray
    count: np.ndarray
    symbol: np.ndarray  # its own symbol, or 0 for words that are only counted
    tokens: int  # with one end a text
    distinct: int  # the end included
    texts: int
    class_log: np.ndarray  # log10 of each class's words + distinct words + 1
    symbols: int  # own symbols, the end included; classes follow

    def encode(self, text: Tokens) -> list[np.ndarray | pa.Array]:
        """Of each text: tokens, the log10 sums of the base and of the model beside its symbols, known tokens, the symbols
        with the end, and the hashes of words whose counts are not here. A distinct word is looked up once."""
        h = hashes(text.distinct)
        at = np.minimum(np.searchsorted(self.key, h), max(0, len(self.key) - 1))
        here = self.key[at] == h if len(self.key) else np.zeros(len(h), dtype=bool)
        sym = np.where(here, self.symbol[at], 0) if len(self.key) else np.zeros(len(h), dtype=np.int64)
        counts = np.where(here, self.count[at], 0) if len(self.key) else np.zeros(len(h), dtype=np.int64)
        logs, beside = np.log10(counts + 1.0), np.zeros(len(h))
        rare = np.flatnonzero(sym == 0)
        kinds = np.fromiter((word_class(text.distinct[i]) for i in rare.tolist()), dtype=np.int64, count=len(rare))
        sym[rare] = self.symbols + kinds
        beside[rare] = logs[rare] - self.class_log[kinds]
        add = lambda x: np.bincount(text.of, weights=x[text.word], minlength=text.texts)
        stops = np.cumsum(np.bincount(text.of, minlength=text.texts))
        symbols = np.insert(sym[text.word], stops, END).astype(np.uint16)
        away = np.flatnonzero(~here[text.word])
        unseen = np.bincount(text.of[away], minlength=text.texts)
        return [
            np.diff(stops, prepend=0) + 1, add(logs) + np.log10(self.texts + 1.0), add(beside), add(here).astype(np.int64) + (self.texts > 0),
            _binaries(symbols, np.diff(stops, prepend=0) + 1), _binaries(h[text.word[away]], unseen),
        ]


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of values as binary strings."""
    at = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


@dataclass
class Hmm:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K

    def log10(self, texts: list[np.ndarray], most: int = 1 << 19, span: int = 1 << 18) -> np.ndarray:
        """log10 probability of each whole symbol sequence."""
        out = np.zeros(len(texts))
        for group in _groups(texts, most):
            run = _Together(self, [texts[i] for i in group])
            for first in range(0, run.steps, span):
                run.forward(first, min(first + span, run.steps))
            out[group] = run.log10
        return out

    def expect(self, texts: list[np.ndarray], most: int = 1 << 19, span: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) over whole texts, and the log10 likelihood.

        Texts advance together, longest first, in groups of about `most` symbols. The forward messages of the last
        `span` steps are kept; those of earlier spans are made again, from the message at their beginning, when the
        backward pass gets there, so memory is bounded for texts of any length.
        """
        k = len(self.start)
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((len(self.emit), k)), 0.0
        for group in _groups(texts, most):
            run = _Together(self, [texts[i] for i in group])
            firsts = list(range(0, run.steps, span))
            message: list[np.ndarray | None] = [None]
            for first in firsts:
                message.append(run.forward(first, min(first + span, run.steps), message[-1]))
            total += float(run.log10.sum())
            back = None
            for i in range(len(firsts) - 1, -1, -1):
                if i < len(firsts) - 1:
                    run.forward(firsts[i], firsts[i] + span, message[i], again=True)
                pairs, back = run.backward(back, message[i])
                move += self.move * pairs
                if not i:
                    start += run.ahead[: run.active[0]].sum(axis=0)
                for j in range(k):
                    emit[:, j] += np.bincount(run.symbols, weights=run.ahead[:, j], minlength=len(emit))
        return start, move, emit, total


def _groups(texts: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Places of the texts that are not empty, longest first, in groups of about `most` symbols."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-length, kind="stable")[: np.count_nonzero(length)]
    return np.split(order, np.flatnonzero(np.diff(np.cumsum(length[order]) // most)) + 1) if len(order) else []


class _Together:
    """Texts, longest first, that advance together. Rows of the arrays are symbols in the order of steps, so that a step of
    all texts is a stretch of rows, and a step's rows of texts that go on are its first ones.

    Messages are scaled to 1 at every sixteenth step and at a text's end. In between they stay far above the least double,
    as a symbol's likelihoods are taken relative to its highest one, and moves are smoothed.
    """

    EVERY = 16

    def __init__(self, model: Hmm, texts: list[np.ndarray]):
        length = np.array([len(t) for t in texts])
        self.model, self.flat, self.begin = model, np.concatenate(texts), np.concatenate([[0], np.cumsum(length)[:-1]])
        self.active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        self.steps, self.length, self.log10, self.last = int(length[0]), length, np.zeros(len(texts)), np.zeros(len(texts))
        self.high = model.emit.max(axis=1)
        self.relative = model.emit / self.high[:, None]

    def forward(self, first: int, last: int, a: np.ndarray | None = None, again: bool = False) -> np.ndarray:
        """Messages of steps first to last, with `a` that of the step before; the last step's is returned."""
        n = self.active[first:last]
        self.at = np.concatenate([[0], np.cumsum(n)])
        text = np.arange(self.at[-1]) - np.repeat(self.at[:-1], n)
        self.symbols = self.flat[self.begin[text] + np.repeat(np.arange(first, last), n)]
        self.first, self.ahead = first, self.relative[self.symbols]
        self.kept, move, at = np.empty_like(self.ahead), self.model.move, self.at.tolist()
        if not again:
            self.log10 += np.bincount(text, weights=np.log10(self.high)[self.symbols], minlength=len(self.log10))
        for i, n in enumerate(n.tolist()):
            now = self.kept[at[i] : at[i + 1]]
            if a is None:
                now[:] = self.model.start
            else:
                np.matmul(a[:n], move, out=now)
            likely = self.ahead[at[i] : at[i + 1]]
            now *= likely
            if not (first + i) % self.EVERY:
                c = now.sum(axis=1)
                now /= c[:, None]
                likely /= c[:, None]
                if not again:
                    self.log10[:n] += np.log10(c)
            a = now
        self.ended = np.flatnonzero((self.length > first) & (self.length <= last))
        self.ends = self.at[self.length[self.ended] - 1 - first] + self.ended
        if not again:
            self.last[self.ended] = self.kept[self.ends].sum(axis=1)
            self.log10[self.ended] += np.log10(self.last[self.ended])
        return a

    def backward(self, back: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Turns `ahead` into state probabilities of the steps that forward() made, `back` being what the step after them
        sends and `before` the message before them. Returns the sums of pairs of states, without the moves between them,
        and what the first step sends."""
        at, k = self.at.tolist(), self.kept.shape[1]
        n, sent = np.diff(self.at).tolist(), np.empty_like(self.kept)
        sent[self.ends] = 1 / self.last[self.ended][:, None]
        if back is not None:
            sent[at[-2] : at[-2] + len(back)] = back
        turned = np.ascontiguousarray(self.model.move.T)
        for i in range(len(n) - 1, 0, -1):
            likely = self.ahead[at[i] : at[i + 1]]
            likely *= sent[at[i] : at[i + 1]]
            np.matmul(likely, turned, out=sent[at[i - 1] : at[i - 1] + n[i]])
        likely = self.ahead[: at[1]]
        likely *= sent[: at[1]]
        pairs, back = np.zeros((k, k)), likely @ turned
        if before is not None:
            pairs += before[: n[0]].T @ likely
        same = [1, *(np.flatnonzero(np.diff(n[1:])) + 2).tolist(), len(n)] if len(n) > 1 else []
        for low, high in zip(same, same[1:], strict=False):  # steps of as many texts
            ahead = self.ahead[at[low] : at[high]]
            if n[low - 1] == n[low]:
                pairs += self.kept[at[low] - n[low] : at[high] - n[low]].T @ ahead
            else:
                pairs += self.kept[at[low - 1] : at[low - 1] + n[low]].T @ ahead[: n[low]]
                pairs += self.kept[at[low] : at[high] - n[low]].T @ ahead[n[low] :]
        np.multiply(self.kept, sent, out=self.ahead)
        return pairs, back


def reestimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray, prior: float = 50.0) -> Hmm:
    """Parameters out of expected counts, smoothed towards each symbol's share."""
    k = len(start)
    b = emit + prior * share[:, None]
    return Hmm((start + 1) / (start.sum() + k), (move + 1) / (move.sum(axis=1, keepdims=True) + k), b / b.sum(axis=0))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a stretch of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            text = Tokens(batch.column(0).slice(at, TEXTS))
            n = np.bincount(text.word, minlength=len(text.distinct))
            kinds = np.fromiter(map(word_class, text.distinct), dtype=np.int32, count=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(hashes(text.distinct)), pa.array(kinds), pa.array(n)], ["h", "kind", "n"])


def commonest(counts: DataFrame, known: int) -> DataFrame:
    """The words at or above a count such that at most `known` words are: a filter, so that tasks send no more than
    these. Counts are taken by steps of about 1.5 percent."""
    step = F.floor(F.log("n") * 64)
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # some 2000 rows
        total += r["count"]
        if total > known:
            break
        least = r.step
    return counts.filter(F.lit(False) if least is None else step >= least)


def learn_lexicon(train: DataFrame, counts: DataFrame, symbols: int, known: int) -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and each class's training words."""
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = train.count()
    top = commonest(counts, known).toPandas().sort_values(["n", "h"], ascending=[False, True], kind="stable").reset_index(drop=True)
    kinds = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    own = top.head(symbols - 1)
    words_in, types_in = np.zeros(CLASSES), np.zeros(CLASSES)
    words_in[kinds["kind"]], types_in[kinds["kind"]] = kinds["n"], kinds["v"]
    words_in -= np.bincount(own["kind"], weights=own["n"], minlength=CLASSES)
    types_in -= np.bincount(own["kind"], minlength=CLASSES)
    symbol = np.where(np.arange(len(top)) < len(own), np.arange(len(top)) + 1, 0)
    order = np.argsort(top["h"].to_numpy())
    lexicon = Lexicon(top["h"].to_numpy()[order], top["n"].to_numpy()[order], symbol[order].astype(np.int64), (totals.n or 0) + texts, totals.v + (texts > 0), texts, np.log10(words_in + types_in + 1), len(own) + 1)
    return lexicon, words_in


_ENCODED = "doc_id long, held_out boolean, n_tokens long, base double, beside double, known long, symbols binary, rare binary"


def encode_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                cols = [pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(lexicon.encode(Tokens(part.column(2))), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], [x.split()[0] for x in _ENCODED.split(", ")])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _ENCODED)


def _symbols(column) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint16) for b in column.to_pylist()]


def baum_welch(encoded: DataFrame, share: np.ndarray, states: int = 8, rounds: int = 8, settled: float = 0.01, seed: int = 3, span: int = 4096) -> Hmm:
    """Rounds over all training texts, until a round gains less than `settled` log10 units a symbol, at most `rounds`.

    The first model is drawn with a fixed seed: states that differ much and last long, so that few rounds part them. A task adds up its expected counts, in doubles,
    and emits them by ranges of `span` symbols; ranges are summed apart.
    """
    rnd = np.random.default_rng(seed)
    jitter = rnd.gamma(0.2, 1.0, (len(share), states)) + 0.05
    sticky = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(sticky, 0.98)
    model = Hmm(np.full(states, 1 / states), sticky, (share[:, None] * jitter) / (share[:, None] * jitter).sum(axis=0))

    def gather(now: Hmm):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    new = now.expect(_symbols(batch.column(0)))
                    total = new if total is None else tuple(a + b for a, b in zip(total, new, strict=True))
            if total is not None:
                start, move, emit, fit = total
                parts = [np.concatenate([start, move.ravel(), [fit, emit.sum()]]), *(emit[i : i + span].ravel() for i in range(0, len(emit), span))]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})

    last = -np.inf
    for _ in range(rounds):
        rows = encoded.select("symbols").mapInArrow(gather(model), "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect()
        parts = {r.part: np.frombuffer(r.counts) for r in rows}
        if not parts:
            break
        head = parts.pop(0)
        model = reestimate(head[:states], head[states:-2].reshape(states, states), np.concatenate([parts[i] for i in sorted(parts)]).reshape(-1, states), share)
        fit = head[-2] / head[-1]
        if fit - last < settled:
            break
        last = fit
    return model


def lm_scores(docs: DataFrame, folds: int = 7, held_fold: int = 2, states: int = 8, rounds: int = 8, symbols: int = 1 << 15, known: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document row.

    Rows with crc32(doc_id as text) mod folds = held_fold are held out of learning. Null text: empty, so one token,
    the end. A null id counts as an empty text's. Repeated rows are scored each. Hashes of 64 bits stand for words.
    Without training rows every count is 0. The order and partitioning of rows change scores by rounding alone.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.withColumn("held_out", crc_mod("doc_id", folds) == held_fold)
    train = src.filter(~F.col("held_out"))
    counts = stage(train.select("text").mapInArrow(_count, "h long, kind int, n long").groupBy("h", "kind").agg(F.sum("n").alias("n")), "lm-counts")
    lexicon, class_words = learn_lexicon(train, counts, symbols, known)
    encoded = stage(encode_documents(src, lexicon).withColumn("rid", F.monotonically_increasing_id()), "lm-encoded")

    share = np.zeros(lexicon.symbols + CLASSES)
    own = lexicon.symbol > 0
    share[lexicon.symbol[own]] = lexicon.count[own]
    share[END] = lexicon.texts
    share[lexicon.symbols :] = class_words
    share = (share + 0.5) / (share + 0.5).sum()
    model = baum_welch(encoded.filter(~F.col("held_out")), share, states, rounds)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [np.frombuffer(b, dtype=np.int64) for b in part.column(1).to_pylist()]
                rid = np.repeat(part.column(0).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["rid", "h"])

    seen = encoded.filter(F.octet_length("rare") > 0).select("rid", "rare").mapInArrow(rare, "rid long, h long")
    looked = seen.join(counts.select("h", "n"), "h").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("more_known"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.log10(_symbols(batch.column(batch.num_columns - 1))))], [*batch.schema.names[:-1], "sequence"])

    kept = ["rid", "doc_id", "held_out", "n_tokens", "base", "beside", "known"]
    kinds = "rid long, doc_id long, held_out boolean, n_tokens long, base double, beside double, known long, sequence double"
    scored = encoded.select(*kept, "symbols").mapInArrow(score, kinds).join(looked, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    smoothing = float(np.log10(lexicon.tokens + lexicon.distinct + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(smoothing)).alias("base_score"), (F.col("sequence") + F.col("beside") + more).alias("score"),
    )
