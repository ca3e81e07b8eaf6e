"""Toxicity by maximum-scoring segments of token log-odds.

Log-odds of toxic against clean use come from counts with a Dirichlet prior. Under the clean model the scores are
log likelihood ratios with a negative mean, so Karlin-Altschul statistics hold with lambda = 1: a segment of score
S in n tokens is expected K * n * exp(-S) times by chance. All maximal segments of a text are found by one linear
scan; the significant ones are summed to a statistic, which a logistic curve turns into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import crc_mod, drop_staged, stage, utf8
from finquarry.llm.labelled import labelled_sample

#: One pass over UTF-8 bytes: A-Z to lower case, other ASCII that is neither letter nor digit to space.
_FOLD = bytes(ord(chr(i).lower()) if i > 127 or chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in linear time (Ruzzo and Tompa).

    Only positive scores can begin or end one, so the scan visits those and reads what lies between from sums.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores, dtype=float)
    after = total[at]
    before = after - scores[at]
    stack: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum after
    for i, low, high in zip(at.tolist(), before.tolist(), after.tolist(), strict=True):
        start, stop = i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((start, stop, low, high))
    return [(a, b, high - low) for a, b, low, high in stack]


#: Besides a whole word, its first bytes count as features, so that inflected forms share evidence.
STEMS = (4, 5, 6)


def features(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


class WordScores(dict):
    """Score of each word: that of its most significant feature. A cache that forgets beyond `most` words."""

    def __init__(self, scores: dict[bytes, float], rank: dict[bytes, float], other: float, most: int = 400_000):
        super().__init__()
        self.scores, self.rank, self.other, self.most = scores, rank, other, most

    def feature(self, word: bytes) -> bytes:
        return max((f for f in features(word) if f in self.rank), key=self.rank.__getitem__, default=b"")

    def __missing__(self, word: bytes) -> float:
        if len(self) > self.most:
            self.clear()
        self[word] = found = self.scores.get(self.feature(word), self.other)
        return found

    def __reduce__(self):
        return WordScores, (self.scores, self.rank, self.other, self.most)


@dataclass
class ToxicModel:
    words: WordScores
    k: float = 0.1
    slope: float = 1.0
    shift: float = 0.0

    def passages(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments with their scores."""
        ts = tokens(text)
        return len(ts), maximal_segments(np.fromiter(map(self.words.__getitem__, ts), dtype=float, count=len(ts)))

    def statistic(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """The best sum of normalised scores of the r highest segments, plus log r! (Karlin and Altschul)."""
        if not segments:
            return -math.log(self.k * max(n, 1))
        norm, best, total = math.log(self.k * max(n, 1)), -math.inf, 0.0
        for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
            total += s - norm
            best = max(best, total + math.lgamma(r + 1))
            if s < norm:
                break
        return best

    def significant(self, n: int, segments: list[tuple[int, int, float]], expect: float = 0.05) -> list[tuple[int, int, float]]:
        return [x for x in segments if self.k * n * math.exp(-min(x[2], 700)) < expect]

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * statistic + self.shift))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, prior: float = 200.0, least_z: float = 3.0, most_words: int = 20_000, folds: int = 5, text_col: str = "text") -> ToxicModel:
    """Learn from at most `most` labelled documents with crc32(doc_id) mod folds other than 0.

    Counts are capped at 2 per document and word, so that one document's refrain is no evidence. Words and stems
    whose log-odds differ from 0 by least_z deviations are features, at most most_words; a word belongs to its most
    significant feature, and all words without one share a score, so the features part the tokens. Extreme values and
    the logistic curve are fitted to scores that leave a text's own counts out of the log-odds it is read with. No
    labelled rows, or one class only: every text gets the share of toxic labels.
    """
    sample = stage(labelled_sample(docs, labels, "toxic", most, crc_mod("doc_id", folds) != 0, text_col=text_col).select("text", "label"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()), *(pa.array([c[w] for w in both], pa.int64()) for c in seen)], ["word", "clean", "toxic"])
            for c in seen:
                c.clear()

        for batch in batches:
            for text, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[label > 0].update({w: min(n, 2) for w, n in Counter(tokens(text)).items()})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from out()
        yield from out()

    counts = stage(sample.mapInArrow(count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-counts")
    n0, n1 = (x or 0 for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    rows = sample.agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("int")).alias("toxic")).first()
    rate = ((rows.toxic or 0) + 1) / (rows.n + 2)
    if not n0 or not n1:
        drop_staged(sample, counts)
        return ToxicModel(WordScores({}, {}, -0.01), slope=0.0, shift=math.log(rate / (1 - rate)))

    def spread(batches: Iterator[pa.RecordBatch], of=features) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, c, t) for w, c, t in zip(*(x.to_pylist() for x in batch.columns), strict=True) for f in of(w)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["word", "clean", "toxic"])

    def sums(of):
        return counts.mapInArrow(lambda b: spread(b, of), "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    a = F.lit(0.5) + F.lit(prior) * (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1))
    y0, y1 = F.col("clean") + a, F.col("toxic") + a
    delta = F.log(y1 / (F.lit(n1 + prior) - y1)) - F.log(y0 / (F.lit(n0 + prior) - y0))
    z = F.abs(delta / F.sqrt(1 / y0 + 1 / y1))
    strong = sums(features).withColumn("z", z).filter(F.col("z") >= least_z).orderBy(F.desc("z"), "word").limit(most_words).collect()
    rank = {bytes(r.word): r.z for r in strong}
    first = WordScores({}, rank, 0.0)
    evidence = Evidence({bytes(r.word): (r.clean, r.toxic) for r in sums(lambda w: [first.feature(w)]).collect()}, n0, n1, prior)
    scores = {f: evidence.score(f) for f in evidence.counts}
    model = ToxicModel(WordScores(scores, rank, scores.pop(b"", -0.01)))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence.passages(model, t, 0) for t, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True) if label <= 0]
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([math.fsum(n * math.exp(-max((s for *_, s in x), default=0.0)) for n, x in found)])], ["n", "s"])

    r = sample.mapInArrow(highest, "n long, s double").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    model.k = float((r.n or 0) / max(1e-9, r.s or 0.0))  # maximum likelihood with lambda = 1

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.statistic(*evidence.passages(model, t, label)) for t, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.float64())], ["label", "x"])

    seen = sample.mapInArrow(statistics, "label int, x double").toPandas()  # two numbers for each of at most `most` rows
    seen = seen.sort_values(["x", "label"], kind="stable")  # so that sums agree whatever order rows come in
    model.slope, model.shift = _logistic(seen["x"].to_numpy(), (seen["label"].to_numpy() > 0).astype(float))
    drop_staged(sample, counts)
    return model


@dataclass
class Evidence:
    """Counts of each feature in clean and toxic texts (b"": words without one), and their totals."""

    counts: dict[bytes, tuple[int, int]]
    n0: int
    n1: int
    prior: float

    def score(self, feature: bytes, own: int = 0, total: int = 0, toxic: bool = False) -> float:
        """Log ratio of the feature's smoothed shares, without `own` of `total` counts of one text. Words without a
        feature score below 0, so that passages end."""
        y0, y1 = self.counts.get(feature, (0, 0))
        y0, y1 = (y0, max(0, y1 - own)) if toxic else (max(0, y0 - own), y1)
        n0, n1 = (self.n0, self.n1 - total) if toxic else (self.n0 - total, self.n1)
        a = 0.5 + self.prior * (y0 + y1) / max(1, n0 + n1)
        s = math.log((y1 + a) / (n1 + self.prior)) - math.log((y0 + a) / (n0 + self.prior))
        return s if feature else min(s, -1e-4)

    def passages(self, model: ToxicModel, text: bytes, label: int) -> tuple[int, list[tuple[int, int, float]]]:
        """ToxicModel.passages of a labelled text, by scores that leave it out."""
        ts = tokens(text)
        of, own = {}, Counter()
        for w, n in Counter(ts).items():
            of[w] = f = model.words.feature(w)
            own[f] += min(n, 2)
        total = sum(own.values())
        score = {f: self.score(f, n, total, label > 0) for f, n in own.items()}
        return len(ts), maximal_segments(np.fromiter((score[of[w]] for w in ts), dtype=float, count=len(ts)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift by Newton steps, slope kept from running away on separable rows."""
    scale = max(float(np.std(x)), 1e-9)
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (y - p) - ridge * w * [1, 0]
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's (doc_id, score, predicted int, passages array<struct<start,stop,score>>), from its whole text.

    start and stop count tokens. Null or empty text has no passage and the score of an empty text. Repeated rows
    are scored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [model.passages(t) for t in utf8(batch.column(1))]
            p = [model.probability(model.statistic(*x)) for x in found]
            spans = [[{"start": a, "stop": b, "score": s} for a, b, s in model.significant(*x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "passages"])

    schema = "doc_id long, score double, predicted int, passages array<struct<start:long,stop:long,score:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that the model does not call toxic, with all their columns, in one narrow pass."""
    model = fit_toxicity(docs, labels, text_col=text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.probability(model.statistic(*model.passages(t))) < 0.5 for t in utf8(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
