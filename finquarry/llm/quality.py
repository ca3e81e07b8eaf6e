"""Quality rules and gradient-boosted trees over document statistics.

Trees are fitted on histograms of a bounded labelled sample, with monotonic constraints on chosen features, and
flattened into arrays (feature, threshold, left, right, value), so that a batch of documents descends all trees
by indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquarry.llm.common import utf8, words
from finquarry.llm.labelled import labelled_sample

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the direction in which quality may go with each (0: free).
FEATURES = {
    "n_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "punctuation_share": -1, "digit_share": 0, "distinct_share": 1, "plain_word_share": 1, "words_per_line": 0, "lines": 0,
    "stop_share": 0, "symbol_word_share": -1, "longest_run_share": -1,
}
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT, _PUNCT = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:-_()[]{}\"'/\\=+~^@`"


def repeat_words(keys: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(keys) < 4:
        return 0
    w = keys[:-2] * np.uint64(0x9E3779B97F4A7C15) + keys[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(keys), dtype=bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def text_statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five base statistics and the trees' features of one text (UTF-8)."""
    ws = words(text)
    n = len(ws)
    joined = b"".join(ws)
    keys = np.fromiter(map(hash, ws), dtype=np.int64, count=n).view(np.uint64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup, rep = len(lines) - len(set(lines)), repeat_words(keys)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    chars = len(joined.decode("utf-8", "replace"))
    m, size = max(n, 1), max(len(joined), 1)
    lower = joined.translate(None, _UPPER)
    sorted_keys = np.sort(keys)
    distinct = 1 + int((sorted_keys[1:] != sorted_keys[:-1]).sum()) if n else 0
    tails = sum(w[-1] in _SYMBOLS or w[-1] == 33 for w in ws)
    run = int((keys[1:] == keys[:-1]).sum()) if n > 1 else 0
    features = [
        float(n), chars / m, symbols / m, dup / max(len(lines), 1), rep / m, (len(joined) - len(lower)) / size,
        (len(joined) - len(joined.translate(None, _PUNCT))) / size, (len(joined) - len(joined.translate(None, _DIGIT))) / size,
        distinct / m, 1 - tails / m, n / max(len(lines), 1), float(len(lines)), sum(len(w) <= 3 for w in ws) / m, tails / m, run / m,
    ]
    return [n, chars, symbols, dup, rep], features


@dataclass
class Trees:
    """Flat nodes of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic boosting. Splits that break a feature's direction are refused, and the children of a constrained
    split are bounded by its middle, so a constraint holds along whole paths. No rows or one class: a constant."""
    n = len(y)
    p0 = (y.sum() + 1) / (n + 2) if n else 0.5
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, np.log(p0 / (1 - p0)))
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)

            def grow(rows: np.ndarray, level: int, low: float, high: float, grad=grad, hess=hess) -> int:
                me, g, h = len(feature), grad[rows].sum(), hess[rows].sum()
                leaf = float(np.clip(g / (h + l2), low, high))
                for a, v in ((feature, 0), (threshold, np.inf), (left, me), (right, me), (value, rate * leaf)):
                    a.append(v)
                best = (1e-6, None)
                if level < depth and h > 2 * least:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, f], weights=grad[rows], minlength=len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], weights=hess[rows], minlength=len(c) + 1))[:-1]
                        gr, hr = g - gl, h - hl
                        vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                        gain = gl * vl - (hl + l2) * vl**2 / 2 + gr * vr - (hr + l2) * vr**2 / 2 - (g * leaf - (h + l2) * leaf**2 / 2)
                        ok = (hl >= least) & (hr >= least) & (monotone[f] * (vr - vl) >= 0)
                        gain = np.where(ok, gain, -1.0)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], (f, k, vl[k], vr[k]))
                if best[1]:
                    f, k, vl, vr = best[1]
                    feature[me], threshold[me] = f, float(cuts[f][k])
                    middle, go = (vl + vr) / 2, binned[rows, f] <= k
                    (ll, lh), (rl, rh) = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
                    left[me] = grow(rows[go], level + 1, ll, lh)
                    right[me] = grow(rows[~go], level + 1, rl, rh)
                return me

            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
            one = Trees(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array(roots[-1:]), 0.0, depth)
            margin = margin + one.margin(x)
    base = float(np.log(p0 / (1 - p0)))
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64, np.int32)
    return Trees(*(np.array(a, dtype=t) for a, t in zip((feature, threshold, left, right, value, roots), kinds, strict=True)), base, depth)


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Trees:
    """Trees for labels.quality, fitted on at most `most` labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_statistics(t)[1] for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = labelled_sample(docs, labels, "quality", most).select("text", "label").mapInArrow(run, "x array<double>, label int").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, (rows["label"].to_numpy() > 0).astype(float), np.array(list(FEATURES.values())))


def quality_rules(docs: DataFrame, labels: DataFrame, least_words: int = 50, most_repeat_percent: int = 50, threshold: float = 0.5, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, rules and verdict of every document, from its whole text.

    base_failed: fewer than least_words words, or over most_repeat_percent of the words in repeated windows. kept:
    not base_failed and the trees' probability of quality is at least threshold. Null text: no words, so failed.
    Repeated rows are judged each; no labels, or labels of one class: the trees say their base rate.
    """
    trees = fit_quality(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            base, features = zip(*map(text_statistics, utf8(batch.column(1))), strict=True)
            b, p = np.array(base, dtype=np.int64), trees.probability(np.array(features))
            failed = (b[:, 0] < least_words) | (100 * b[:, 4] > most_repeat_percent * b[:, 0])
            cols = [batch.column(0), *(pa.array(b[:, k]) for k in range(5)), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "quality", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
