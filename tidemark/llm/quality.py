"""Operator 7: document quality by Bradley-Terry ranking.

A document's score is w . x of its text features; w maximises the likelihood that of a good and a poor document the
good one wins, sigmoid(w . (x_good - x_poor)). Pairs come from a bounded sample of labelled training rows (SAMPLE of
each label in expectation, drawn by id hash). The common words behind two features are counted over all training texts.
The threshold is the quantile of the scores of all labelled training rows that separates the labels best; scores are
scaled so that it lies at CUT.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.llm.common import bounded, chunks, claim, cut, drop, fold, offsets_and_bytes
from tidemark.llm.words import Lookup, frequent, shingles, word_hashes

CUT = 0.7
SAMPLE = 4000
PAIRS = 60_000
COMMON = 400
#: Bins of the histogram of scores; labelled ids that may be broadcast, 12 bytes each.
BINS, BROADCAST_ROWS = 1 << 16, 1_000_000
#: Kinds of bytes: lower case, upper case, digits, blanks, line ends, sentence marks, other ASCII, beyond ASCII.
KIND = np.full(256, 6, np.int64)
KIND[128:] = 7
KIND[[*b".,;:'\"()-?"]] = 5
KIND[[9, 32]], KIND[[10, 11, 12, 13]] = 3, 4
KIND[48:58], KIND[65:91], KIND[97:123] = 2, 1, 0


def features(col: pa.Array, common: Lookup) -> np.ndarray:
    """[text, feature] from whole texts; an empty text has zeros."""
    off, data = offsets_and_bytes(col)
    n = len(off) - 1
    size = np.diff(off)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    words, before = word_hashes(off, data)
    count = np.diff(before)
    of = np.repeat(np.arange(n), count)
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    sums = lambda x: np.bincount(of, x, n)
    twos = shingles(words, 2)
    kinds_of_word, kinds_of_two = np.zeros(n), np.zeros(n)
    for i, (a, z) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
        if z > a:
            kinds_of_word[i] = len(np.unique(words[a:z]))
            kinds_of_two[i] = len(np.unique(twos[a : z - 1])) if z - a > 1 else 1
    b, w = np.maximum(1, size), np.maximum(1, count)
    letters = np.maximum(1, kinds[:, 0] + kinds[:, 1])
    upper, marks, other = kinds[:, 1] / letters, kinds[:, 5] / b, kinds[:, 6] / b
    repeat = sums(again) / w
    twice = np.where(count > 1, 1 - kinds_of_two / np.maximum(1, count - 1), 0)
    usual = sums((common(words) >= 0).astype(float)) / w
    base = [upper, marks, other, repeat, twice, usual, kinds[:, 2] / b, kinds[:, 4] / w, kinds[:, 7] / b]
    bent = [np.sqrt(x) for x in (upper, other, repeat, np.maximum(0, twice))] + [np.minimum(1, x / 0.3) for x in (upper, usual)] + [np.minimum(1, x / 0.02) for x in (other, repeat)]
    out = np.stack([*base, *bent, np.log1p(count), (size / w).clip(0, 40) / 10, kinds_of_word / w], 1)
    out[count == 0] = 0
    return out


@dataclass
class Model:
    common: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steep: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the raw score, CUT at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.steep * (raw - self.threshold) + math.log(CUT / (1 - CUT)), -40, 40)))


def _rank(x: np.ndarray, good: np.ndarray, poor: np.ndarray, steps: int = 400) -> np.ndarray:
    """Bradley-Terry weights from random pairs, with a small ridge, by accelerated gradient descent."""
    rng = np.random.default_rng(11)
    d = x[rng.choice(good, PAIRS)] - x[rng.choice(poor, PAIRS)]
    w = np.zeros(x.shape[1])
    ahead, rate = w.copy(), 4 / max(1e-9, np.linalg.eigvalsh(d.T @ d / len(d))[-1])
    for i in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ ahead, -40, 40)))
        new = ahead + rate * (d.T @ p / len(d) - 1e-3 * ahead)
        ahead, w = new + (i / (i + 3)) * (new - w), new
    return w


def fit(x: np.ndarray, label: np.ndarray, common: np.ndarray) -> Model:
    """Fit on features and labels (1 good, 0 poor); with one label only every text scores CUT or, if it is poor, below."""
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        f = x.shape[1]
        return Model(common, np.zeros(f), np.ones(f), np.zeros(f), 0.0 if len(good) or not len(label) else 1.0, 0.8473)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    m = Model(common, mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
    m.weights = _rank(((x - mean) / scale).clip(-8, 8), good, poor)
    return m


def set_threshold(m: Model, raw: np.ndarray, good: np.ndarray, poor: np.ndarray) -> Model:
    """The model with its threshold at the quantile of raw scores, of so many good and poor texts each, that separates them best.

    With one label only the threshold stays where it is.
    """
    if not good.sum() or not poor.sum():
        return m
    order = np.argsort(raw)
    raw, good, poor = raw[order], good[order], poor[order]
    upto = np.cumsum(good + poor) / (good + poor).sum()
    at = np.unique(np.searchsorted(upto, np.linspace(0, 1, 1001)).clip(0, len(raw) - 1))
    above = 1 - (np.cumsum(good) - good)[at] / good.sum()
    below = (np.cumsum(poor) - poor)[at] / poor.sum()
    best = at[np.flatnonzero(above + below >= (above + below).max() - 1e-9)]
    threshold = float((raw[best[0]] + raw[best[-1]]) / 2)
    middle = float(raw[np.searchsorted(np.cumsum(good), good.sum() / 2)])
    return replace(m, threshold=threshold, steep=4 / max(1e-6, middle - threshold))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows of docs: SAMPLE of each label in expectation, all of them where there are fewer.

    Null labels, labels but 0 and 1 and null ids are left out; an id of both labels counts for both; null texts are empty.
    """
    named = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in named.groupBy("label").count().collect() if r["label"] in (0, 1)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    pick = F.lit(False)
    for k, c in sizes.items():
        pick = pick | ((F.col("label") == k) & (place < int(min(1.0, sample / c) * (1 << 20))))
    picked, picked_path = cut(named.where(pick), "picked")
    few = F.broadcast(picked) if bounded(picked, 20 * sample) else picked  # beyond that only if ids have many labels
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(few, "doc_id").select("text", "label")
    chosen, path = cut(chosen, "labelled")

    def count(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                h, n = np.unique(word_hashes(*offsets_and_bytes(b.column(0)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts, counts_path = cut(docs.select(F.col(text).alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word_counts")
    common, _ = frequent(counts, COMMON)

    def measure(batches):
        find = Lookup(common)
        for whole in batches:
            for b in chunks(whole, "text"):
                x = features(b.column(0), find)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    got = chosen.mapInArrow(measure, "label int, x array<double>").orderBy("label", "x").toArrow()  # a few numbers for each text of the sample
    drop(docs.sparkSession, path, picked_path, counts_path)
    width = features(pa.array([""]), Lookup(common)).shape[1]
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if got.num_rows else np.zeros((0, width))
    model = fit(x, got.column("label").to_numpy(), common)
    # the threshold, from a histogram of the scores of all labelled rows: raw scores are bounded, so are its bins
    share = docs.sparkSession.sparkContext.broadcast(model)
    unit = max(1e-9, float(np.abs(model.weights).sum()) * 16 / BINS)

    def place_scores(batches):
        m, find = share.value, Lookup(share.value.common)
        for whole in batches:
            for b in chunks(whole, "text"):
                bins = np.floor(m.raw(features(b.column(0), find)) / unit).astype(np.int64)
                at, n = np.unique(bins * 2 + b.column(1).to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    named = named.where(F.col("label").isin(0, 1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(named) if bounded(named, BROADCAST_ROWS) else named, "doc_id").select("text", "label")
    bins = rows.mapInArrow(place_scores, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = bins.column("at").to_numpy(), bins.column("n").to_numpy()
    # a bin's lower edge, a millionth of it lower against rounding: a text of the bin that is cut at is above the cut
    return set_threshold(model, (at // 2 - 1e-6) * unit, np.where(at % 2 == 1, n, 0), np.where(at % 2 == 0, n, 0))


def rate(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, then score and predicted, for every row; null and empty texts score as zero features.

    A kept column with a result's name gives way to the result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    share = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        claim("quality", lambda: None)
        m: Model = share.value
        common = Lookup(m.common)
        for whole in batches:
            for b in chunks(whole, "__text"):
                s = m.score(m.raw(features(b.column(b.num_columns - 1), common)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*b.schema.names[:-1], "score", "predicted"])

    return source.mapInArrow(run, StructType(source.schema.fields[:-1] + [StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def predict(docs: DataFrame, labels: DataFrame, fold_of: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels count only for rows outside the held-out fold.

    Null and empty texts have zero features and their score. predicted is 1 from a score of CUT on, ties included. Null
    ids are never held out. Repeated rows give repeated results, an empty table none; without labels of both kinds every
    text scores the same. Other columns are not looked at.
    """
    out = fold("doc_id", fold_of) == held
    model = train(docs.where(~out), labels.where(~out))
    return rate(docs.select("doc_id", out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
