"""Operator 2: a log-bilinear language model trained by noise-contrastive estimation, and a unigram base score.

Words are split at white space with A-Z lowered; every text ends with one end token. The counts of all words of all
training texts, and of all triples of the START - 1 most frequent tokens and "rare", are summed in Spark. Every token
that occurs LEAST times has vectors of its own, as context and as target, as far as HEAD; all others are the word "rare".
A word is predicted from the two before it: q = C1 r[w1] + C2 r[w2], score(w) = q . v[w] + b[w] (Mnih and Hinton,
2007), fitted by noise-contrastive estimation (Mnih and Teh, 2012). A first fit on the driver, to the counts of triples,
gives where to start: a word outside them has the vectors of "rare". From there each task goes once over all its
training texts, with noise from the word frequencies; a row's changes are averaged over the tasks by how often each met
it. So both the words and the steps grow with the corpus.

Words are parted by falling frequency into classes, at most MOST_CLASSES, and these into groups, whose scores are fitted
in the same way. A score is normalised over the groups, then over the classes of the group, then over the words of the
class. A rare token's probability within "rare" is
(c + 0.1) / (n + 0.1 (v + 1)), so all known words and one unknown word together have probability one.

Counts of the HEAD most frequent words are broadcast (3 MB); those of the rest meet the texts' rare words by a join.
The vectors are broadcast too, in 16 bits: about 98 bytes a word, at most 26 MB.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, claim, cut, fold, offsets_and_bytes
from tidemark.llm.words import END, Lookup, frequent, word_hashes

#: Words of the first fit, with "rare".
START = 128
#: Words with vectors have LEAST occurrences, or are among the first fit's.
LEAST = 5
HEAD = 1 << 18
#: Size of the vectors, pairs seen in training, noise tokens for each.
WIDTH, SEEN, BATCH, NOISE = 24, 1_500_000, 2048, 8
SMOOTH = 0.1
#: The pass over all texts: triples of a step, its noise words, classes and groups, rate; most classes; numbers scored at once.
STEP, NOISE_WORDS, NOISE_CLASSES, NOISE_GROUPS, RATE, MOST_CLASSES, AT_ONCE = 4096, 64, 32, 16, 0.1, 1024, 1 << 18


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and the place of each text's first token."""
    words, before = word_hashes(*offsets_and_bytes(col))
    n = len(before) - 1
    out = np.full(len(words) + n, np.uint64(END))
    begin = before + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[begin[1:] - 1] = False
    out[keep] = words
    return out, begin


def count_tokens(train: DataFrame) -> DataFrame:
    """(h, n): how often each token occurs in all training texts."""

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "text"):
                h, n = np.unique(tokens(b.column(0))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def contexts(classes: np.ndarray, begin: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the two tokens before each one; before the first stands the edge class."""
    one, two = np.full(len(classes), edge), np.full(len(classes), edge)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    first = begin[:-1]
    one[first] = edge
    two[first] = edge
    second = first + 1
    two[second[second < begin[1:]]] = edge
    return one, two


def count_triples(train: DataFrame, names: np.ndarray) -> np.ndarray:
    """Corpus counts [c2, c1, class] over all training texts; at most (START + 1) ^ 2 * START cells reach the driver."""
    k = len(names) + 1

    def run(batches):
        lookup = Lookup(names)
        for whole in batches:
            total: np.ndarray | None = None
            for b in chunks(whole, "text"):
                got, begin = tokens(b.column(0))
                c = lookup(got)
                c[c < 0] = k - 1
                one, two = contexts(c, begin, k)
                part = np.bincount((two * (k + 1) + one) * k + c, minlength=(k + 1) ** 2 * k)
                total = part if total is None else total + part
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    got = train.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((k + 1) ** 2 * k, np.int64)
    out[got.cell.to_numpy()] = got.n.to_numpy()
    return out.reshape(k + 1, k + 1, k)


def first_fit(triples: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """r, v, the two matrices and b of a model fitted to the counts."""
    k = triples.shape[2]
    rng = np.random.default_rng(seed)
    total = triples.sum()
    unigram = (triples.sum((0, 1)) + 1.0) / (total + k)
    r = rng.normal(0, 0.1, (k + 1, WIDTH)).astype(np.float32)
    v = rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32)
    c = [np.eye(WIDTH, dtype=np.float32) * w for w in (0.8, 0.4)]
    bias = np.log(unigram).astype(np.float32)
    if total:
        cells = np.flatnonzero(triples.ravel())
        edges = np.cumsum(triples.ravel()[cells] / total)
        noise_edges, log_noise = np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)
        state = [np.full_like(x, 1e-3) for x in (r, v, c[0], c[1], bias)]
        steps = SEEN // BATCH

        def step(x, held, grad, rate):
            held += grad * grad
            x -= rate * grad / np.sqrt(held)

        for i in range(steps):
            rate = 0.15 * (1 - i / steps) + 0.005
            cell = cells[np.minimum(np.searchsorted(edges, rng.random(BATCH)), len(cells) - 1)]
            two, one, w = cell // ((k + 1) * k), cell // k % (k + 1), cell % k
            shown = np.empty((BATCH, NOISE + 1), np.int64)
            shown[:, 0] = w
            shown[:, 1:] = np.minimum(np.searchsorted(noise_edges, rng.random((BATCH, NOISE))), k - 1)
            q = r[one] @ c[0] + r[two] @ c[1]
            s = np.einsum("bd,bnd->bn", q, v[shown]) + bias[shown] - log_noise[shown]
            err = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            err[:, 0] -= 1
            err /= BATCH
            gq = np.einsum("bn,bnd->bd", err, v[shown])
            gv, gb, gr = np.zeros_like(v), np.bincount(shown.ravel(), err.ravel(), k).astype(np.float32), np.zeros_like(r)
            onehot = np.zeros((BATCH, k), np.float32)
            np.add.at(onehot, (np.arange(BATCH)[:, None], shown), err)
            gv = onehot.T @ q
            np.add.at(gr, one, gq @ c[0].T)
            np.add.at(gr, two, gq @ c[1].T)
            grads = (gr, gv, r[one].T @ gq, r[two].T @ gq, gb)
            for x, held, g in zip((r, v, c[0], c[1], bias), state, grads, strict=True):
                step(x, held, g, rate)
    return r, v, c, bias


def fit(triples: np.ndarray, seed: int = 7) -> np.ndarray:
    """Table [c2, c1, class] of normalised log10 probabilities of the model fitted to the counts."""
    k = triples.shape[2]
    r, v, c, bias = first_fit(triples, seed)
    first, second = r @ c[0], r @ c[1]
    logit = ((second[:, None, :] + first[None, :, :]).reshape(-1, WIDTH) @ v.T + bias).astype(np.float64)
    top = logit.max(1, keepdims=True)
    logit -= top + np.log(np.exp(logit - top).sum(1, keepdims=True))
    return (logit / math.log(10)).reshape(k + 1, k + 1, k)


@dataclass
class Vectors:
    """r: of words, "rare" and the edge. out: v and b of words and "rare"; up: of classes, "rare" the last, then groups. c: C1, C2.

    first: the first word of each class, then of "rare", then the end; words stand by falling frequency. group: the first
    class of each group, then the end. share: the frequencies of words and "rare".
    """

    r: np.ndarray
    out: np.ndarray
    up: np.ndarray
    c: np.ndarray
    first: np.ndarray
    group: np.ndarray
    share: np.ndarray

    @property
    def kind(self) -> np.ndarray:
        """The class of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def kin(self) -> np.ndarray:
        """The group of each class."""
        return np.repeat(np.arange(len(self.group) - 1), np.diff(self.group))

    def copy(self, to) -> Vectors:
        return Vectors(*(x.astype(to) for x in (self.r, self.out, self.up, self.c)), self.first, self.group, self.share)

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        """Numbers of words summed by class, then by group."""
        classes = np.add.reduceat(of_words, self.first[:-1])
        return np.concatenate([classes, np.add.reduceat(classes, self.group[:-1])])

    def rows(self) -> np.ndarray:
        """All fitted numbers as rows: words, rare, edge; classes; the matrices."""
        words = np.hstack([self.r, np.vstack([self.out, np.zeros((1, WIDTH + 1), self.out.dtype)])])
        classes = np.hstack([np.zeros((len(self.up), WIDTH), self.up.dtype), self.up])
        return np.vstack([words, classes, np.hstack([self.c[0], self.c[1], np.zeros((WIDTH, 1), self.c.dtype)])])

    def moved(self, delta: np.ndarray) -> Vectors:
        n, k = len(self.r), len(self.up)
        w, m = delta[:n], delta[n + k :]
        return Vectors(self.r + w[:, :WIDTH], self.out + w[:-1, WIDTH:], self.up + delta[n : n + k, WIDTH:], self.c + np.stack([m[:, :WIDTH], m[:, WIDTH : 2 * WIDTH]]), self.first, self.group, self.share)

    @cached_property
    def turned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r C1, r C2 with a 1 behind it, for b, and the class of each word: what scoring looks up."""
        two = np.ones((len(self.r), WIDTH + 1), np.float32)
        two[:, :WIDTH] = self.r @ self.c[1]
        one = np.zeros_like(two)
        one[:, :WIDTH] = self.r @ self.c[0]
        return one, two, self.kind.astype(np.int32)

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each word after the two words before it."""
        first, second, kind = self.turned
        kind, out = kind[word], np.zeros(len(word))
        order = np.argsort(kind, kind="stable")
        place, kind = word[order], kind[order]
        q = first.take(one[order], 0)
        q += second.take(two[order], 0)
        longest = float(np.sqrt(np.einsum("bd,bd->b", q, q).max(initial=0)))

        def among(table, a, z, at, base=0):
            """Adds the log probabilities of the table's rows at[a:z] - base to out[a:z], a run in order of class."""
            ones, turned = np.ones(len(table), np.float32), np.ascontiguousarray(table.T)
            small = longest * float(np.sqrt(np.einsum("bd,bd->b", table, table).max())) < 60  # then no exp can overflow
            most = max(1, AT_ONCE // len(table))
            for i in range(a, z, most):
                j = min(i + most, z)
                logit = q[i:j] @ turned
                top = 0.0
                if not small:
                    top = logit.max(1)
                    logit -= top[:, None]
                chosen = logit.take(np.arange(j - i) * len(table) + (at[i:j] - base))
                out[i:j] += chosen - np.log(np.exp(logit, out=logit) @ ones, dtype=np.float64)

        def within(table, bounds, at, whose):
            """The same for the rows between each two bounds, by where `whose`, in order, has their number."""
            ends = np.searchsorted(whose, np.arange(len(bounds)))
            for k in np.flatnonzero((np.diff(bounds) > 1) & (np.diff(ends) > 0)):
                among(table[bounds[k] : bounds[k + 1]], ends[k], ends[k + 1], at, bounds[k])

        kin = self.kin[kind]
        among(self.up[len(self.first) - 1 :], 0, len(word), kin)
        within(self.up, self.group, kind, kin)
        within(self.out, self.first, place, kind)
        given = np.empty(len(word))
        given[order] = out
        return given / math.log(10)


def start(triples: np.ndarray, counts: np.ndarray, rare: int) -> Vectors:
    """The first fit's model, with words of those counts and so many rare tokens."""
    r, v, c, b = first_fit(triples)
    n, k = len(counts), len(b)
    share = np.append(counts, rare) + 1.0
    share /= share.sum()
    known = min(n, k - 1)
    of = np.append(np.arange(known), np.full(n + 1 - known, k - 1))
    out = np.hstack([v[of], b[of, None]])
    out[known:, WIDTH] += np.log(share[known:] / share[known:].sum())

    def parts(weights, most):
        """First places of at most `most` runs of near equal sums of square roots, then of the last weight, then the end."""
        n = len(weights) - 1
        root = np.cumsum(np.sqrt(weights[:n]))
        kind = np.append(np.unique((root * (most / root[-1] * (1 - 1e-9))).astype(int), return_inverse=True)[1], -1) if n else np.array([-1])
        kind[-1] = kind.max() + 1
        return np.searchsorted(kind, np.arange(kind[-1] + 2))

    first = parts(share, min(MOST_CLASSES, math.isqrt(n) * 5 // 2 + 1))  # about where the three levels cost least together
    sizes = np.add.reduceat(share, first[:-1])
    group = parts(sizes, math.isqrt(len(sizes)) + 1)

    def over(rows, weights, bounds):
        """Vectors of the parts: means of their rows, and biases that hold their sums."""
        up = np.add.reduceat(rows * weights[:, None], bounds[:-1]) / np.add.reduceat(weights, bounds[:-1])[:, None]
        up[:, WIDTH] = np.log(np.add.reduceat(np.exp(rows[:, WIDTH].astype(float)), bounds[:-1]))
        return up

    classes = over(out, share, first)
    up = np.vstack([classes, over(classes, sizes, group)])
    return Vectors(r[np.append(of, k)].astype(np.float32), out.astype(np.float32), up.astype(np.float32), np.stack(c), first, group, share)


class Pass:
    """One task's pass of noise-contrastive estimation over its texts, from given vectors."""

    def __init__(self, begin: Vectors, seed: int):
        self.now = begin.copy(np.float32)
        self.rng = np.random.default_rng(seed)
        self.kind = begin.kind.astype(np.int32)
        self.kin = begin.kin.astype(np.int32)[self.kind]
        self.classes = len(begin.first) - 1
        self.states = [np.ones(len(x), np.float32) for x in (self.now.r, self.now.out, self.now.up)]
        self.state_c = np.full_like(self.now.c, 1e-2)
        up = begin.sums(begin.share)
        levels = (begin.share, NOISE_WORDS), (up[: self.classes], NOISE_CLASSES), (up[self.classes :], NOISE_GROUPS)
        self.noise = [(np.cumsum(x), np.log(k * x).astype(np.float32), k) for x, k in levels]
        self.met = np.zeros(len(begin.out), np.int64)

    def _move(self, x: np.ndarray, held: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        """A step of the rows `at` (in order; they may repeat), by their summed gradients."""
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        if len(first) < len(at):
            grad, at = np.add.reduceat(grad, first, axis=0), at[first]
        held[at] += np.einsum("bd,bd->b", grad, grad)
        grad *= (RATE / np.sqrt(held[at]))[:, None]
        x[at] -= grad

    def _contrast(self, x: np.ndarray, held: np.ndarray, noise, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Gradient by q; moves the rows of x. `at` is in order."""
        edges, log_noise, k = noise
        drawn = np.sort(np.minimum(np.searchsorted(edges, self.rng.random(k)), len(x) - 1))
        vectors, others = x.take(at, 0), x[drawn]
        right = np.einsum("bd,bd->b", q, vectors) - log_noise[at]
        wrong = log_noise[drawn] - q @ others.T
        for s in (right, wrong):  # 1 / (1 + exp(s)) in place; far out exp is infinite and the result 0
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
        vectors *= right[:, None]
        gq = wrong @ others
        gq -= vectors
        self._move(x, held, at, q * -right[:, None])
        self._move(x, held, drawn, wrong.T @ q)
        return gq

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> None:
        self.met += np.bincount(word, minlength=len(self.met))
        now, k, order = self.now, self.classes, self.rng.permutation(len(word))
        word, one, two = (x.astype(np.int32) for x in (word, one, two))
        with np.errstate(over="ignore"):
            for a in range(0, len(order), STEP):
                at = order[a : a + STEP]
                at = at[np.argsort(word[at])]  # words in order have their classes in order
                w, o, t = word[at], one[at], two[at]
                ro, rt = now.r.take(o, 0), now.r.take(t, 0)
                q = np.empty((len(at), WIDTH + 1), np.float32)
                q[:, :WIDTH] = ro @ now.c[0] + rt @ now.c[1]
                q[:, WIDTH] = 1
                gq = self._contrast(now.out, self.states[1], self.noise[0], q, w)
                gq += self._contrast(now.up[:k], self.states[2][:k], self.noise[1], q, self.kind[w])
                gq += self._contrast(now.up[k:], self.states[2][k:], self.noise[2], q, self.kin[w])
                gq = np.ascontiguousarray(gq[:, :WIDTH])
                grad = np.stack([ro.T @ gq, rt.T @ gq]) / len(at)
                rows = np.concatenate([o, t])
                by = np.argsort(rows)
                self._move(now.r, self.states[0], rows[by], np.concatenate([gq @ now.c[0].T, gq @ now.c[1].T]).take(by, 0))
                self.state_c += grad * grad
                now.c -= RATE / 10 * grad / np.sqrt(self.state_c)

    def changes(self, begin: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, occurrences and changes of the rows that were met."""
        total = int(self.met.sum())
        n = np.concatenate([self.met, [total], begin.sums(self.met), np.full(WIDTH, total)])
        at = np.flatnonzero(n)
        return at, n[at], (self.now.rows()[at] - begin.rows()[at].astype(np.float32))


def refine(train: DataFrame, names: np.ndarray, begin: Vectors) -> Vectors:
    """The vectors after one pass over all training texts."""
    spark = train.sparkSession
    begin = begin.copy(np.float16)
    share, size = spark.sparkContext.broadcast((names, begin)), len(begin.r) + len(begin.up) + WIDTH
    width = 2 * WIDTH + 1

    def run(batches):
        claim("lm", lambda: None)
        (own, b0), got = share.value, None
        lookup, rare = Lookup(own), len(own)
        for whole in batches:
            for b in chunks(whole, "text"):
                got = got or Pass(b0, TaskContext.get().partitionId())
                h, first = tokens(b.column(0))
                w = lookup(h)
                w[w < 0] = rare
                got.learn(*contexts(w, first, rare + 1), w)
        if got:
            at, n, delta = got.changes(b0)
            del got
            for i in range(0, len(at), 8192):
                d = np.ascontiguousarray(delta[i : i + 8192].astype(np.float16)).view(np.uint8).reshape(-1)
                offsets = np.arange(0, len(d) + 1, 2 * width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 8192]), pa.array(n[i : i + 8192]), pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(d)])], ["place", "n", "delta"])

    def mean(batches):
        """Weighted means of each place's changes; all rows of a place are here."""
        total, weight = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if total is None:
                total, weight = np.zeros((size, width), np.float32), np.zeros(size)
            at, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            d = np.frombuffer(offsets_and_bytes(b.column(2))[1].tobytes(), np.float16).reshape(-1, width).astype(np.float32) * n[:, None].astype(np.float32)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
            total[at[order][first]] += np.add.reduceat(d[order], first, axis=0)
            weight += np.bincount(at, n, size)
        if total is not None:
            at = np.flatnonzero(weight)
            for i in range(0, len(at), 8192):
                rows = at[i : i + 8192]
                d = (total[rows] / weight[rows, None]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([x.tobytes() for x in d], pa.binary())], ["place", "delta"])

    moved = train.select("text").mapInArrow(run, "place long, n long, delta binary").repartition("place").mapInArrow(mean, "place long, delta binary").toArrow()
    delta = np.zeros((size, width), np.float32)
    for b in moved.to_batches():
        delta[b.column(0).to_numpy()] = np.frombuffer(offsets_and_bytes(b.column(1))[1].tobytes(), np.float16).reshape(-1, width)
    return begin.copy(np.float32).moved(delta).copy(np.float16)


@dataclass
class Model:
    """names: hashes of the words with vectors. head, counts: the most frequent words. N, V: training tokens, distinct ones."""

    names: np.ndarray
    head: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    vectors: Vectors

    @property
    def rare(self) -> tuple[int, int]:
        """Tokens and distinct tokens of the word "rare"."""
        named = self.counts[: len(self.names)]
        return self.n - int(named.sum()), self.v - len(self.names)


def train(rows: DataFrame, classes: int = START, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of all rows' texts, and the table of all their token counts."""
    counts, _ = cut(count_tokens(rows), "token_counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hashes, often = frequent(counts, head)
    names = hashes[: max(classes - 1, int((often >= LEAST).sum()))]
    own = often[: len(names)]
    begin = start(count_triples(rows, hashes[: classes - 1]), own, int(n) - int(own.sum()))
    return Model(names, hashes, often, int(n), int(v), refine(rows, names, begin)), counts


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fold_of: int = 10, classes: int = START) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Training texts are those whose crc32(id as text) mod fold_of is not 0. score is the model's log10 probability of
    the whole text with its end. Null texts count as empty: one end token. Ids may repeat or be null (never held out);
    rows are told apart by their place. Without training rows every count is 0. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), (fold(id_col, fold_of) == 0).alias("held_out"))
    model, counts = train(rows.where("not held_out"), classes)
    share = spark.sparkContext.broadcast(model)

    def run(batches):
        claim("lm", lambda: None)
        m: Model = share.value
        vectors = m.vectors.copy(np.float32)
        k, row = len(m.names) + 1, TaskContext.get().partitionId() << 40
        lookup = Lookup(m.head)
        base_of = np.append(np.log10(m.counts + SMOOTH), 0.0)
        for whole in batches:
            for b in chunks(whole, "text"):
                got, begin = tokens(b.column(1))
                at = lookup(got)
                cls = np.where((at >= 0) & (at < k - 1), at, k - 1)
                one, two = contexts(cls, begin, k)
                first = begin[:-1]
                total = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
                part = base_of[at]
                rare = cls == k - 1
                n = b.num_rows
                rid = np.arange(row, row + n)
                row += n
                out = {"rid": rid, "doc_id": b.column(0), "held_out": b.column(2), "n_tokens": np.diff(begin), "known": total((at >= 0).astype(np.int64)), "base": total(part), "rare": total(rare.astype(np.int64)), "model": total(vectors.log10(one, two, cls) + np.where(rare, part, 0.0))}
                of = np.repeat(np.arange(n), np.diff(begin))[at < 0]
                left = got[at < 0]
                order = np.lexsort((left, of))
                left, of = left[order], of[order]
                new = np.ones(len(left), bool)
                new[1:] = (left[1:] != left[:-1]) | (of[1:] != of[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(left)))
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out.values()] + [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], [*out, "h", "times"])
                if len(start):
                    z = len(start)
                    blank = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "rare": pa.int64(), "model": pa.float64()}
                    yield pa.RecordBatch.from_arrays([pa.array(rid[of[start]]), *(pa.nulls(z, t) for t in blank.values()), pa.array(left[start].view(np.int64)), pa.array(times)], [*out, "h", "times"])

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare long, model double, h long, times long"
    # both kinds of rows come from one written pass, so that a row keeps its number
    both, _ = cut(rows.mapInArrow(run, schema), "scored")
    n_rare, v_rare = model.rare
    c = F.coalesce("n", F.lit(0))
    rest = both.where("h is not null").select("rid", "h", "times").join(counts, "h", "left").groupBy("rid").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(c + SMOOTH)).alias("add"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    out = both.where("h is null").join(rest, "rid", "left")
    return out.select(
        "doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + zero("more")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("add") - F.col("n_tokens") * math.log10(model.n + SMOOTH * (model.v + 1))).alias("base_score"),
        (F.col("model") + zero("add") - F.col("rare") * math.log10(n_rare + SMOOTH * (v_rare + 1))).alias("score"),
    )
