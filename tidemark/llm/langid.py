"""Operator 5: language of a text by interpolated Kneser-Ney character models.

A text's words are its runs of letters with their combining marks, lowered; each is scored as a character sequence between spaces, with no
context beyond. For each order the discounted probabilities and back-off weights of all languages stand in arrays
sorted by n-gram hash. The language with the lowest cross-entropy per character wins. Words recur, so each worker
scores a distinct word once and then adds up rows.

The models are fitted on whole texts of a bounded sample of labelled training rows, SAMPLE per language in
expectation, drawn by text hash. Everything else covers all rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, claim, fold, texts, tidy
from tidemark.llm.words import Lookup, mix

ORDER = 4
SAMPLE = 1200
LANGUAGES = 1000
MEMORY = 400_000
#: Words whose n-grams are taken at once, and bytes of text: a worker stands beside an executor that earlier stages have filled.
WORDS, PART_BYTES = 5_000, 512 << 10
#: Bytes of the fitted model in a row on its way to the driver.
PIECE = 16 << 20

#: A letter, then letters and the marks that combine with them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: A text is rejected if its cross-entropy has gone this part of the way from its language's usual one to that of the
#: language's words with their letters shuffled, four spreads for its length left aside.
SLACK = 0.6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each place of "   word ", words side by side; the word's number at a place, -1 in the lead."""
    lead = " " * (ORDER - 1)
    codes = np.frombuffer((lead + (" " + lead).join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64) + ORDER
    of = np.repeat(np.arange(len(words)), sizes)
    of[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < ORDER - 1] = -1
    out = [mix(codes + np.uint64(1))]
    for _ in range(ORDER - 1):
        longer = out[-1].copy()
        longer[1:] = mix(out[-1][:-1] * _STEP + out[0][1:])
        # h(a b c) from h(a b) and c; the first places have no such n-gram and lie in a lead
        out.append(longer)
    return out, of


@dataclass
class Model:
    languages: list[str]
    prob: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted n-gram hashes, discounted probability [n-gram, language]
    back: list[tuple[np.ndarray, np.ndarray]]  # by order from 2: sorted context hashes, back-off weight [context, language]
    floor: np.ndarray  # probability of any character, by language
    usual: np.ndarray  # mean cross-entropy of training texts, and its spread for one character
    spread: np.ndarray
    shuffled: np.ndarray  # cross-entropy of its words with shuffled letters


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        n = len(model.languages)
        self.prob = [(Lookup(h), np.vstack([p, np.zeros((1, n), np.float32)])) for h, p in model.prob]
        self.back = [(Lookup(h), np.vstack([g, np.ones((1, n), np.float32)])) for h, g in model.back]
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, n), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word with its end, by language."""
        out = np.zeros((len(words), len(self.m.languages)), np.float32)
        for a in range(0, len(words), WORDS):
            part = words[a : a + WORDS]
            g, of = grams(part)
            at = np.flatnonzero(of >= 0)
            p = np.repeat(self.m.floor[None, :], len(at), 0).astype(np.float32)
            for order in range(ORDER):
                if order:
                    find, weight = self.back[order - 1]
                    p *= weight[find(g[order - 1][at - 1])]
                find, mass = self.prob[order]
                p += mass[find(g[order][at])]
            logs = np.log(np.maximum(p, 1e-12))
            starts = np.flatnonzero(np.diff(of[at], prepend=-1))
            out[a : a + len(part)] = np.add.reduceat(logs, starts, axis=0)
        return out

    def texts(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probability [text, language], and characters scored."""
        if len(self.known) > MEMORY:
            self.known.clear()
            self.rows = self.rows[:0]
        found = [LETTERS.findall(t.lower()) for t in docs]
        new = list({w for ws in found for w in ws}.difference(self.known))
        if new:
            base = len(self.known)
            self.known.update((w, base + i) for i, w in enumerate(new))
            self.rows = np.vstack([self.rows, self.words(new)])
        total = np.zeros((len(docs), len(self.m.languages)))
        chars = np.zeros(len(docs), np.int64)
        get = self.known.__getitem__
        for i, ws in enumerate(found):
            if ws:
                total[i] = self.rows[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
                chars[i] = sum(map(len, ws)) + len(ws)
        return total, chars


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces (rows of a place's n-grams by order and then their contexts, weights) one row for each longest n-gram, which fixes the others, with its whole weight."""
    rows, weight = np.hstack([r for r, _ in parts]), np.concatenate([w for _, w in parts])
    _, first, inverse = np.unique(rows[ORDER - 1], return_index=True, return_inverse=True)
    return rows[:, first], np.bincount(inverse, weight)


def _places(count: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of the words, as _distinct gives them; the context of an order stands ORDER - 1 rows below its n-gram."""
    words, weights = list(count), np.array(list(count.values()), np.float64)
    held = np.zeros((2 * ORDER - 1, 0), np.uint64), np.zeros(0)
    for a in range(0, len(words), WORDS):
        g, of = grams(words[a : a + WORDS])
        at = np.flatnonzero(of >= 0)
        new = _distinct([(np.stack([*(x[at] for x in g), *(x[at - 1] for x in g[:-1])]), weights[a + of[at]])])
        held = _distinct([held, new])
    return held


def fit(samples: dict[str, list[str]]) -> Model:
    """samples: texts by language. Kneser-Ney counts come from the distinct words weighted by their occurrences."""
    languages = sorted(samples)
    n = len(languages)
    tables = []
    for lang in languages:
        count: dict[str, int] = {}
        for t in samples[lang]:
            for w in LETTERS.findall(t.lower()):
                count[w] = count.get(w, 0) + 1
        tables.append(_places(count))
    alpha, gamma = [], []
    floor = np.zeros(n)
    alphabet = max(2, len(np.unique(np.concatenate([g[0] for g, _ in tables])))) if tables else 2
    for order in range(ORDER):
        keys = np.unique(np.concatenate([g[order] for g, _ in tables])) if tables else np.zeros(0, np.uint64)
        mass = np.zeros((len(keys), n), np.float32)
        contexts = np.unique(np.concatenate([g[ORDER - 1 + order] for g, _ in tables])) if order and tables else np.zeros(1, np.uint64)
        left = np.ones((len(contexts), n), np.float32)
        for j, (g, weight) in enumerate(tables):
            if not len(weight):
                continue
            here = g[order]
            if order == ORDER - 1:
                own, first, inverse = np.unique(here, return_index=True, return_inverse=True)
                c = np.bincount(inverse, weight)
            else:  # in how many left neighbours the n-gram continues
                longer, at_longer = np.unique(g[order + 1], return_index=True)
                own, first, inverse = np.unique(here[at_longer], return_index=True, return_inverse=True)
                first = at_longer[first]
                c = np.bincount(inverse).astype(float)
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            ctx = g[ORDER - 1 + order][first] if order else np.zeros(len(own), np.uint64)
            names, where = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(where, c), np.bincount(where)
            mass[np.searchsorted(keys, own), j] = np.maximum(c - d, 0) / total[where]
            left[np.searchsorted(contexts, names), j] = np.minimum(1, d * kinds / total)
            if order == 0:
                floor[j] = d * kinds[0] / total[0] / (alphabet + 1)
        alpha.append((keys, mass))
        if order:
            gamma.append((contexts, left))
    floor[floor == 0] = 1 / (alphabet + 1)
    model = Model(languages, alpha, gamma, floor, np.zeros(n), np.ones(n), np.ones(n))
    scorer = Scorer(model)
    for j, lang in enumerate(languages):
        scored = [scorer.texts(samples[lang][a : a + 100]) for a in range(0, max(1, len(samples[lang])), 100)]
        total, chars = (np.concatenate(x) for x in zip(*scored, strict=True))
        keep = chars > 0
        if keep.any():
            h = -total[keep, j] / chars[keep]
            model.usual[j] = np.average(h, weights=chars[keep])
            model.spread[j] = max(1e-3, np.sqrt(np.mean((h - model.usual[j]) ** 2 * chars[keep])))
            rng = np.random.default_rng(3)
            words = sorted({w for t in samples[lang] for w in LETTERS.findall(t.lower())})[:: max(1, len(samples[lang]) // 50)]
            mixed = ["".join(rng.permutation(list(w))) for w in words]
            model.shuffled[j] = max(model.usual[j] + 0.5, -scorer.words(mixed)[:, j].sum() / (sum(map(len, mixed)) + len(mixed)))
    return model


def _far(model: Model, j, h: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Whether a text is too unlikely even in its best language."""
    return h - 4 * model.spread[j] / np.sqrt(chars) > model.usual[j] + SLACK * (model.shuffled[j] - model.usual[j])


def train(docs: DataFrame, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """Fit, in one task, on a sample of rows with text and language; rare languages give all their rows.

    More than LANGUAGES languages are an error: the model's arrays have a column for each of them.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    pick = F.lit(False)
    for r in sizes:
        pick = pick | ((F.col("lang") == r["lang"]) & (place < int(min(1.0, sample / r["count"]) * (1 << 20))))
    names = [r["lang"] for r in sizes]
    if not names:
        return fit({})

    def learn(batches):
        """The model, pickled, in numbered pieces."""
        claim("langid", lambda: None)
        samples: dict[str, list[str]] = {k: [] for k in names}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                samples[k].append(t)
        data = pickle.dumps(fit({k: sorted(v) for k, v in samples.items()}), pickle.HIGHEST_PROTOCOL)
        samples.clear()
        tidy()
        for i, at in enumerate(range(0, len(data), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data[at : at + PIECE]], pa.binary())], ["i", "piece"])

    # one task fits, as the sample is bounded: the driver gets the model alone
    got = rows.where(pick).dropDuplicates(["text", "lang"]).select("lang", "text").repartition(1).mapInArrow(learn, "i long, piece binary").collect()
    return pickle.loads(b"".join(r["piece"] for r in sorted(got, key=lambda r: r["i"]))) if got else fit({k: [] for k in names})


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs, then lang_pred, score, cross_entropy and rejected, for every row.

    lang_pred is `und`, score 0 and rejected true where the text is null or has no letter, or no language was
    learned. score is the winner's share of the likelihoods per 40 characters. rejected is also true for texts about as
    unlikely in their best language as words of shuffled letters. Ties go to the first language in
    alphabetical order. A kept column with a result's name gives way to the result.
    """
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    share = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        claim("langid", lambda: None)
        m: Model = share.value
        scorer = Scorer(m)
        for whole in batches:
            for b in chunks(whole, "__text", PART_BYTES):
                total, chars = scorer.texts(texts(b.column(b.num_columns - 1)))
                n = b.num_rows
                if m.languages:
                    best = total.argmax(1)
                    h = -total[np.arange(n), best] / np.maximum(1, chars)
                    gap = (total - total[np.arange(n), best][:, None]) * (np.minimum(40, chars) / np.maximum(1, chars))[:, None]
                    sure = 1 / np.exp(np.maximum(gap, -50)).sum(1)
                    far = _far(m, best, h, np.maximum(1, chars))
                    names = [m.languages[j] if c else "und" for j, c in zip(best, chars, strict=True)]
                else:
                    h, sure, far, names = np.zeros(n), np.zeros(n), np.ones(n, bool), ["und"] * n
                none = chars == 0
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(none, 0.0, sure)), pa.array(np.where(none, 0.0, h)), pa.array(far | none)], [*b.schema.names[:-1], *new])
            whole = b = None  # gone before the next batch is read

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType(source.schema.fields[:-1] + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("cross_entropy", DoubleType()), StructField("rejected", BooleanType())])
    return source.mapInArrow(run, schema)


def predict(docs: DataFrame, fold_of: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; learned from the rows outside the held-out fold.

    Null ids are never held out. Texts without a letter are `und` with score 0, as all are where no row has a language.
    Ties in likelihood go to the first language in alphabetical order. Repeated rows give repeated results, an empty
    table none. Whole texts are read, in slices of many texts or one long one. Other columns are not looked at.
    """
    out = fold("doc_id", fold_of) == held
    model = train(docs.where(~out), "text", "lang")
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
