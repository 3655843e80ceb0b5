"""Learned and iterative operators against plain versions of their rules, in dictionaries and loops."""

import math
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from test_corpus_ops import BPE, components, docs_of, prose  # noqa: E402


def fold(i, of):
    return zlib.crc32(str(i).encode()) % of


class PlainKneserNey:
    """Interpolated Kneser-Ney over characters of words between spaces, a language at a time."""

    def __init__(self, texts, alphabet):
        self.counts, self.alphabet = [{} for _ in range(4)], alphabet
        for t in texts:
            for w in t.split():
                for g in self.grams(w):
                    self.counts[3][g] = self.counts[3].get(g, 0) + 1
        for order in (2, 1, 0):
            for g in {g[-order - 2 :] for g in self.counts[3]}:
                self.counts[order][g[1:]] = self.counts[order].get(g[1:], 0) + 1
        self.discount, self.total, self.kinds = [], [], []
        for c in self.counts:
            once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            self.discount.append(min(0.95, max(0.1, once / max(1, once + 2 * twice))))
            total, kinds = {}, {}
            for g, x in c.items():
                total[g[:-1]] = total.get(g[:-1], 0) + x
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            self.total.append(total)
            self.kinds.append(kinds)

    @staticmethod
    def grams(word):
        s = f"   {word} "
        return [s[i - 3 : i + 1] for i in range(3, len(s))]

    def p(self, g):
        p = self.discount[0] * self.kinds[0][""] / self.total[0][""] / (self.alphabet + 1)
        for order in range(4):
            own = g[3 - order :]
            ctx = own[:-1]
            if order and ctx in self.total[order]:
                p *= min(1, self.discount[order] * self.kinds[order][ctx] / self.total[order][ctx])
            if own in self.counts[order]:
                p += max(0, self.counts[order][own] - self.discount[order]) / self.total[order][ctx]
        return p

    def log(self, text):
        return sum(math.log(self.p(g)) for w in text.split() for g in self.grams(w))


def test_language_id_matches_plain_kneser_ney(spark):
    from tidemark.llm import langid

    rng = random.Random(8)
    letters = {"a": "aeilmnorst", "b": "aeilnopstu", "c": "bdeghiklnr"}  # much in common: short texts are doubtful
    word = lambda g: "".join(rng.choice(letters[g]) for _ in range(rng.randrange(1, 7)))
    langs = [rng.choice("abc") for _ in range(150)]
    texts = [" ".join(word(g) for _ in range(rng.randrange(1, 20))) for g in langs]
    rows = [(i, t, None if i % 11 == 0 else g) for i, (t, g) in enumerate(zip(texts, langs, strict=True))]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    train = {g: sorted({t for i, t, x in rows if x == g and fold(i, 4) != 2}) for g in "abc"}
    alphabet = len({c for ts in train.values() for t in ts for w in t.split() for c in w + " "})
    models = {g: PlainKneserNey(ts, alphabet) for g, ts in train.items()}
    for i, t, _ in rows:
        logs = {g: m.log(t) for g, m in models.items()}
        best = max(sorted(logs), key=logs.get)
        chars = sum(len(w) + 1 for w in t.split())
        share = 1 / sum(math.exp((x - logs[best]) * min(40, chars) / chars) for x in logs.values())
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(share, abs=1e-3), i


def plain_features(text, common):
    b = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", b.lower()) if w]
    if not words:
        return [0.0] * 20
    n, w = len(b), len(words)
    count = lambda chars: sum(x in chars for x in b)
    lower, upper, digits = (count(range(*r)) for r in ((97, 123), (65, 91), (48, 58)))
    lines, blanks, marks, far = count(b"\n\x0b\x0c\r"), count(b"\t "), count(b".,;:'\"()-?"), count(range(128, 256))
    other = n - lower - upper - digits - lines - blanks - marks - far
    up, other = upper / max(1, lower + upper), other / n
    repeat = sum(x == y for x, y in zip(words, words[1:], strict=False)) / w
    twice = 1 - len(set(zip(words, words[1:], strict=False))) / (w - 1) if w > 1 else 0.0
    usual = sum(x in common for x in words) / w
    bent = [math.sqrt(x) for x in (up, other, repeat, twice)] + [min(1, x / 0.3) for x in (up, usual)] + [min(1, x / 0.02) for x in (other, repeat)]
    return [up, marks / n, other, repeat, twice, usual, digits / n, lines / w, far / n, *bent, math.log1p(w), min(40, n / w) / 10, len(set(words)) / w]


def test_quality_matches_all_pairs_ranking(spark):
    from tidemark.llm import quality

    rng = random.Random(9)
    noisy = lambda n, share: " ".join(rng.choice(["BUY!!", "$$$ 99", "win win"]) if rng.random() < share else rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(9)) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    label = [rng.randrange(2) for _ in range(240)]
    texts = [noisy(rng.randrange(20, 80), rng.uniform(0.0, 0.35) if g else rng.uniform(0.2, 0.7)) for g in label]
    label[5], label[6] = 1 - label[5], 1 - label[6]
    texts += ["", "naïve É", "x"]
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(label)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.predict(docs_of(spark, texts), labels).collect()}
    learn = [i for i in range(len(texts)) if fold(i, 4) != 2]
    words = {w for i in learn for w in re.split(rb"[\x20\x09-\x0d]+", texts[i].encode().lower())}
    assert len(words) <= quality.COMMON  # so that all are common words
    x = np.array([plain_features(t, words) for t in texts])
    known = [i for i in learn if i < len(label)]
    z = ((x - x[known].mean(0)) / np.maximum(1e-6, x[known].std(0))).clip(-8, 8)
    good, poor = [i for i in known if label[i]], [i for i in known if not label[i]]
    d = (z[good][:, None] - z[poor][None]).reshape(-1, z.shape[1])  # every pair, where the operator draws PAIRS of them
    w = np.zeros(d.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ p / len(d) - 1e-3 * w)
    raw = z @ w
    score = np.array([got[i]["score"] for i in range(len(texts))])
    logit = np.log(score / (1 - score))
    inside = (score > 1e-12) & (score < 1 - 1e-12)
    assert inside.sum() > 200 and np.corrcoef(raw[inside], logit[inside])[0, 1] > 0.995

    def right(cut, values):
        return np.mean(values[good] >= cut) + np.mean(values[poor] < cut)

    kept = [i for i in known if got[i]["predicted"]]
    assert kept and right(quality.CUT, score) >= max(right(c, logit) for c in logit[known]) - 1e-9
    best = max(right(c, raw) for c in raw[known])  # no cut between two texts separates the labels better
    assert right(quality.CUT, score) >= best - 0.03


def test_quality_keeps_the_text_at_the_threshold(spark):
    """Labels that features tell apart cost no good text, and where they tell nothing apart all texts tie with the cut."""
    from tidemark.llm import quality

    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(20, 90)) for _ in range(90)] + [("LOUD!! " * rng.randrange(20, 90)).strip() for _ in range(30)]
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(120)], "doc_id long, quality int")
    docs = docs_of(spark, texts)
    got = quality.rate(docs, quality.train(docs, labels), keep=["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in got if r["predicted"]) == list(range(90))
    same = docs_of(spark, ["the same text"] * 40)
    got = quality.rate(same, quality.train(same, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")), keep=["doc_id"]).collect()
    assert {r["predicted"] for r in got} == {1}


def plain_differencing(sizes, k):
    """Sums of Karmarkar-Karp for k parts; partial partitions in a list, searched whole for the two of largest spread."""
    held = [([s] + [0] * (k - 1), i) for i, s in enumerate(sizes)]
    number = len(held)
    while len(held) > 1:
        held.sort(key=lambda x: (x[0][-1] - x[0][0], x[1]))
        (a, _), (b, _) = held[:2]
        held[:2] = [(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), number := number + 1)]
    return held[0][0]


def test_shards_match_plain_differencing(spark):
    from tidemark.llm import shards

    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(150)]
    texts += [texts[0]] * 7 + [texts[1]] * 3 + [None, "", None]
    got = shards.assign(docs_of(spark, texts), chunks=1 << 20).collect()  # each group is an item
    total, groups = [0] * 8, {}
    for r in got:
        total[r["shard"]] += r["size"]
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    assert sorted(total, reverse=True) == plain_differencing(list(groups.values()), 8)
    sizes = [rng.randrange(1, 50) for _ in range(60)]  # many ties
    of = shards.differencing(np.array(sizes), 5)
    assert sorted(np.bincount(of, sizes, 5).astype(int).tolist(), reverse=True) == plain_differencing(sizes, 5)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def test_pipeline_after_the_learned_stages_matches_brute_force(spark, tmp_path):
    import corpus_pipeline
    import tokenizers

    rng = random.Random(13)
    english = "the of and to in that with was for reading thing other".split()
    new = lambda n: [rng.choice(english) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n)]
    texts = [new(60) for _ in range(70)]
    for i in range(50):  # copies with one to eight words changed, of copies too
        t = list(rng.choice(texts))
        for at in rng.sample(range(len(t)), rng.randrange(1, 9)):
            t[at] = rng.choice(english) + "er"
        texts.append(t)
    items = [new(14), new(6)]
    for item in items:
        for i in rng.sample(range(len(texts)), 6):
            texts[i] = texts[i][:20] + item + texts[i][20:]
    poor = [[rng.choice(english).upper() + "!!"] * 40 for _ in range(40)]
    texts = [" ".join(t) + "." for t in texts] + [" ".join(t) for t in poor] + [None, "", "12 34"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(k < 120), 0) for k, i in enumerate(ids[:160])], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, str(tmp_path))
    kept = sorted((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect())
    assert {i for i, _ in kept} >= set(ids[:120]) and not {i for i, _ in kept} & set(ids[120:])
    first = {}
    for (i, _), (_, root) in zip(kept, components([t for _, t in kept], 5, 80, 100), strict=True):
        first.setdefault(root, i)
    texts_of = dict(kept)
    windows = {tuple(w[a : a + 10]) for w in map(words_of, [" ".join(t) for t in items]) for a in range(max(1, len(w) - 9))}
    clean = lambda t: not any(tuple(w[a : a + len(g)]) == g for w in [words_of(t)] for g in windows for a in range(len(w)))
    want = [i for i in first.values() if clean(texts_of[i])]
    assert len(first) < len(kept) and len(want) < len(first) and sorted(got) == sorted(want)
    tok = tokenizers.Tokenizer.from_file(BPE)
    tok.no_truncation()
    tok.no_padding()
    for i in want:
        assert got[i]["ids"] == tok.encode(texts_of[i], add_special_tokens=False).ids
