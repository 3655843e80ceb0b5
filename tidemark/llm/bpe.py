"""Operator 6: byte-pair encoding and decoding by a prefix-sharing trie traversal.

For merges whose tokens all encode to themselves, the encoding of a prefix is the encoding of a shorter
prefix plus one last token, and that last token is the only vocabulary suffix that may stand behind the
shorter prefix's own last token. So one last token per trie node describes the encodings of all prefixes.
Distinct words are visited in sorted order, which is the depth-first order of their trie: the states of the
prefix that a word shares with the one before it are on the stack and computed once. Texts are cut into remembered
units first (see units), so only what a worker hasn't met goes through the trie.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from tidemark.llm.common import chunks, claim, offsets_and_bytes, tidy
from tidemark.llm.units import Units

#: Bytes of remembered pieces, with their ids, before a worker starts afresh; pieces of more than LONG bytes aren't remembered.
KNOWN_BYTES, LONG = 24 << 20, 200
#: Bytes of text that `encode` works on at once, fewer than elsewhere: its workers stand beside an executor that earlier stages have filled.
PART_BYTES = 512 << 10
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Cuts a text into the pieces that are encoded one by one: special tokens, and words between them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(PATTERN).findall
        self.old = set()
        self.specials = {x["content"]: x["id"] for x in json.loads(open(path, encoding="utf-8").read())["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")

    def words(self, text: str) -> list[str]:
        """Letters and numbers newer than Unicode 3.2 may class differently here and in the library; it then splits the text itself."""
        if not text.isascii():
            new = set(text) - self.old
            if new:
                known = {c for c in new if unicodedata.ucd_3_2_0.category(c) != "Cn"}
                self.old |= known
                if len(known) < len(new):
                    return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.specials):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.at_special.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out


class TrieEncoder:
    """Encodes distinct words in one depth-first walk of their trie."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.text_of: list[bytes] = [b""] * self.size
        for s, i in vocab.items():
            self.text_of[i] = as_bytes(s)
        for s, i in self.special.items():
            self.text_of[i] = s.encode()
        # rank of a token: that of the merge which makes it; single bytes come first
        self.rank = [-1] * self.size
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank[i, j] = r
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.may_follow: dict[int, bool] = {}
        self._suffixes({i: self.text_of[i] for i in vocab.values()})
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        sizes = np.array([len(x) for x in self.text_of], np.int64)
        self.sizes, self.starts = sizes, np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.pool = np.frombuffer(b"".join(self.text_of), np.uint8)

    def _suffixes(self, tokens: dict[int, bytes]) -> None:
        """The automaton of Aho and Corasick (1975) that gives the vocabulary's suffixes of a text, longest first.

        step: node and byte to the node of one byte more. back: the node of the longest proper suffix. top: the longest
        token that a node's string ends with. shorter: for a token, the next such token.
        """
        step: dict[int, int] = {}
        back, top = [0], [-1]
        level = [(0, t, x) for t, x in tokens.items()]
        ends = [0] * self.size
        depth = 0
        while level:
            made, on, own = [], [], {}
            for node, t, x in level:
                key = node << 8 | x[depth]
                new = step.get(key)
                if new is None:
                    step[key] = new = len(back)
                    back.append(-1)
                    top.append(-1)
                    made.append((node, x[depth], new))
                if len(x) == depth + 1:
                    ends[t], own[new] = new, t
                else:
                    on.append((new, t, x))
            for node, byte, new in made:
                while node:
                    node = back[node]
                    low = step.get(node << 8 | byte)
                    if low is not None:
                        back[new] = low
                        break
                else:
                    back[new] = 0
            for _, _, new in made:
                top[new] = own.get(new, top[back[new]])
            level, depth = on, depth + 1
        self.step, self.back, self.top = step, back, top
        self.shorter = [top[back[n]] for n in ends]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves a b as these two tokens.

        Both are undone merge by merge, latest first; at each moment the pair that meets at the border must not
        be one that BPE would have merged before the merge just undone.
        """
        if len(self.may_follow) > 300_000:
            self.may_follow.clear()
        rank, pairs = self.rank, self.pair_rank
        ok, undone = True, len(pairs)
        x, y = a, b
        while True:
            r = pairs.get((x, y))
            # of two merges of one rank the left one comes first, so a merge over the border beats an equal one on its right
            if r is not None and r < undone:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                undone, x = rx, self.right[x]
            else:
                undone, y = ry + 1, self.left[y]
        self.may_follow[a * self.size + b] = ok
        return ok

    def walk(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of each word; words must be sorted for prefixes to be shared."""
        step, back, top, shorter, width = self.step.get, self.back, self.top, self.shorter, self.size
        known, size = self.may_follow.get, self.sizes.tolist()
        # for the first i bytes on the path: the last token of their encoding, and the automaton's node
        last: list[int] = [-1]
        nodes: list[int] = [0]
        before = b""
        for w in words:
            n, shared, most = len(w), 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            node = nodes[-1]
            for i in range(shared, n):
                byte = w[i]
                new = step(node << 8 | byte)
                while new is None:
                    node = back[node]
                    new = step(node << 8 | byte)
                nodes.append(node := new)
                t = top[node]
                while at := i + 1 - size[t]:
                    a = last[at]
                    ok = known(a * width + t)
                    if ok is None:
                        ok = self.follows(a, t)
                    if ok:
                        break
                    t = shorter[t]
                last.append(t)
            before = w
            out, i = [], n
            while i:
                out.append(t := last[i])
                i -= size[t]
            out.reverse()
            yield out

    def encode(self, pieces: Iterable[str], remember: bool = True) -> dict[str, bytes]:
        """Ids of the distinct pieces, as little-endian unsigned 32-bit integers; short ones are remembered."""
        known = self.known
        if self.known_bytes > KNOWN_BYTES:
            known.clear()
            self.known_bytes = 0
        distinct = set(pieces)
        out = {w: known[w] for w in distinct & known.keys()} | {s: np.uint32(i).tobytes() for s, i in self.special.items()}
        new = sorted(distinct.difference(out))  # in order of code points, which is the order of their bytes
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, ids in zip(new, coded, self.walk(coded), strict=True):
            out[w] = got = struct.pack(f"<{len(ids)}I", *ids)
            if remember and len(b) <= LONG:
                known[w] = got
                self.known_bytes += 150 + len(b) + len(got)  # with what Python needs for two strings and a place
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 bytes that the ids stand for."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.starts[ids] - (ends - size), size)
        return self.pool[at + np.arange(len(at))]


class Encoder:
    """Texts of a column to ids: units found by numpy over the bytes of many texts, new ones encoded along their trie."""

    def __init__(self, path: str):
        self.split, self.trie = Splitter(path), TrieEncoder(path)
        self.units = Units(self.learn, self.whole, list(self.split.specials))

    def learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = list(map(self.split.words, units))
        ids = self.trie.encode(chain.from_iterable(pieces), remember=False)
        found = [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in pieces]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def whole(self, text: str) -> np.ndarray:
        pieces = self.split(text)
        ids = self.trie.encode(pieces)
        return np.frombuffer(b"".join([ids[w] for w in pieces]), "<u4")

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin; one more entry than texts."""
        ids, lengths = self.units(col)
        return ids, np.concatenate(([0], np.cumsum(lengths)))


@lru_cache(2)
def _worker(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(path: str, docs: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    ids, at = _worker(path)(pa.array(docs, pa.string()))
    return [ids[a:z].astype("<u4").tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """df with a column of token ids (array<int>), and if named one that tells whether they decode to the text again.

    Columns of these names give way. A null text has no ids, as an empty one. Special tokens in a text become their
    own ids. Rows stay where they are: no shuffle. A worker's memory is bounded by units.MEMORY and units.POOL,
    KNOWN_BYTES and one Arrow batch, so by the longest text and not by their number. Repeated rows give repeated results,
    an empty table none.
    """
    df = df.drop(*(c for c in (ids, round_trip) if c and c != text))
    schema = StructType(list(df.schema.fields)).add(ids, ArrayType(IntegerType()))
    if round_trip:
        schema = schema.add(round_trip, BooleanType())

    def run(batches):
        claim("bpe", _worker.cache_clear)
        for whole in batches:
            for b in chunks(whole, text, PART_BYTES):
                col = b.column(b.schema.get_field_index(text))
                flat, ends = _worker(path)(col)
                more, names = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)))], [ids]
                if round_trip:
                    trie = _worker(path).trie
                    sizes = np.concatenate(([0], np.cumsum(trie.sizes[flat])))[ends]
                    back = trie.decode(flat).tobytes()
                    off, data = offsets_and_bytes(col)
                    text_bytes = data.tobytes()
                    more.append(pa.array([back[p:q] == text_bytes[x:y] for p, q, x, y in zip(sizes[:-1].tolist(), sizes[1:].tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]))
                    names.append(round_trip)
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *names])
            whole = b = col = None  # gone before the next batch is read

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that each row's ids stand for, in place of any column of that name; null ids give null."""
    df = df.drop(text) if ids != text else df
    schema = StructType(list(df.schema.fields)).add(text, StringType())

    def run(batches):
        claim("bpe", _worker.cache_clear)
        trie = _worker(path).trie
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                col = b.column(b.schema.get_field_index(ids))
                out = [trie.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)).tobytes().decode("utf-8", "replace") if x.is_valid else None for x in col]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text])
            tidy()

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the text that they decode to, for each row of (doc_id, text).

    Null and empty texts have no ids; repeated rows give repeated results, an empty table none. Ids may be null. Other
    columns are not looked at.
    """

    def run(batches):
        claim("bpe", _worker.cache_clear)
        encoder = _worker(path)
        for whole in batches:
            for b in chunks(whole, "text"):
                flat, ends = encoder(b.column(1))
                back = encoder.trie.decode(flat)
                cuts = np.concatenate(([0], np.cumsum(encoder.trie.sizes[flat])))[ends]
                flat, sent, coded = flat.astype("<u4"), [], []
                for a, z, p, q in zip(ends[:-1].tolist(), ends[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    sent.append(hashlib.sha256(flat[a:z]).hexdigest())
                    # bytes that aren't UTF-8 would decode to U+FFFD
                    coded.append(hashlib.sha256(back[p:q].tobytes().decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends)), pa.array(sent), pa.array(coded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
