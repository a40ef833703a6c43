"""Byte-pair encoding by a pair occurrence index, and decoding.

White-space-separated chunks are encoded once for each batch of rows. All new chunks of a batch lie in one flat symbol list;
an index maps each adjacent pair to all its positions in that list. The active ranks come off a heap in ascending order; all
positions of the pair are merged from left to right, and the lists of the neighbouring pairs are updated. A chunk's result
is the same as that of merging each word by itself, as pairs never cross a word.

The vocabulary file is read on the driver and broadcast; its size is fixed by the file (1.7 MB), not by the data.

Defined cases: a null or empty text has no tokens; repeated rows are encoded each; extra columns are ignored; texts of any
length are encoded whole; rows with a null id keep it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallygrove.llm import vec

#: Fixed value: the white space of the tokenizer's ``\s``. Python's own also counts the separators 1C to 1F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(f"[{WHITE}]+")
#: Characters of chunks whose ids a task keeps between batches, about.
CACHE_CHARS = 5_000_000

COLUMNS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordBpe:
    """A BPE with word ends: lower case, white space dropped, as the vocabulary file says."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, normalizer = spec["model"], (spec["normalizer"] or {}).get("normalizers", [])
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or [x["type"] for x in normalizer] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("not a word BPE: NFC, lower case, a pattern split and byte letters are expected")
        split, level = steps
        if split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("not a word BPE: words are what the pattern finds")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        self.rank, self.merged = {}, {}
        for i, (a, b) in enumerate(model["merges"]):
            pair = (vocab[a], vocab[b])
            self.rank[pair], self.merged[pair] = i, vocab[a + b]
        letters = byte_letters()
        self.inner, self.last = [vocab[x] for x in letters], [vocab[x + self.end] for x in letters]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs = {r: p for p, r in self.rank.items()}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cached = 0

    def normal(self, text: str) -> str:
        """NFC, then each character's own lower case (so sigma has no final form)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        text = self.normal(text)
        return [x for x in _SPLIT.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word, all merged at once over one pair occurrence index."""
        symbol: list[int] = []
        after: list[int] = []
        ends: list[int] = []  # of each word, as a place in symbol
        for word in words:
            raw = word.encode()
            at = len(symbol)
            symbol.extend(map(self.inner.__getitem__, raw))
            symbol[-1] = self.last[raw[-1]]
            after.extend(range(at + 1, at + len(raw)))
            after.append(-1)
            ends.append(len(symbol))
        before = [-1] * len(symbol)
        rank, index = self.rank, {}
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
                r = rank.get((symbol[i], symbol[j]))
                if r is not None:
                    index.setdefault(r, []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            places = index.pop(r, None)
            if not places:
                continue
            (a, b), new = self.pairs[r], self.merged[self.pairs[r]]
            places.sort()
            for i in places:
                j = after[i]
                if symbol[i] != a or j < 0 or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    s = rank.get((new, symbol[k]))
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(active, s)
                h = before[i]
                if h >= 0:
                    s = rank.get((symbol[h], new))
                    if s is not None:
                        if s in index:
                            index[s].append(h)
                        else:
                            index[s] = [h]
                            heapq.heappush(active, s)
        out, at = [], 0
        for end in ends:
            out.append(tuple(x for x in symbol[at:end] if x >= 0))
            at = end
        return out

    def forget(self) -> None:
        self.cache, self.cached = {}, 0

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        if self.cached > CACHE_CHARS:
            self.forget()
        parts: list[list] = []  # of each text: lists of chunks, and ids of special tokens
        new: set[str] = set()
        cache = self.cache
        for text in texts:
            pieces = self.special_at.split(text) if "<|" in text and self.special_at else [text]
            parts.append(own := [self.special[p] if p in self.special else self.chunks(p) for p in pieces])
            for p in own:
                if not isinstance(p, int):
                    new.update(p)
        new.difference_update(cache)
        self.cached += sum(map(len, new))
        # Words come with many kinds of marks: each is merged once, and kept as the chunk that it is alone.
        split = {x: self.word.findall(x) for x in new}
        fresh = list(set(chain.from_iterable(split.values())).difference(cache))
        cache.update(zip(fresh, self.merge_all(fresh), strict=True))
        cache.update((x, tuple(chain.from_iterable(map(cache.__getitem__, own)))) for x, own in split.items() if len(own) != 1 or own[0] != x)
        for own in parts:
            yield list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(cache.__getitem__, p)) for p in own))

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between them, word ends shown: the vocabulary names no decoder that would join them."""
        return " ".join(map(self.token.__getitem__, ids))


_loaded: dict[int, WordBpe] = {}


def _model(raw: bytes) -> WordBpe:
    """One for each worker process and vocabulary."""
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(raw)
    return _loaded[key]


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("n_tokens", "ids"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``key`` and the named ``columns`` of COLUMNS."""
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [docs.select(key).schema[0], *(T.StructField(c, COLUMNS[c]) for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(vocabulary.value)
        number = {i: str(i) for i in bpe.token}
        for batch in vec.parts(batches, 1):
            out: dict[str, list] = {c: [] for c in columns}
            for ids in bpe.encode_batch([x or "" for x in batch.column(1).to_pylist()]):
                plain = bpe.decode(ids) if "decoded" in out or "decoded_sha256" in out else ""
                for c, into in out.items():
                    if c == "n_tokens":
                        into.append(len(ids))
                    elif c == "ids":
                        into.append(ids)
                    elif c == "ids_sha256":
                        into.append(hashlib.sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest())
                    elif c == "decoded":
                        into.append(plain)
                    else:
                        into.append(hashlib.sha256(plain.encode()).hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], kinds.get(c, pa.string())) for c in columns)], [key, *columns])
        bpe.forget()  # a worker that waits for its next task holds no texts

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
