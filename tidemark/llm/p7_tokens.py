"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Speculate and verify: greedy longest-match proposes the tokens of a word; vectorised compatibility checks test every
pair of neighbours; only words with a failing pair undergo exact merging. A proposal whose neighbours are all compatible
is the BPE result, since merging is a function of the word and every pair on its own merges to itself.

Texts are cut into chunks at blanks, which no token crosses but as its first byte, and each distinct chunk is encoded
once a worker; a text's ids are then gathered with array operations. Null and empty texts give an empty list. Strings of
special tokens are ordinary text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: White space by Unicode, as the tokenizer's pattern sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct chunks kept by a worker; beyond, it starts anew, which costs time but changes nothing.
CACHED_CHUNKS = 1_000_000
#: Pairs of tokens whose compatibility a worker remembers.
CACHED_PAIRS = 2_000_000
#: Characters encoded together.
BLOCK_CHARS = 4_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that the file writes for bytes: visible Latin-1 characters for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeEncoder:
    """Byte-level BPE of words by greedy proposal, pair checks and exact merging of the words that fail."""

    def __init__(self, path: str = TOKENIZER) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.by_bytes = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.longest = max(map(len, self.by_bytes))
        size = max(vocab.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.order = np.full(size, -1, np.int64)  # when a token is made; single bytes before all merges
        pairs = np.empty(len(merges), np.int64)
        made = np.empty(len(merges), np.int64)
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pairs[k], made[k] = x << 32 | y, z
            self.merge_of[x, y] = (k, z)
            self.left[z], self.right[z], self.order[z] = x, y, k
        by = np.argsort(pairs)
        self._pairs, self._pair_order = pairs[by], by
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self._splitter = ByteLevel(add_prefix_space=False)  # the tokenizer's own cut into words

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, end = [], 0, len(word)
        get = self.by_bytes.get
        while at < end:
            for stop in range(min(end, at + self.longest), at, -1):
                token = get(word[at:stop])
                if token is not None:
                    break
            out.append(token)
            at = stop
        return out

    def check_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, encoded together, gives just that pair.

        The merges that made a's right edge and b's left edge are undone step by step, the latest first. If at any
        time the two edge tokens could have merged across the border earlier than the step just undone, the pair
        can't stand. Ties in time fall to the left, where merging goes first.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        never = np.iinfo(np.int64).max
        limit = np.full(len(a), never)
        left_edge = np.zeros(len(a), bool)  # the step just undone was on the right token: it loses a tie to the border
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            joins = np.where(self._pairs[at] == key, self._pair_order[at], never)
            bad = (joins < limit) | ((joins == limit) & left_edge & (joins != never))
            ok[live[bad]] = False
            ox, oy = self.order[x], self.order[y]
            stay = ~bad & ((ox >= 0) | (oy >= 0))
            live, x, y, ox, oy = live[stay], x[stay], y[stay], ox[stay], oy[stay]
            undo_left = ox > oy  # of equal steps the left one happened first, so the right one is undone first
            limit = np.where(undo_left, ox, oy)
            left_edge = ~undo_left
            x = np.where(undo_left, self.right[x], x)
            y = np.where(undo_left, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, of equal ones the leftmost. Parts are linked and pairs wait in a heap, so a word of n bytes takes n log n steps."""
        parts = [self.by_bytes[word[i : i + 1]] for i in range(len(word))]
        rule = self.merge_of
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(*rule[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in rule]
        heapq.heapify(waiting)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = parts[i], parts[after[i]]
                if pair in rule:
                    heapq.heappush(waiting, (*rule[pair], i, *pair))

        while waiting:
            _, token, i, x, y = heapq.heappop(waiting)
            j = after[i] if parts[i] == x else n
            if j >= n or parts[j] != y:  # one of the two has been merged since
                continue
            parts[i], parts[j] = token, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [t for t in parts if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that are new to this worker; afterwards `words` holds them."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.words]
        if not fresh:
            return
        raw = [w.encode() for w in fresh]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(fresh)), lengths)
        inner = np.nonzero(of[1:] == of[:-1])[0]
        keys, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        if len(self.compatible) > CACHED_PAIRS:
            self.compatible.clear()
        known = self.compatible
        unknown = np.fromiter((k for k in keys.tolist() if k not in known), np.int64)
        known.update(zip(unknown.tolist(), self.check_pairs(unknown >> 32, unknown & 0xFFFFFFFF).tolist()))
        fine = np.fromiter((known[k] for k in keys.tolist()), bool, len(keys))
        failing = set(of[inner[~fine[back]]].tolist()) if len(keys) else set()
        for i, word in enumerate(fresh):
            self.words[word] = self.merge(raw[i]) if i in failing else proposed[i]

    def split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self._splitter.pre_tokenize_str(text)]

    def encode_words(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(words)
        return [t for w in words for t in self.words[w]]


class _Chunks(dict):
    """Numbers chunks in order of appearance and remembers those that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


class CorpusEncoder:
    """Encodes blocks of texts; ids of distinct chunks are kept in one flat array."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import re

        self.words = SpeculativeEncoder(path)
        self._find = re.compile(CHUNK).findall
        self._forget()

    def _forget(self) -> None:
        self._chunks = _Chunks()
        self._ids, self._starts, self._lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.words.words.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets, one more than texts, and the ids of all texts after one another."""
        if len(self._chunks) > CACHED_CHUNKS:
            self._forget()
        number = self._chunks.__getitem__
        numbers, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = self._find(text)
                counts[i] = len(found)
                numbers.extend(map(number, found))
        fresh, self._chunks.fresh = self._chunks.fresh, []
        if fresh:
            split = [self.words.split(c) for c in fresh]
            self.words.learn([w for words in split for w in words])
            ids = [[t for w in words for t in self.words.words[w]] for words in split]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((t for x in ids for t in x), np.int32, int(lengths.sum()))
            self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(lengths) - lengths])
            self._lengths = np.concatenate([self._lengths, lengths])
            self._ids = np.concatenate([self._ids, flat])
        at = np.array(numbers, np.int64)
        sizes = self._lengths[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self._ids[np.repeat(self._starts[at] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return bounds, out


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters; a longer text is a block by itself."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id_col, ids): the ids of each text, without special tokens. One pass over the scan, no shuffle.

    The tokenizer's file is read where the session runs and shipped to the workers.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    shipped = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = CorpusEncoder(SparkFiles.get(shipped))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _blocks(texts):
                bounds, ids = encoder.encode(texts[start:stop])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], [id_col, "ids"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
