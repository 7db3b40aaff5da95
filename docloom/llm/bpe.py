"""Byte-level BPE of a whole corpus by replaying the merges (problem 7).

The distinct words of a block of documents (an Arrow batch, plus what the worker has seen before) are
laid out one after the other as symbols. An inverted index holds, for each adjacent pair of symbols
that can merge, the positions where it stands. The merges are then applied in rank order, each to all
its positions at once; only the two neighbours of a merged position enter the index anew. A merge
never crosses a word, so the ids of a word don't depend on the block, and a block is as good as the
corpus while no vocabulary has to be gathered or broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import spread

#: The public pre-tokenising pattern of byte_bpe_50k (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers between batches; beyond it the memory starts anew, ids stay equal.
REMEMBERED = 400_000


def default_tokenizer() -> str:
    """Path of the public byte_bpe_50k.json."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_symbols() -> dict[int, str]:
    """The published byte alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeReplay:
    """Ids of words by replaying ranked merges over an inverted pair index."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = [vocab[s] for _, s in sorted(_byte_symbols().items())]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pair: list[tuple[int, int]] = []
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[a] << 20 | vocab[b]] = i
            self.made.append(vocab[a + b])
            self.pair.append((vocab[a], vocab[b]))
        self.known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def learn(self, words: list[str]) -> None:
        """Add the ids of distinct words not yet known."""
        first, rank = self.first, self.rank
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym += [first[b] for b in w.encode("utf-8", "surrogatepass")]
            sym.append(-1)  # parts words; no pair with it can merge
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        index: dict[int, list[int]] = {}
        get = rank.get
        for i in range(n - 1):
            b = sym[i + 1]
            if b >= 0 and (a := sym[i]) >= 0 and (r := get(a << 20 | b)) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapify(heap)
        while heap:
            r = heappop(heap)
            places = index.pop(r)
            a, b = self.pair[r]
            new = self.made[r]
            high = new << 20
            if a == b:
                places.sort()  # of overlapping places the left one merges
            for i in places:
                if sym[i] != a:
                    continue
                j = right[i]
                if sym[j] != b:
                    continue
                k = right[j]
                sym[i], sym[j] = new, -2
                right[i], left[k if k < n else -1] = k, i
                h = left[i]
                if h >= 0 and (s := sym[h]) >= 0 and (q := get(s << 20 | new)) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heappush(heap, q)
                if (s := sym[k]) >= 0 and (q := get(high | s)) is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heappush(heap, q)
        known = self.known
        for w, p in zip(words, starts):
            out = []
            while (s := sym[p]) >= 0:
                out.append(s)
                p = right[p]
            known[w] = tuple(out)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the length of each text's share."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split, known = self.split, self.known
        parts = [split(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(parts)).difference(known)
        if fresh:
            self.learn(sorted(fresh))
        get = known.__getitem__
        lists = [list(chain.from_iterable(map(get, p))) for p in parts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


_replays: dict[str, MergeReplay] = {}


def replay(path: str) -> MergeReplay:
    """One replay for each tokenizer and Python worker."""
    if path not in _replays:
        _replays[path] = MergeReplay(path)
    return _replays[path]


#: Characters that are encoded at a time, so that a batch of long texts stays small in memory.
CHARS = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>): the token ids of each row's text, without special tokens.

    An empty and a null text give an empty list; strings that look like special tokens are ordinary
    text. Rows keep their number and repeat as they do in docs; a null key stays null. Other columns
    are not read. An empty table gives an empty table.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replay(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                flat, lengths = bpe.encode(texts[i:j])
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns in keep and n_tokens BIGINT, the number of token_ids of text; 0 for null and empty."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replay(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for i, j in _slices(texts):
                n = pa.array(bpe.encode(texts[i:j])[1])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(len(keep))), n], names=[*keep, "n_tokens"])

    shape = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return spread(docs.select(*keep, F.col(text))).mapInArrow(run, f"{shape}, n_tokens bigint")
