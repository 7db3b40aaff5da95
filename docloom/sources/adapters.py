"""Edges of the dataflow: bytes or text in, rows out, by decoders that a deployment plugs in.

PDF, OCR, audio, office formats, language models and network services have no place in a plan; what
they return has. Each kind registers a function, and the operators here run it within Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.norm import tokens


class Decoder(Protocol):
    """Bytes of a file to the texts of its pages."""

    def __call__(self, content: bytes) -> list[str]: ...


class Provider(Protocol):
    """A language model: prompt to reply."""

    def __call__(self, prompt: str) -> str: ...


DECODERS: dict[str, Decoder] = {"text": lambda b: b.decode("utf-8", "replace").split("\f")}


def decode(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """(path, page, text, error) of files (path, kind, content); a kind without decoder, and a failing one, give a row with the error."""
    known = {**DECODERS, **(decoders or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, kind, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(known[kind](content or b""), 1)]
                except Exception as e:  # a decoder's failure is a row of the result
                    out.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page", "text", "error"])

    return files.select("path", "kind", "content").mapInArrow(run, "path string, page int, text string, error string")


def hashing_encoder(dim: int = 48) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic encoder for tests: words hashed to signed places, at length 1; no words, all zeros."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in tokens(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 60 & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], model: str) -> DataFrame:
    """(doc_id, idx, model, dim, vec) of chunks (doc_id, idx, title, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = encode([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model] * len(vecs)), pa.array([len(v) for v in vecs], pa.int32()), pa.array(vecs, pa.list_(pa.float32()))], names=["doc_id", "idx", "model", "dim", "vec"])

    both = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return chunks.select("doc_id", "idx", both.alias("t")).mapInArrow(run, "doc_id bigint, idx int, model string, dim int, vec array<float>")


def complete(prompts: DataFrame, provider: Provider) -> DataFrame:
    """(key, reply) of prompts (key, prompt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([provider(p or "") for p in b.column(1).to_pylist()], pa.string())], names=["key", "reply"])

    return prompts.select(F.col("key").cast("string"), "prompt").mapInArrow(run, "key string, reply string")
