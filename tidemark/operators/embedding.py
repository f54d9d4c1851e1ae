"""Embedders, and columns of their vectors."""

from __future__ import annotations

import hashlib
import os
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import EmbeddingError
from tidemark.functions import cut
from tidemark.functions.text import WHITE_SPACE


class Embedder(ABC):
    """Batches of texts to vectors. Instances are pickled to executors; load models lazily there."""

    dim: int
    max_len: int = 256
    kind: str = "custom"

    @property
    def embedder_id(self) -> str:
        return f"local:{self.kind}:d{self.dim}"

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[np.ndarray]: ...

    def embed_one(self, text: str) -> list[float]:
        return [float(x) for x in self.embed_batch([text])[0]]


class HashingEmbedder(Embedder):
    """A deterministic stand-in for a model: each word adds to one cell, then the vector is scaled to length one."""

    kind = "fake"

    def __init__(self, dim: int = 1024):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        import xxhash

        known: dict[str, int] = {}
        out = []
        for t in texts:
            words = t.split()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode() + b"\xff", seed=0)
            h = np.fromiter((known[w] for w in words), np.uint64, len(words))
            weight = (h >> np.uint64(32)).astype(np.float64) / (2**32 - 1) + np.arange(len(words)) % 3 * 0.01
            v = np.bincount((h % np.uint64(self.dim)).astype(np.int64), weight, self.dim).astype(np.float32)
            out.append(v / np.float32(max(float(np.sqrt((v * v).sum())), 1e-6)))
        return out


class ModelEmbedder(Embedder):
    """A sentence encoder from a local folder; its libraries and weights are optional."""

    kind = "model"

    def __init__(self, path: str | None = None, dim: int = 1024, max_len: int = 256):
        self.path, self.dim, self.max_len = path or resolve_model_dir(), dim, max_len

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        try:
            import onnxruntime
            from tokenizers import Tokenizer
        except ImportError as e:
            raise EmbeddingError("no runtime for models") from e
        if not self.path or not os.path.exists(os.path.join(self.path, "model.onnx")):
            raise EmbeddingError(f"no model in {self.path}")
        if not hasattr(self, "_session"):
            self._session = onnxruntime.InferenceSession(os.path.join(self.path, "model.onnx"))
            self._tokenizer = Tokenizer.from_file(os.path.join(self.path, "tokenizer.json"))
        ids, mask = pad([self._tokenizer.encode(t).ids for t in texts], self.max_len)
        hidden = self._session.run(None, {"input_ids": ids, "attention_mask": mask})[0]
        return list(masked_mean(hidden, mask))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


class SentenceEmbedder(Embedder):
    """A sentence-transformers model by name or folder. The library and its weights are optional. An empty text has an empty vector."""

    kind = "sentence"

    def __init__(self, name: str, dim: int = 384):
        self.name, self.dim = name, dim

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        if not hasattr(self, "_model"):
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise EmbeddingError("no library for sentence models") from e
            self._model = SentenceTransformer(self.name)
        full = [t for t in texts if t.strip()]
        found = iter(self._model.encode(full)) if full else iter(())
        return [np.asarray(next(found), np.float32) if t.strip() else np.zeros(0, np.float32) for t in texts]

    __getstate__ = ModelEmbedder.__getstate__


def pad(ids: list[list[int]], max_len: int, pad_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and masks, all of one length."""
    out, mask = np.full((len(ids), max_len), pad_id, np.int64), np.zeros((len(ids), max_len), np.int64)
    for i, row in enumerate(ids):
        out[i, : len(row[:max_len])], mask[i, : len(row[:max_len])] = row[:max_len], 1
    return out, mask


def masked_mean(hidden: np.ndarray, mask: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """The mean over unmasked places, scaled to length one."""
    m = mask[:, :, None].astype(np.float64)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1)
    return mean / (np.sqrt((mean**2).sum(1, keepdims=True)) + eps)


def resolve_model_dir() -> str | None:
    """MODEL_DIR, else ``models`` here or one level up."""
    return next((p for p in (os.environ.get("MODEL_DIR"), "models", os.path.join("..", "models")) if p and os.path.isdir(p)), None)


def default_embedder(dim: int = 1024) -> Embedder:
    """The stand-in where APP_USE_FAKE_EMBEDDINGS is 1 or true, else the model."""
    return HashingEmbedder(dim) if os.environ.get("APP_USE_FAKE_EMBEDDINGS", "").lower() in ("1", "true") else ModelEmbedder(dim=dim)


def embed_column(embedder: Embedder, text: Column | str, batch: int = 128):
    """struct(vector, error): an error concerns its row alone. A null text is embedded as an empty one."""

    @F.pandas_udf("struct<vector:array<float>,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> tuple:
            try:
                return (embedder.embed_batch([text])[0], None)
            except Exception as e:  # noqa: BLE001
                return (None, str(e)[:500])

        for s in batches:
            for a in range(0, len(s), batch):  # what is made of some texts goes before the next are looked at
                texts = ["" if t is None else t for t in s.iloc[a : a + batch]]
                try:
                    rows = [(v, None) for v in embedder.embed_batch(texts)]
                except Exception:  # noqa: BLE001
                    rows = [one(t) for t in texts]
                # An empty text may have an empty vector.
                bad = [(None, f"a vector has length {len(v)}, not {embedder.dim}") if v is not None and len(v) not in (embedder.dim, 0 if not t.strip() else embedder.dim) else (v, e) for (v, e), t in zip(rows, texts, strict=True)]
                yield pd.DataFrame({"vector": [v for v, _ in bad], "error": [e for _, e in bad]})

    return run(text)


def with_vectors(chunks: DataFrame, embedder: Embedder, text_col: str = "content") -> DataFrame:
    """Chunks with vectors; a text that can't be embedded fails the job."""
    out = chunks.withColumn("_e", embed_column(embedder, F.col(text_col)))
    vector = F.when(F.col("_e.error").isNotNull(), F.raise_error(F.col("_e.error")).cast("array<float>")).otherwise(F.col("_e.vector"))
    return out.withColumn("vector", vector).drop("_e")


def md5_embedding(text: Column | str, dim: int = 16) -> Column:
    """A hashing embedder: words counted by a slice of their MD5, then scaled to length one. A word is hashed once for all texts of a batch. A null text has a
    vector of nulls."""
    text = F.col(text) if isinstance(text, str) else text

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        inside = np.ones(0x110000, bool)
        inside[[ord(c) for c in WHITE_SPACE]] = False
        for texts in batches:
            words, sizes = cut.runs(texts, inside)
            coded = words.dictionary_encode()
            digests = np.frombuffer(b"".join([hashlib.md5(w).digest()[:3] for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]), np.uint8)
            cells = digests.reshape(-1, 3).astype(np.int64) @ [1 << 16, 1 << 8, 1] % dim
            at = np.repeat(np.arange(len(sizes)) * dim, sizes) + cells[coded.indices.to_numpy(zero_copy_only=False)]
            counts = np.bincount(at, minlength=len(sizes) * dim).reshape(len(sizes), dim).astype(np.float64)
            found = counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-6)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim), pa.array(found.ravel()))

    nulls = F.array_repeat(F.lit(None).cast("double"), dim)
    return F.when(text.isNull(), nulls).otherwise(embed(F.lower(text)))
