"""Embedders: a model's name, size and a function over Arrow batches; where none is given, hashing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKENS = re.compile(r"[^\W_]+")


class Embedder:
    """fn: texts -> array of len(texts) x dim.  Loaded once a task by calling `load`."""

    def __init__(self, model: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.model, self.dim, self.load = model, dim, load

    def apply(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding struct<model, data>); null texts count as empty."""
        model, load = self.model, self.load

        def run(batches):
            fn = load()
            for b in batches:
                grid = np.asarray(fn([x or "" for x in b[text].to_pylist()]), np.float32)
                data = pa.array(list(grid), pa.list_(pa.float32()))
                yield pa.record_batch([b[key], pa.StructArray.from_arrays([pa.array([model] * len(b), pa.string()), data], ["model", "data"])], [key, "embedding"])

        kind = dict(rows.dtypes)[key]
        return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding struct<model:string,data:array<float>>")


    def for_write(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding, warning) of rows to be written: where a text cannot be embedded the row stays, with a null embedding and
        what went wrong.  A batch that fails is tried again text by text, so one bad text costs no other its vector."""
        model, dim, load = self.model, self.dim, self.load

        def tried(fn, texts: list[str]) -> list[tuple]:
            try:
                grid = np.asarray(fn(texts), np.float32)
            except Exception as e:
                return [(None, f"{type(e).__name__}: {e}")] if len(texts) == 1 else [x for t in texts for x in tried(fn, [t])]
            if grid.shape != (len(texts), dim):
                return [(None, f"{model} gave {grid.shape} for {len(texts)} texts of {dim} dimensions")] * len(texts)
            return [(v, None) if np.isfinite(v).all() else (None, f"{model} gave a vector that is not finite") for v in grid]

        def run(batches):
            try:
                fn, broken = load(), None
            except Exception as e:  # the write goes on without vectors
                fn, broken = None, f"{type(e).__name__}: {e}"
            for b in batches:
                texts = [x or "" for x in b[text].to_pylist()]
                found = [(None, broken)] * len(texts) if broken else tried(fn, texts) if texts else []
                cells = [None if v is None else {"model": model, "data": v.tolist()} for v, _ in found]
                kind = pa.struct([("model", pa.string()), ("data", pa.list_(pa.float32()))])
                yield pa.record_batch([b[key], pa.array(cells, kind), pa.array([w for _, w in found], pa.string())], [key, "embedding", "warning"])

        kind = dict(rows.dtypes)[key]
        return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding struct<model:string,data:array<float>>, warning string")


def hashing(dim: int = 256) -> Embedder:
    """Signed feature hashing by sha2: the same rule as vectors.hash_embedding, as whole vectors."""

    def load():
        def fn(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for token in _TOKENS.findall(t.lower()):
                    h = hashlib.sha256(token.encode()).hexdigest()
                    out[i, int(h[:8], 16) % dim] += 1 if int(h[16], 16) % 2 == 0 else -1
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(size > 0, size, 1)

        return fn

    return Embedder(f"hashing-v1-d{dim}", dim, load)
