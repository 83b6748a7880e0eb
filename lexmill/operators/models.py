"""Embedders and generators from models of any kind, loaded once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What turns texts into vectors, and what turns messages (role, content) into an answer.
Encode = Callable[[list[str]], Sequence[Sequence[float]]]
Answer = Callable[[list[dict[str, str]]], str]

_loaded: dict[str, object] = {}


def _once(name: str, load: Callable[[], object]) -> object:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _vectors(encode: Encode, texts: list[str]) -> list[list[float]]:
    """A vector for each text; an empty one where encoding fails."""
    try:
        return [np.asarray(v, np.float32).tolist() for v in encode(texts)]
    except Exception:  # a model may fail in any way; one bad text shouldn't cost the others theirs
        return [[]] if len(texts) == 1 else [v for t in texts for v in _vectors(encode, [t])]


def embedder(name: str, load: Callable[[], Encode], batch: int = 64) -> Callable[[DataFrame, str], DataFrame]:
    """An embedder, as add_documents takes, from a model.

    load gives the model's function and is called once in each worker, under its name.
    Texts go to it batch at a time; where it fails, one by one, and a text that fails by
    itself gets an empty embedding, which drop_unembedded removes. A null text stays null.
    """

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        encode = _once(name, load)
        rows = texts.to_pylist()
        out: list[list[float] | None] = [None] * len(rows)
        some = [i for i, t in enumerate(rows) if t is not None]
        for a in range(0, len(some), batch):
            part = some[a : a + batch]
            for i, v in zip(part, _vectors(encode, [rows[i] for i in part]), strict=True):
                out[i] = v
        return pa.array(out, pa.list_(pa.float32()))

    return lambda chunks, column: chunks.withColumn("embedding", run(F.col(column)))


def generator(name: str, load: Callable[[], Answer]) -> Callable[[Column], Column]:
    """A generator, as answers takes, from a model; see embedder. Where it fails, the answer says so."""

    @F.arrow_udf("string")
    def run(messages: pa.Array) -> pa.Array:
        answer = _once(name, load)
        out = []
        for m in messages.to_pylist():
            try:
                out.append(None if m is None else answer(m).strip())
            except Exception as problem:
                out.append(f"Error generating response with {name}: {problem}")
        return pa.array(out, pa.string())

    return run
