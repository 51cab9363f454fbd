"""Encoders behind public client libraries, and vectors of cases through the embedding store."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import check_encoder, prepared
from ..sources.datasets import embed, store_root
from .calibration import MURIL

#: Tokens that a raw transformer reads of a text; a fixed value of its calibration.
MAX_TOKENS = 256
_MODELS: dict[tuple[str, str], object] = {}


def model_of(name: str, revision: str = "", load=None):
    """A worker's model by name and revision, loaded once for each process."""
    if (name, revision) not in _MODELS:
        _MODELS[name, revision] = (load or _load)(name, revision)
    return _MODELS[name, revision]


def _load(name: str, revision: str):
    """A function from texts to vectors of unit length; the libraries are imported in the worker."""
    if name != MURIL:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, revision=revision or None)
        return lambda texts: model.encode(texts, normalize_embeddings=True)
    import torch
    from transformers import AutoModel, AutoTokenizer

    tokens, model = (c.from_pretrained(name, revision=revision or None) for c in (AutoTokenizer, AutoModel))

    def run(texts):
        batch = tokens(texts, padding=True, truncation=True, max_length=MAX_TOKENS, return_tensors="pt")
        with torch.no_grad():
            out = model(**batch).last_hidden_state.numpy()
        return mean_pool(out, batch["attention_mask"].numpy())

    return run


def mean_pool(token_vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked means over the tokens (texts, tokens, dimensions), of unit length."""
    v, m = np.asarray(token_vectors, np.float64), np.asarray(mask, np.float64)[..., None]
    mean = (v * m).sum(axis=-2) / np.maximum(m.sum(axis=-2), 1e-9)
    size = np.linalg.norm(mean, axis=-1, keepdims=True)
    return mean / np.where(size == 0, 1.0, size)


@dataclass(frozen=True)
class Encoder:
    """What is sent to the workers: names only, never a model."""

    name: str
    revision: str = ""

    @property
    def ident(self) -> str:
        return f"{self.name}@{self.revision}" if self.revision else self.name

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [list(map(float, v)) for v in model_of(self.name, self.revision)(texts)]


def with_vectors(cases: DataFrame, encoder: str | Encoder, *, store: str | None = None, allow_muril: bool = False, encode=None) -> DataFrame:
    """Adds ``gold_vector`` and ``response_vector``; a case without a gold text has neither.

    Every different text is encoded once for each encoder and revision, whatever role it
    has; the store keeps it. ``encode`` takes the place of the encoder's own library.
    """
    e = encoder if isinstance(encoder, Encoder) else Encoder(encoder)
    check_encoder(e.name, allow_muril)
    path = f"{store or store_root(cases.sparkSession)}/{quote(e.ident, safe='')}"
    d = cases.withColumn("_has", F.col("gold") != "")
    for text, query in (("gold", False), ("response", True)):
        d = d.withColumn("_text", F.when(F.col("_has"), prepared(text, e.name, query)))
        d = embed(d, path, encode or e, "_text", query).withColumnRenamed("embedding", f"{text}_vector").drop("_text")
    return d.drop("_has")
