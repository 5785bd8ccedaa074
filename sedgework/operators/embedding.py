"""Embedding and reranking through models that the caller supplies or an HTTP server."""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from sedgework.operators.fusion import clamp

CLIP_CHARS, REQUEST_CHARS, BATCH = 8000, 20_000, 32
Embedder = Callable[[Sequence[str]], list[list[float]]]


def packed(texts: Sequence[str], clip: int = CLIP_CHARS, most: int = REQUEST_CHARS) -> Iterator[list[str]]:
    """Clipped texts in requests of bounded size; a text alone may exceed it only by its clip."""
    request: list[str] = []
    size = 0
    for t in texts:
        t = t[:clip]
        if request and size + len(t) > most:
            yield request
            request, size = [], 0
        request.append(t)
        size += len(t)
    if request:
        yield request


def unit(v: Sequence[float], dimensions: int | None = None) -> list[float]:
    v = list(v[:dimensions])
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def mean_pooled(tokens: Sequence[Sequence[float]], mask: Sequence[int]) -> list[float]:
    """Mean of the token vectors that the mask keeps, at length 1."""
    kept = [t for t, m in zip(tokens, mask) if m]
    return unit([sum(c) / max(1, len(kept)) for c in zip(*kept)]) if kept else []


def _post(url: str, body: dict, timeout: float) -> dict:
    data = json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def http_embedder(url: str, model: str, dimensions: int, timeout: float = 120.0) -> Embedder:
    """Vectors of a ``/v1/embeddings`` server in the order asked, cut to ``dimensions``; a missing one is empty."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for request in packed(texts):
            rows = _post(url.rstrip("/") + "/v1/embeddings", {"model": model, "input": request}, timeout).get("data") or []
            vectors = [unit(r.get("embedding") or [], dimensions) if r.get("embedding") else [] for r in rows]
            out += (vectors + [[]] * len(request))[: len(request)]
        return out

    return embed


def http_scorer(url: str, model: str, timeout: float = 120.0) -> Callable[[str, list[str]], list[float]]:
    """Scores of a ``/v1/rerank`` server by index, clamped to 0..1; missing ones are 0."""

    def score(query: str, passages: list[str]) -> list[float]:
        out: list[float] = []
        for request in packed(passages):
            rows = _post(url.rstrip("/") + "/v1/rerank", {"model": model, "query": query, "documents": request}, timeout).get("results") or []
            by_index = {r.get("index"): clamp(r.get("relevance_score")) for r in rows}
            out += [by_index.get(i, 0.0) for i in range(len(request))]
        return out

    return score


def logits_to_score(logits: Sequence[float]) -> float:
    """Sigmoid of the only label's logit, or of the second's."""
    x = logits[0] if len(logits) == 1 else logits[1]
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def embed_rows(rows: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """``rows`` with an embedding of a text column, 32 texts at a time; a failure fails the task, so nothing is half indexed.

    Null texts are embedded as empty ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            texts = [t or "" for t in pdf[text]]
            for i in range(0, len(texts), BATCH):
                vectors += embedder(texts[i : i + BATCH])
            yield pdf.assign(**{name: vectors})

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, `{name}` array<float>")
