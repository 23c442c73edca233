"""Model calls behind one interface: a callable over a batch of texts, run by an Arrow UDF once a worker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Encoder = Callable[[list[str]], np.ndarray]


def hashed_tokens(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic stand-in for an encoder: signed counts of hashed tokens, scaled to length one."""
    import re

    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        for token in re.findall("[a-z0-9]+", text.lower()):
            h = int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "little")
            row[h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(row)
        if norm:
            row /= norm
    return out


def embed(chunks: DataFrame, encode: Encoder = hashed_tokens, batch: int = 256) -> DataFrame:
    """chunk_id and embedding of chunk_id and text; an encoder that returns nothing is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                vectors = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), np.float32)
                if vectors.shape[0] != part.num_rows or vectors.ndim != 2 or not vectors.shape[1]:
                    raise ValueError("the encoder returned no embedding for some text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["chunk_id", "embedding"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {kind}, embedding array<float>")


def with_fallback(first: Encoder, second: Encoder) -> Encoder:
    """The second encoder where the first fails or returns nothing; an error if both do."""

    def encode(texts: list[str]) -> np.ndarray:
        try:
            found = np.asarray(first(texts))
            if len(found) == len(texts) and found.size:
                return found
        except Exception as e:  # noqa: BLE001  whatever a remote encoder raises
            why = e
        else:
            why = None
        found = np.asarray(second(texts))
        if len(found) != len(texts) or not found.size:
            raise RuntimeError("no encoder returned embeddings") from why
        return found

    return encode


@dataclass(frozen=True)
class Generation:
    """How a model is to answer: temperature, most tokens, seed, and whether JSON is asked for."""

    temperature: float | None = None
    max_tokens: int | None = None
    seed: int | None = None
    json: bool = False


Generate = Callable[[str, str, Generation], str]  # system, user
ANSWER, INTENT = Generation(), Generation(temperature=0.0, max_tokens=512, seed=0, json=True)


def mock(canned: tuple[str, ...] = ()) -> Generate:
    """Canned answers by the prompt's hash, else one that cites the first source if there is any."""

    def generate(system: str, user: str, how: Generation) -> str:
        if canned:
            return canned[int.from_bytes(blake2b(user.encode(), digest_size=4).digest(), "little") % len(canned)]
        return "The sources say so [1]." if "[1]" in user else "The sources do not answer this question."

    return generate


BACKENDS: dict[str, Callable[[], Generate]] = {"mock": mock}


def backend(name: str) -> Generate:
    """A registered backend; others are added to BACKENDS by name."""
    try:
        return BACKENDS[name.strip().lower()]()
    except KeyError:
        raise ValueError(f"unknown model backend {name!r}; there are: {', '.join(sorted(BACKENDS))}") from None


def answer(prompts: DataFrame, generate: Generate, how: Generation = ANSWER, blank_on_error: bool = False) -> DataFrame:
    """query_id, answer, generation_ms of query_id, system, user: the model is called once a row, on the executors, and
    timed. blank_on_error: a call that fails gives a null answer (for intents, where the rule result then stands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, took = [], []
            for system, user in zip(batch.column("system").to_pylist(), batch.column("user").to_pylist(), strict=True):
                began = time.perf_counter()
                try:
                    said.append(generate(system, user, how))
                except Exception:  # noqa: BLE001  whatever a backend raises
                    if not blank_on_error:
                        raise
                    said.append(None)
                took.append(1000 * (time.perf_counter() - began))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(said, pa.string()), pa.array(took, pa.float64())], ["query_id", "answer", "generation_ms"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "system", "user").mapInArrow(run, f"query_id {kind}, answer string, generation_ms double")


def stream(answers: DataFrame, generate: Callable[[str, str, Generation], Iterator[str]], how: Generation = ANSWER) -> Iterator[str]:
    """The parts of one prompt's answer as the model gives them, on the driver."""
    row = answers.select("system", "user").first()
    yield from generate(row["system"], row["user"], how)
