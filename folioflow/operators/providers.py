"""Batch providers for what models outside do: embedding, page reading, answers.

A provider maps a list of inputs to a list of outputs on an executor.  Retries
with growing waits and smaller batches are here; the stubs are deterministic and
need no network.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Provider = Callable[[list[str]], list]
#: Tries, first wait in seconds, least wait when told to slow down, batch that is halved.
TRIES, FIRST_WAIT, SLOW_WAIT, HALVED = 6, 3.0, 25.0, 10


class QuotaError(Exception):
    """The service asks for fewer or later requests."""


def told_wait(message: str) -> float | None:
    """The wait that an error message names, in seconds."""
    for pattern in (r"retry in (\d+(?:\.\d+)?)s", r"retryDelay\D*(\d+)"):
        if found := re.search(pattern, message):
            return float(found[1])
    return None


def call(provider: Provider, inputs: list[str], tries: int = TRIES, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> list:
    """Call a provider; on quota errors halve larger batches, else wait twice as long each time."""
    for attempt in range(tries):
        try:
            return provider(inputs)
        except QuotaError as error:
            if len(inputs) > HALVED:
                half = len(inputs) // 2
                return call(provider, inputs[:half], tries, wait, sleep) + call(provider, inputs[half:], tries, wait, sleep)
            if attempt == tries - 1:
                raise
            told = told_wait(str(error))
            sleep(max(wait, SLOW_WAIT if told is None else told + 2))
            wait *= 2
    raise ValueError("tries must be positive")


def stub_embedding(texts: list[str], size: int = 16) -> list[list[float]]:
    """Unit vectors from hashes of a text's words; equal texts get equal vectors."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in re.findall(r"\w+", (text or "").lower()):
            h = hashlib.blake2b(word.encode(), digest_size=4).digest()
            v[h[0] % size] += 1.0 if h[1] & 1 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if norm else v)
    return out


def stub_answer(prompts: list[str]) -> list[str]:
    """The first line of each prompt's context, as an answer that can be tested."""
    return [next((line for line in (p or "").split("\n") if line.startswith("[Trang")), "") for p in prompts]


def stub_page(prompts: list[str]) -> list[str]:
    """A page's answer with one block a half, from the prompt's chapter and section, for tests."""
    out = []
    for p in prompts:
        named = re.findall(r"^- (?:Chương \(#\)|Ý chính \(##\)): (.*)$", p or "", re.M)
        out.append(json.dumps({"blocks": [{"location": side, "content": f"# {' / '.join(named)}\n{side} text"} for side in ("left", "right")]}, ensure_ascii=False))
    return out


def apply(rows: DataFrame, provider: Provider, input_col: str, output_col: str, kind: T.DataType, batch: int = 50) -> DataFrame:
    """Add a provider's output; filter rows first, as no filter is pushed through it."""
    schema = T.StructType([*rows.schema.fields, T.StructField(output_col, kind)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got: list = []
            texts = frame[input_col].tolist()
            for i in range(0, len(texts), batch):
                got += call(provider, texts[i : i + batch])
            yield frame.assign(**{output_col: got})

    return rows.mapInPandas(run, schema)


def embed(rows: DataFrame, text_col: str = "text", provider: Provider = stub_embedding, batch: int = 50) -> DataFrame:
    """Add ``embedding`` to rows."""
    return apply(rows, provider, text_col, "embedding", T.ArrayType(T.DoubleType()), batch)
