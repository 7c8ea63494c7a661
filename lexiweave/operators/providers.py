"""Where a model is called: a provider maps batches of requests to answers, inside Arrow batches; retries stay with it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Provider(Protocol):
    def complete(self, prompts: list[str]) -> list[str | None]:
        """An answer for each prompt, in their order; null where none came."""


class EchoProvider:
    """For tests and offline runs: the prompt's last line, or a fixed table's entry."""

    def __init__(self, answers: dict[str, str] | None = None):
        self.answers = answers or {}

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self.answers.get(p, p.rsplit("\n", 1)[-1]) for p in prompts]


def ask(requests: DataFrame, provider: Provider, prompt: str = "prompt") -> DataFrame:
    """requests with column answer. Write the result before using it twice: each run of the plan asks again."""
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = provider.complete(b.column(names.index(prompt)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], [*names, "answer"])

    return requests.mapInArrow(run, StructType([*requests.schema.fields, StructField("answer", StringType())]))


class ChatProvider(Protocol):
    def reply(self, requests: list[str], max_tokens: list[int]) -> list[tuple[str | None, str | None]]:
        """(answer, error) for each request, in their order. The error "truncated" says that max_tokens cut the answer off."""


def converse(requests: DataFrame, provider: ChatProvider, request: str = "request", max_tokens: str = "max_tokens") -> DataFrame:
    """requests with columns answer and error; rows without a request are not asked. Write the result before using it twice."""
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, limits = b.column(names.index(request)).to_pylist(), b.column(names.index(max_tokens)).to_pylist()
            at = [i for i, x in enumerate(texts) if x is not None]
            got = dict(zip(at, provider.reply([texts[i] for i in at], [limits[i] for i in at]))) if at else {}
            pairs = [got.get(i, (None, None)) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string())], [*names, "answer", "error"])

    return requests.mapInArrow(run, StructType([*requests.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


def answered(provider: ChatProvider, request: Column, max_tokens: Column) -> Column:
    """A struct of answer and error for a request (null: not asked). Only these two columns reach the workers, whatever else a row
    carries. Not to be computed twice, so give it a column of its own, and write the result before using it twice."""

    def run(requests: pa.Array, limits: pa.Array) -> pa.Array:
        texts, most = requests.to_pylist(), limits.to_pylist()
        at = [i for i, x in enumerate(texts) if x is not None]
        got = dict(zip(at, provider.reply([texts[i] for i in at], [most[i] for i in at]))) if at else {}
        pairs = [got.get(i, (None, None)) for i in range(len(texts))]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([e for _, e in pairs], pa.string())], ["answer", "error"])

    return F.arrow_udf(run, "answer string, error string").asNondeterministic()(request, max_tokens)
