"""Interfaces to models: a function of batches, with bounded concurrency and retries. Inference itself is not part of the
engine; the stubs give reproducible values from the text alone."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prefforge.functions.tables import bounded_batches, releasing


def _number(text: str | None) -> int:
    """32 bits of a text's MD5."""
    return int(hashlib.md5((text or "").encode()).hexdigest()[:8], 16)


def stub_score(texts: list[str]) -> list[float]:
    """Scores in [-1, 1)."""
    return [_number(t) % 2000 / 1000 - 1 for t in texts]


def stub_generate(prompts: list[str], k: int) -> list[list[str]]:
    return [[f"{(p or '').split('</s>')[0]} variant {i}" for i in range(k)] for p in prompts]


def stub_judge(text: str) -> str:
    return f'{{"score": {_number(text) % 10 + 1}, "reason": "stub"}}'


def with_scores(df: DataFrame, column: str, score: Callable[[list[str]], list[float]] = stub_score, batch: int = 32, name: str = "rm_score") -> DataFrame:
    """df with the scores of a text column, `batch` texts a call."""
    made = lambda texts: [s for i in range(0, len(texts), batch) for s in score(texts[i : i + batch])]
    return _with(df, column, [T.StructField(name, T.DoubleType())], lambda texts: [pa.array(made(texts), pa.float64())])


def _with(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """df with columns that make gives for the texts of a batch. Batches are bounded by bytes, and their other columns go
    through as they came, so that a worker holds a few batches, however long texts are."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b.column(b.schema.get_field_index(column)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(releasing(run), T.StructType([*df.schema.fields, *fields]))


def with_candidates(df: DataFrame, prompt: str, k: int = 8, generate: Callable[[list[str], int], list[list[str]]] = stub_generate, batch: int = 4, strip: bool = True) -> DataFrame:
    """df with an array of k generated candidates for each prompt."""

    def run(prompts: list) -> list[pa.Array]:
        made = [c for i in range(0, len(prompts), batch) for c in generate(prompts[i : i + batch], k)]
        return [pa.array([[x.strip() if strip else x for x in c] for c in made], pa.list_(pa.string()))]

    return _with(df, prompt, [T.StructField("candidates", T.ArrayType(T.StringType()))], run)


class RateLimited(Exception):
    """The judge asks for fewer calls."""


class NoConnection(Exception):
    """The judge was not reached."""


class Refused(Exception):
    """The judge answered with an HTTP status of 400 or more."""

    def __init__(self, status: int, text: str = ""):
        super().__init__(text or str(status))
        self.status = status


#: What a call ended with: a reply, or a reason.
Answer = tuple[str | None, str | None]


def ask(judge: Callable[[str], str], text: str, tries: int = 4, wait: Callable[[float], None] = time.sleep) -> Answer:
    """A reply, or the reason why there is none. Calls that were limited or not connected, and those that a server failed
    (status 500 or more), are made again after 1, 2, 4, ... seconds; what is refused (status 400 to 499), what a server
    fails the last time, and every other error is a failed row at once."""
    for k in range(tries):
        try:
            return judge(text), None
        except (RateLimited, NoConnection):
            wait(2**k)
        except Refused as e:
            if e.status < 500 or k + 1 == tries:
                return None, f"api_error_{e.status}: {e}"
            wait(2**k)
        except Exception as e:  # noqa: BLE001  any other failure of a remote call becomes a row
            return None, f"error: {type(e).__name__}: {e}"
    return None, "max_retries_exceeded"


def with_replies(df: DataFrame, column: str, judge: Callable[[str], str] = stub_judge, concurrency: int = 10, tries: int = 4, tasks: int | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """df with the judge's reply to each text and an error column (see `ask`): a failed call is a row without reply, never an
    exception.

    concurrency bounds the calls of all tasks together: rows go to `tasks` partitions (by default as many as can run at
    once, at most `concurrency`), and each makes its share of calls at a time.
    """
    tasks = max(1, min(tasks or df.sparkSession.sparkContext.defaultParallelism, concurrency))
    at_once = concurrency // tasks

    def run(texts: list) -> list[pa.Array]:
        with ThreadPoolExecutor(at_once) as pool:
            got = list(pool.map(lambda x: ask(judge, x, tries, wait), texts))
        return [pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]

    return _with(df.repartition(tasks), column, [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())], run)
