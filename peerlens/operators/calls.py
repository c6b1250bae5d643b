"""Guarded calls of a live provider: one row for each request, whatever the provider does.

A provider is a plain function from a request's text to an answer's text; it runs in tasks, is retried with a growing pause and
never stops the others: an exception becomes the row's error.  Write the rows (`sources.sinks.stage`) before they are used
twice, or the provider is asked twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str], str | None]


@dataclass(frozen=True)
class Policy:
    #: Calls of one request at most.
    attempts: int = 2
    #: Seconds before the second call; each further pause is twice as long.
    backoff: float = 0.5
    #: Calls a second of all tasks together; None for no limit.
    per_second: float | None = None
    #: Tasks that call at the same time.
    parallel: int = 8
    #: Longest error text that is kept.
    error_chars: int = 500

    def tried(self, call: Callable, *args):
        """(answer, error, attempts) of a call under this policy."""
        error = None
        for n in range(max(1, self.attempts)):
            if n:
                time.sleep(self.backoff * 2 ** (n - 1))
            try:
                return call(*args), None, n + 1
            except Exception as e:
                error = f"{type(e).__name__}: {e}"[: self.error_chars]
        return None, error, max(1, self.attempts)


class Pace:
    """Keeps calls of one of `parallel` tasks so far apart that all of them together stay within the policy's rate."""

    def __init__(self, policy: Policy, parallel: int):
        self.apart = parallel / policy.per_second if policy.per_second else 0.0
        self.next = 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.apart


def guarded(requests: DataFrame, call: Call, key: str, text: str = "prompt", policy: Policy = Policy()) -> DataFrame:
    """`key`, response, error, seconds, attempts of every request; the response is null where there is an error.

    seconds: what this request took, pauses between its calls included."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches):
        pace = Pace(policy, policy.parallel)
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.slice(at, 16)
                rows = []
                for request in part.column(1).to_pylist():
                    pace.wait()
                    began = time.monotonic()
                    rows.append((*policy.tried(call, request), time.monotonic() - began))
                answer, error, attempts, seconds = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(answer, pa.string()), pa.array(error, pa.string()), pa.array(seconds, pa.float64()), pa.array(attempts, pa.int32())],
                    names=[key, "response", "error", "seconds", "attempts"],
                )

    rows = requests.select(key, F.col(text).cast("string").alias("_text")).repartition(policy.parallel, key)
    return rows.mapInArrow(run, f"`{key}` {kind}, response string, error string, seconds double, attempts int")


def failed(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("error").isNotNull())


def again(calls: DataFrame, requests: DataFrame, call: Call, key: str, text: str = "prompt", policy: Policy = Policy()) -> DataFrame:
    """`calls` after another pass over the requests that failed, and these only; seconds and attempts add up."""
    before = failed(calls).select(key, F.col("seconds").alias("_s"), F.col("attempts").alias("_n"))
    new = guarded(requests.join(before, key, "left_semi"), call, key, text, policy).join(before, key)
    new = new.select(key, "response", "error", (F.col("seconds") + F.col("_s")).alias("seconds"), (F.col("attempts") + F.col("_n")).alias("attempts"))
    return calls.where(F.col("error").isNull()).unionByName(new)
