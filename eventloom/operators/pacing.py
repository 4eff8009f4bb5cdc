"""Requests to an outside service at a shared pace, with patience; clock, sleep and transport are the caller's.

A budget of requests a minute is shared by a fixed number of tasks without talk between them: time
is cut into slots of ``60 / per_minute`` seconds, and slot ``k`` belongs to task ``k % tasks``. So no two
requests of a job lie closer than a slot, whichever executors its tasks run on.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Answers that are worth another try, tries in all, the first wait and the longest, in seconds.
AGAIN = frozenset({429, 502, 503, 504})
TRIES, FIRST_WAIT, LONGEST_WAIT = 4, 4.0, 30.0

#: (status, headers, body) for a request
Transport = Callable[[dict], tuple[int, dict, str]]


@dataclass
class Slots:
    """The slots of one of ``tasks`` equal tasks."""

    per_minute: float
    task: int = 0
    tasks: int = 1
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _last: int = field(default=-1, init=False)

    def wait(self) -> float:
        """Sleep until the next slot of this task that wasn't used; its time."""
        width = 60.0 / self.per_minute
        now = self.clock()
        slot = max(math.ceil(now / width - 1e-9), self._last + 1)
        slot += (self.task - slot) % self.tasks
        self._last = slot
        if slot * width > now:
            self.sleep(slot * width - now)
        return slot * width


def answer_of(body: str) -> str | None:
    """The answer's text; None where a body, though it came as a success, tells of an error or holds no answer."""
    try:
        got = json.loads(body)
    except ValueError:
        return None
    if not isinstance(got, dict) or got.get("status") == "error" or any(got.get(k) for k in ("error", "detail")):
        return None
    choices = got.get("choices")
    message = choices[0].get("message") if isinstance(choices, list) and choices and isinstance(choices[0], dict) else None
    if not isinstance(message, dict):
        return None
    said = message.get("content") or message.get("reasoning_content") or ""
    if isinstance(said, list):
        said = "".join(str(part.get("text") or part.get("content") or "") if isinstance(part, dict) else str(part) for part in said)
    return str(said).strip() or None


def ask(request: dict, transport: Transport, slots: Slots) -> str | None:
    """The answer to one request, or None. Every try takes a slot; between tries the wait doubles, unless the service names its own."""
    pause = FIRST_WAIT
    for attempt in range(TRIES):
        slots.wait()
        try:
            status, headers, body = transport(request)
        except Exception:  # noqa: BLE001  no connection is no answer
            return None
        if status == 200:
            return answer_of(body)
        if status not in AGAIN or attempt == TRIES - 1:
            return None
        try:
            named = float({k.lower(): v for k, v in headers.items()}.get("retry-after") or pause)
        except ValueError:
            named = pause
        slots.sleep(min(named, LONGEST_WAIT))
        pause *= 2
    return None


def model_of(transport: Transport, request: Callable[[list[dict]], dict], slots: Slots, read: Callable[[str], list]) -> Callable[[list[dict]], list]:
    """A model for ``extract``'s operators: rows to one request, its answer to a list; raises where there is none, so that rows are asked by halves."""

    def call(rows: list[dict]) -> list:
        said = ask(request(rows), transport, slots)
        if said is None:
            raise RuntimeError("no answer")
        return read(said)

    return call


def answers(requests: DataFrame, transport: Transport, per_minute: float, tasks: int, column: str = "request", out: str = "answer", clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """All columns and the answer to each row's request (JSON), null where there is none; ``tasks`` share the budget.

    Rows are dealt round to the tasks, in no order. A null request is not sent.
    """
    names = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots(per_minute, TaskContext.get().partitionId() % tasks, tasks, clock, sleep)
        for frame in frames:
            said = [ask(json.loads(x), transport, slots) if x is not None else None for x in frame[column]]
            yield frame.assign(**{out: pd.Series(said, index=frame.index, dtype=object)})[[*names, out]]

    schema = requests.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("string").alias(out)).schema
    return requests.repartition(tasks).mapInPandas(run, schema)
