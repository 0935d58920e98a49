"""Operations of an outside service as a table: a Python data source that asks until each is done.

Operations are dealt to partitions; a partition asks for its own, one after the other.  What a service
answers by status decides: busy or failing for a while is asked again, refused is an error at once.
A client is any picklable object with ``operations()`` and ``get(name) -> (status, body)``.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the protocol: statuses that are asked again, tries, first wait and its spread, time between polls and for an operation in seconds.
TRANSIENT = frozenset({429, 500, 502, 503, 504})
TRIES, FIRST_WAIT, SPREAD, LEAST_WAIT = 4, 2.0, 0.15, 0.5
POLL_EVERY, OPERATION_CAP = 2.0, 900.0


class Client(Protocol):
    def operations(self) -> Sequence[str]: ...

    def get(self, name: str) -> tuple[int, str]: ...


class Refused(RuntimeError):
    """An answer that asking again does not mend."""


def requested(client: Client, name: str, *, tries: int = TRIES, wait: Callable[[float], None] = time.sleep, chance: random.Random | None = None) -> dict:
    """The answer's JSON; an empty body is empty.  Waits double, with some spread by chance."""
    chance = chance or random.Random()
    for attempt in range(tries):
        last = attempt == tries - 1
        try:
            status, body = client.get(name)
        except (ConnectionError, TimeoutError):
            if last:
                raise
            wait(max(LEAST_WAIT, FIRST_WAIT * 2**attempt))
            continue
        if status < 400:
            return json.loads(body) if body.strip() else {}
        if last or status not in TRANSIENT:
            raise Refused(f"{name}: status {status}: {body}")
        wait(max(LEAST_WAIT, FIRST_WAIT * 2**attempt * (1 + chance.uniform(-SPREAD, SPREAD))))
    raise ValueError("tries must be positive")


def finished(client: Client, name: str, *, every: float = POLL_EVERY, cap: float = OPERATION_CAP, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, **how) -> tuple[dict, int]:
    """The operation's response once it is done, and how often it was asked for."""
    began, polls = clock(), 0
    while True:
        answer = requested(client, name, wait=wait, **how)
        polls += 1
        if answer.get("done"):
            if "error" in answer:
                raise Refused(f"{name}: {answer['error'].get('code')}: {answer['error'].get('message')}")
            return answer.get("response", {}), polls
        if clock() - began > cap:
            raise TimeoutError(f"{name}: not done after {cap:.0f} s")
        wait(every)


@dataclass
class Recorded:
    """A client that plays back what was recorded: an operation's answers in order, the last one from then on."""

    answers: Mapping[str, Sequence[tuple[int, str]]]

    def __post_init__(self):
        self.asked: dict[str, int] = {}

    def operations(self) -> Sequence[str]:
        return list(self.answers)

    def get(self, name: str) -> tuple[int, str]:
        turn = self.asked.get(name, 0)
        self.asked[name] = turn + 1
        return self.answers[name][min(turn, len(self.answers[name]) - 1)]


@dataclass
class _Names(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, client: Client, parts: int, every: float, cap: float):
        self.client, self.parts, self.every, self.cap = client, parts, every, cap

    def partitions(self) -> Sequence[InputPartition]:
        names = list(self.client.operations())
        n = max(1, min(self.parts, len(names)))
        return [_Names(names[k::n]) for k in range(n)]

    def read(self, partition: _Names) -> Iterator[tuple[str, str, int]]:
        for name in partition.names:
            response, polls = finished(self.client, name, every=self.every, cap=self.cap)
            yield name, json.dumps(response, ensure_ascii=False, sort_keys=True), polls


def polled_source(client: Client, source: str = "polled") -> type[DataSource]:
    """A data source over ``client``, to be registered: ``spark.dataSource.register(polled_source(client))``.

    Options: ``parts`` (8), ``every`` (2) and ``cap`` (900) seconds.  Columns: operation, response (JSON), polls.
    """

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return "operation string, response string, polls int"

        def reader(self, schema) -> DataSourceReader:
            option = lambda name, default: type(default)(self.options.get(name, default))
            return _Reader(client, option("parts", 8), option("every", POLL_EVERY), option("cap", OPERATION_CAP))

    return Polled
