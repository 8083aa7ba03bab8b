"""Optional external steps of search (rewording, reranking) behind a cache, a rate limit and strict checks. Off unless a caller is given."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

MAX_CANDIDATES = 15


class AnswerCache:
    """Answers with the turn of their last use; the one longest unused goes when there are more than ``size``."""

    def __init__(self, size: int = 128):
        self._size, self._turn, self._held, self._guard = size, 0, {}, threading.Lock()

    def _used(self, key: object, value: object) -> None:
        self._turn += 1
        self._held[key] = (self._turn, value)

    def look_up(self, key: object) -> object | None:
        with self._guard:
            if key not in self._held:
                return None
            value = self._held[key][1]
            self._used(key, value)
            return value

    def keep(self, key: object, value: object) -> None:
        with self._guard:
            self._used(key, value)
            if len(self._held) > self._size:
                del self._held[min(self._held, key=lambda k: self._held[k][0])]


class CallBudget:
    """At most ``calls`` in any ``seconds``: a ring of the last calls' times, in which a new call takes the oldest one's place."""

    def __init__(self, calls: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self._ring, self._seconds, self._clock, self._guard = [float("-inf")] * calls, seconds, clock, threading.Lock()
        self._next = 0

    def spend(self) -> bool:
        with self._guard:
            now, oldest = self._clock(), self._ring[self._next]
            free = now >= oldest + self._seconds
            if free:
                self._ring[self._next] = now
                self._next = (self._next + 1) % len(self._ring)
            return free


@dataclass(frozen=True)
class ExternalSettings:
    enabled: bool = False
    calls_per_minute: int = 20
    attempts: int = 2

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> ExternalSettings:
        number = lambda key, low, high, default: min(high, max(low, int(values.get(key, default))))
        return cls(values.get("enabled", "false").lower() in ("1", "true", "yes"), number("calls_per_minute", 1, 600, 20), number("attempts", 1, 5, 2))


class ExternalSteps:
    """post: a stage's name and payload to its answer. Answers that fail their check are asked for again, then given up."""

    def __init__(self, post: Callable[[str, object], object], settings: ExternalSettings = ExternalSettings(True)):
        self.post, self.settings, self.cache, self.budget = post, settings, AnswerCache(), CallBudget(settings.calls_per_minute)

    def ask(self, stage: str, payload: object, check: Callable[[object], object]) -> object | None:
        key = (stage, repr(payload))
        if not self.settings.enabled or (known := self.cache.look_up(key)) is not None:
            return None if not self.settings.enabled else known
        for _ in range(self.settings.attempts):
            if not self.budget.spend():
                return None
            try:
                answer = check(self.post(stage, payload))
            except (ValueError, OSError):
                continue
            self.cache.keep(key, answer)
            return answer
        return None

    def rerank(self, query: str, candidates: Sequence[object]) -> tuple[list[object], int]:
        """The candidates in the answered order, without repeats or strangers, and how many of its identifiers were no candidates."""
        first = list(candidates)[:MAX_CANDIDATES]

        def check(answer: object) -> list[object]:
            if not isinstance(answer, list):
                raise ValueError("an order is a list")
            return answer

        order = self.ask("rerank", {"query": query, "candidates": first}, check) or []
        valid = list(dict.fromkeys(x for x in order if x in first))
        return [*valid, *(x for x in candidates if x not in valid)], sum(x not in first for x in order)


def inactive(reason: str, candidates: int | None = None) -> dict[str, object]:
    return {"active": False, "reason": reason, **({} if candidates is None else {"candidates": candidates})}
