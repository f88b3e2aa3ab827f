"""What a failure means for the queries of an application, and when to stop trying."""

from __future__ import annotations

import time
from collections import deque


class EngineError(RuntimeError):
    """Ends the application."""


class Fatal(EngineError):
    """Ends the application at once."""


class Retryable(EngineError):
    """The query may start again from its checkpoint."""


class Revertable(EngineError):
    """The batch at hand is undone; the query may start again from its checkpoint."""


#: Causes of failed queries that another try may not meet, by the names in their messages.
PASSING = ("TimeoutException", "ConnectException", "SocketException", "ExecutorLostFailure", "FetchFailed", "ConcurrentModificationException")


def classified(error: BaseException) -> EngineError:
    """The error itself if it is of a class above; others are Retryable by their cause, or Fatal."""
    seen = error
    while seen is not None:
        if isinstance(seen, EngineError):
            return seen
        seen = seen.__cause__
    # an error raised inside a batch function reaches the query by its text only
    text = str(error)
    for kind in (Retryable, Revertable):
        if f"errors.{kind.__name__}:" in text or any(name in text for name in PASSING) and kind is Retryable:
            return kind(text)
    return Fatal(text)


class CircuitBreaker:
    """Opens after so many failures within a time; while it is open nothing is tried."""

    def __init__(self, failures: int = 5, within: float = 60.0, rest: float = 30.0, clock=time.monotonic):
        self.failures, self.within, self.rest, self.clock = failures, within, rest, clock
        self.seen: deque[float] = deque()
        self.opened: float | None = None

    def failed(self) -> None:
        now = self.clock()
        self.seen.append(now)
        while self.seen and self.seen[0] < now - self.within:
            self.seen.popleft()
        if len(self.seen) >= self.failures:
            self.opened = now

    def closed(self) -> bool:
        if self.opened is not None and self.clock() - self.opened >= self.rest:
            self.opened = None
            self.seen.clear()
        return self.opened is None
