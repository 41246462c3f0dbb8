"""Long-running streams that are started together and restarted when they fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery


class Supervisor:
    """Keeps one stream per name running.

    A stream that fails is started again from its checkpoint, at most
    ``restarts`` times each; after that its error is raised by ``check``. A stream
    that ended without error (a drain) is left alone.
    """

    def __init__(self, starts: Mapping[str, Callable[[], StreamingQuery]], restarts: int = 3):
        self._starts, self._left = dict(starts), {name: restarts for name in starts}
        self.queries: dict[str, StreamingQuery] = {}

    def start(self) -> Supervisor:
        for name, run in self._starts.items():
            self.queries[name] = run()
        return self

    def check(self) -> list[str]:
        """Restart what has failed; returns the names."""
        again = []
        for name, query in self.queries.items():
            error: StreamingQueryException | None = None if query.isActive else query.exception()
            if error is None:
                continue
            if not self._left[name]:
                raise error
            self._left[name] -= 1
            self.queries[name] = self._starts[name]()
            again.append(name)
        return again

    def watch(self, seconds: float, every: float = 1.0) -> None:
        """Check again and again for that long."""
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            self.check()
            time.sleep(min(every, max(0.0, end - time.monotonic())))

    def process_all(self) -> None:
        """Wait until every stream has handled what is there now."""
        for query in self.queries.values():
            if query.isActive:
                query.processAllAvailable()

    def stop(self) -> None:
        for query in self.queries.values():
            query.stop()
