"""Progress of streams and jobs: totals of what micro-batches have read, and the time left."""

from __future__ import annotations

import threading

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Counts batches, rows and seconds of all streams of a session; add it by spark.streams.addListener(...)."""

    def __init__(self):
        self._lock = threading.Lock()
        self.batches = self.rows = self.ended = 0
        self.seconds = 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self.batches += 1
            self.rows += event.progress.numInputRows
            self.seconds += event.progress.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended += 1

    def rate(self) -> float:
        """Rows a second of work."""
        return self.rows / self.seconds if self.seconds else 0.0

    def left(self, total_rows: int) -> float | None:
        """Seconds until total_rows have been read at the rate so far; None before there is one."""
        return max(0, total_rows - self.rows) / self.rate() if self.rate() else None
