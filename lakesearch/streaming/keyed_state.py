"""Order-dependent per-key logic on streams: lifecycle moves and keyed requests.

Both are stateful processors with a value state of one small row a key, kept in RocksDB (``tables.write_updates`` with
``keyed=True`` starts them so). A key's rows of a micro-batch are put in order before they are applied; earlier batches are
never read again.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakesearch.operators.experience import TRANSITIONS


class Lifecycle(StatefulProcessor):
    """The state of an item is its current status alone."""

    def __init__(self, initial: str):
        self.initial, self.allowed = initial, frozenset(TRANSITIONS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = now = self.status.get()[0] if self.status.exists() else self.initial
        for target, seq in sorted(((r.target, r.seq) for r in rows), key=lambda x: x[1]):
            if (now, target) in self.allowed:
                yield Row(experience_id=key[0], seq=seq, from_status=now, to_status=target)
                now = target
        if now != before:
            self.status.update((now,))

    def close(self) -> None:
        pass


def lifecycle(requests: DataFrame, initial: str = "candidate") -> DataFrame:
    """History rows of the transition requests that are allowed when they arrive.

    ``requests``: experience_id, target, seq. A micro-batch is applied in seq
    order. An item that never moved has no state.
    """
    kind = requests.schema["experience_id"].dataType.simpleString()
    rows = requests.select("experience_id", "target", "seq").groupBy("experience_id")
    return rows.transformWithState(Lifecycle(initial), f"experience_id {kind}, seq bigint, from_status string, to_status string", "append", "None")


class Requests(StatefulProcessor):
    """The open window of a key: when it began, and what was asked. A timer at its end removes it."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened bigint, digest string")

    def _end(self, opened: int) -> int:
        """First millisecond after the window."""
        return (opened + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = opened, digest = tuple(self.window.get()) if self.window.exists() else (None, None)
        for at, seq, request_hash in sorted(((r.micros, r.seq, r.request_hash) for r in rows), key=lambda x: x[:2]):
            if opened is None or at > opened + self.ttl:
                opened, digest, outcome = at, request_hash, "first"
            else:
                outcome = "replay" if request_hash == digest else "conflict"
            yield Row(actor=key[0], key=key[1], seq=seq, outcome=outcome)
        if (opened, digest) != held:
            if held[0] is not None:
                self.handle.deleteTimer(self._end(held[0]))
            self.window.update((opened, digest))
            self.handle.registerTimer(self._end(opened))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_requests(requests: DataFrame, ttl_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Outcome of each delivery (first, replay, conflict) inside a time to live.

    ``requests``: actor, key, request_hash, at, seq. A delivery later than the
    watermark (``lateness`` behind the newest) is dropped: its window may be gone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    rows = requests.selectExpr("actor", "key", "request_hash", "at", "unix_micros(at) AS micros", "seq").withWatermark("at", lateness)
    return rows.groupBy("actor", "key").transformWithState(
        Requests(ttl_seconds), f"actor {kinds['actor']}, key {kinds['key']}, seq bigint, outcome string", "append", "EventTime"
    )
