"""Server-sent events from byte chunks that are cut anywhere, and live counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

OUTPUT = "stream_id long, seq long, event_type string, data string"
_BLANK = re.compile(rb"\r\n\r\n|\n\n")
#: Bytes before the last that a blank line can have begun with.
_REACH = 3


def parse_block(block: str) -> tuple[str | None, str] | None:
    """(event type, data) of a block: the last event line, data lines trimmed and joined; None without data."""
    kind, data = None, []
    for line in block.replace("\r\n", "\n").split("\n"):
        if line.startswith("event:"):
            kind = line[6:].strip(" ")
        elif line.startswith("data:"):
            data.append(line[5:].strip(" "))
    return (kind, "\n".join(data)) if data else None


class Splitter:
    """Cuts a stream of bytes at blank lines; each byte is searched once. What is open is kept as it came."""

    def __init__(self, pieces: list[bytes] | None = None, end: bytes = b"") -> None:
        self.pieces = pieces if pieces is not None else []
        self.end = end  # the last bytes of what is open

    def feed(self, new: bytes) -> list[bytes]:
        """The blocks that end in the new bytes, without their blank lines."""
        blocks, begin, seen = [], 0, self.end + new
        before = len(self.end)
        for m in _BLANK.finditer(seen):
            if begin == 0:  # the first of them ends what was open
                whole = b"".join(self.pieces)
                blocks.append(whole[: len(whole) - before] + seen[: m.start()])
                self.pieces = []
            else:
                blocks.append(seen[begin : m.start()])
            begin = m.end()
        if begin:
            self.pieces = [seen[begin:]] if begin < len(seen) else []
            self.end = seen[begin:][-_REACH:]
        else:
            self.pieces.append(new)
            self.end = seen[-_REACH:]
        return blocks


def parse_bytes(block: bytes) -> tuple[str | None, str] | None:
    """The same for bytes; None if they aren't UTF-8."""
    try:
        return parse_block(block.decode())
    except UnicodeDecodeError:
        return None


class ChunkProcessor(StatefulProcessor):
    """State of a stream: the pieces of its open block, the numbers of the next chunk and event, chunks that came early."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        field = lambda **kinds: StructType([StructField(k, v()) for k, v in kinds.items()])
        self.handle = handle
        self.open = handle.getValueState("open", field(end=BinaryType, pieces=LongType, chunk=LongType, event=LongType, over=BooleanType))
        self.piece = handle.getMapState("piece", field(n=LongType), field(data=BinaryType))
        self.early = handle.getMapState("early", field(chunk=LongType), field(data=BinaryType, end=BooleanType))

    def _clear(self) -> None:
        for state in (self.open, self.piece, self.early):
            state.clear()

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        end, stored, chunk, event, over = self.open.get() if self.open.exists() else (b"", 0, 0, 0, False)
        stored, chunk, event = int(stored), int(chunk), int(event)
        waiting, latest = {}, None
        if self.early.exists():
            waiting = {int(k[0]): (bytes(v[0]), bool(v[1])) for k, v in self.early.iterator()}
        held = set(waiting)
        for frame in rows:
            for row in frame.itertuples(index=False):
                if row.chunk >= chunk:
                    waiting.setdefault(int(row.chunk), (bytes(row.data or b""), bool(row.end)))
                if self.idle_ms:
                    latest = max(latest or 0, int(row.at))
        out, splitter = [], Splitter(end=bytes(end))
        while chunk in waiting and not over:
            data, over = waiting.pop(chunk)
            if stored and _BLANK.search(splitter.end + data):
                splitter.pieces = [bytes(self.piece.getValue((n,))[0]) for n in range(stored)] + splitter.pieces
                for n in range(stored):
                    self.piece.removeKey((n,))
                stored = 0
            for parsed in filter(None, map(parse_bytes, splitter.feed(data))):
                out.append((key[0], event, *parsed))
                event += 1
            chunk += 1
        if over and not self.idle_ms:
            self._clear()
        else:
            for k in held - set(waiting):
                self.early.removeKey((k,))
            for k in set(waiting) - held if not over else ():
                self.early.updateValue((k,), waiting[k])
            if splitter.pieces and not over:
                self.piece.updateValue((stored,), (b"".join(splitter.pieces),))
                stored += 1
            if over:  # a mark stays until the time is up, so that chunks that come again are known as late
                self.piece.clear()
                self.early.clear()
                splitter.end, stored = b"", 0
            self.open.update((splitter.end, stored, chunk, event, bool(over)))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                latest = max(latest or 0, int(at) - self.idle_ms)
                self.handle.deleteTimer(at)
            self.handle.registerTimer((latest or 0) + self.idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "event_type", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self._clear()
        yield pd.DataFrame([], columns=["stream_id", "seq", "event_type", "data"])

    def close(self) -> None:
        pass


def events_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(stream_id, seq, event_type, data) from a stream of (stream_id, chunk, data: binary, end).

    Chunks are taken in the order of their numbers from 0, also across micro-batches, and may be cut anywhere, inside a
    character too; an event is given out when its blank line has come. Blocks that aren't UTF-8, or have no data, are
    left out, and so is what is open at the end. A stream's state goes with its chunk of end. With idle_ms, for which
    chunks has a watermark on its column ts, it goes when the watermark is so much later than the stream's last chunk,
    and a mark of an ended stream stays until then. The session has to use restore.STATE_PROVIDER.
    """
    columns = chunks.select("stream_id", "chunk", "data", "end", *(["ts", F.unix_millis("ts").alias("at")] if idle_ms else []))
    return columns.groupBy("stream_id").transformWithStateInPandas(ChunkProcessor(idle_ms), OUTPUT, "Append", "EventTime" if idle_ms else "None")


def live_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of a stream by keys, for outputs that take updates."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
