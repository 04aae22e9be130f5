"""Restoring originals in streamed responses: the vault and an incremental tokenizer per response, kept as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.restoring import CLOSE, Known, Restorer

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ended responses of a conversation that are remembered, so that a delta of one that comes again is known as late.
MOST_ENDED = 256
OUTPUT = "conv_id long, response_id long, seq long, text string"


class RestoreProcessor(StatefulProcessor):
    """State of a conversation: its vault, the tokenizer of each open response and the next number in sequence, the
    pieces of its open token, each as it came, and deltas that came too early. A response's state goes when its end
    has come, or after `idle` without input; the numbers of the last ended ones stay."""

    def __init__(self, ttl_ms: int | None, idle_ms: int | None):
        self.ttl_ms, self.idle_ms = ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        field = lambda **kinds: StructType([StructField(k, v()) for k, v in kinds.items()])
        self.handle = handle
        self.vault = handle.getValueState("vault", field(vault=StringType), self.ttl_ms)
        self.open = handle.getMapState("open", field(response_id=LongType), field(held=StringType, phase=IntegerType, pieces=LongType, next=LongType), self.ttl_ms)
        self.piece = handle.getMapState("piece", field(response_id=LongType, n=LongType), field(text=StringType), self.ttl_ms)
        self.early = handle.getMapState("early", field(response_id=LongType, seq=LongType), field(delta=StringType, end=BooleanType), self.ttl_ms)
        self.ended = handle.getValueState("ended", field(responses=StringType), self.ttl_ms)

    def _known(self) -> Known:
        known = json.loads(self.vault.get()[0]) if self.vault.exists() else {}
        return Known(known.get("by_id", {}), known.get("by_display", {}), known.get("by_synthetic", {}))

    def _stored(self, response: int, count: int) -> list[str]:
        """The pieces of a response's open token, taken out of the state."""
        found = [self.piece.getValue((response, n))[0] for n in range(count)]
        for n in range(count):
            self.piece.removeKey((response, n))
        return found

    def _goes_on(self, known: Known, response: int) -> tuple[Restorer, int, int]:
        """(tokenizer, pieces in the state, next number) of a response."""
        held, phase, pieces, expected = self.open.getValue((response,)) if self.open.containsKey((response,)) else ("", 0, 0, 0)
        return Restorer(known, held, int(phase)), int(pieces), int(expected)

    def _settle(self, response: int, restorer: Restorer, pieces: int, delta: str, end: bool) -> tuple[str, int]:
        """(restored text, pieces left in the state) of the next delta; pieces are read only when the token ends."""
        if pieces and (end or CLOSE in restorer.held + delta):
            restorer.pieces, pieces = self._stored(response, pieces) + restorer.pieces, 0
        text = restorer.feed(delta)
        return (text + restorer.finish() if end else text), pieces

    def handleInputRows(self, key, rows, timer_values) -> Iterator:
        import pandas as pd

        new: dict[int, dict[int, tuple[str, bool]]] = {}
        for frame in rows:
            for row in frame.itertuples(index=False):
                if isinstance(row.vault, str):
                    self.vault.update((row.vault,))
                else:
                    new.setdefault(int(row.response_id), {}).setdefault(int(row.seq), (row.delta or "", bool(row.end)))
        over = json.loads(self.ended.get()[0]) if self.ended.exists() else []
        for response in over:
            new.pop(response, None)
        for response, seq in [tuple(map(int, k)) for k in self.early.keys()] if self.early.exists() else []:
            if response in new:
                held = self.early.getValue((response, seq))
                new[response].setdefault(seq, (held[0], bool(held[1])))
                self.early.removeKey((response, seq))
        out, known, before = [], self._known(), len(over)
        for response, waiting in new.items():
            restorer, pieces, expected = self._goes_on(known, response)
            ended = False
            while not ended and expected in waiting:
                delta, ended = waiting.pop(expected)
                text, pieces = self._settle(response, restorer, pieces, delta, ended)
                out.append((key[0], response, expected, text))
                expected += 1
            if ended:
                over.append(response)
                if self.open.containsKey((response,)):
                    self.open.removeKey((response,))
                continue
            if restorer.phase and restorer.pieces:
                self.piece.updateValue((response, pieces), ("".join(restorer.pieces),))
                pieces += 1
            self.open.updateValue((response,), (restorer.held, restorer.phase, pieces, expected))
            for seq, (delta, end) in waiting.items():
                if seq >= expected:
                    self.early.updateValue((response, seq), (delta, end))
        if len(over) > before:
            self.ended.update((json.dumps(over[-MOST_ENDED:]),))
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "response_id", "seq", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """What responses without an end still hold, when their time is up; nothing of the conversation stays."""
        import pandas as pd

        out, known = [], self._known()
        for (response,) in [tuple(map(int, k)) for k in self.open.keys()]:
            restorer, pieces, expected = self._goes_on(known, response)
            restorer.pieces = self._stored(response, pieces)
            out.append((key[0], response, expected, restorer.finish()))
        for state in (self.vault, self.open, self.piece, self.early, self.ended):
            state.clear()
        yield pd.DataFrame(out, columns=["conv_id", "response_id", "seq", "text"])

    def close(self) -> None:
        pass


def restore_stream(rows: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, response_id, seq, text) from a stream of (conv_id, response_id, seq, delta, end, vault).

    A row with vault, the JSON of the maps by_id, by_display and by_synthetic, sets the conversation's vault and
    has no delta; it counts for the deltas of its micro-batch and later ones. Deltas are taken in the order of seq
    from 0, also across micro-batches; a response ends with its row of end, and its state goes; deltas that come
    again after it are left out, for the last MOST_ENDED responses of a conversation. With ttl_ms, state that isn't
    touched for so long goes too; with idle_ms, a conversation without rows for so long gives out what its responses
    hold, and all of its state goes; both need a trigger that goes on, since a run until the input ends would wait for
    them for ever. The session has to use STATE_PROVIDER.
    """
    timed = "ProcessingTime" if ttl_ms or idle_ms else "None"
    return rows.groupBy("conv_id").transformWithStateInPandas(RestoreProcessor(ttl_ms, idle_ms), OUTPUT, "Append", timed)
