"""Memory of conversations on a stream of turns: what is summarized, and the last messages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversation import BLANK, RECENT, SUMMARY_CHARS

COLUMNS = "conv_id {kind}, messages long, cursor long, summary string, recent array<struct<role:string,text:string>>"


class Memory(StatefulProcessor):
    """Turns join the conversation in the order of their numbers. One that comes early waits in the list state for those
    before it; a timer that passes ends the wait, and what is there joins in order. What the list's last RECENT messages
    push out goes into the summary, a value state of SUMMARY_CHARS characters."""

    def __init__(self, first: int, patience_ms: int) -> None:
        self.first, self.patience_ms = first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, messages long, cursor long, summary string")
        self.recent = handle.getListState("recent", "role string, said string")
        self.early = handle.getListState("early", "turn long, role string, said string")

    def _held(self) -> tuple[int, int, int, str | None]:
        return self.place.get() if self.place.exists() else (self.first, 0, 0, None)

    def _join(self, key: tuple, turns: list[tuple], next_turn: int) -> pd.DataFrame:
        """The row of the conversation after these turns, which are in order."""
        _, messages, cursor, summary = self._held()
        recent = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        counted = [(role, said) for _, role, said in turns if role in ("user", "assistant") and said]
        recent += counted
        if out := recent[: max(0, len(recent) - RECENT)]:
            lines = "\n".join(f"{role}: {said}" for role, said in out)
            summary = (lines if summary is None else f"{summary}\n{lines}")[-SUMMARY_CHARS:]
            recent = recent[len(out) :]
        messages, cursor = messages + len(counted), cursor + len(out)
        self.place.update((next_turn, messages, cursor, summary))
        if recent:
            self.recent.put(recent)
        return pd.DataFrame({"conv_id": [key[0]], "messages": [messages], "cursor": [cursor], "summary": [summary], "recent": [[{"role": r, "text": s} for r, s in recent]]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        next_turn = self._held()[0]
        waiting = [tuple(x) for x in self.early.get()] if self.early.exists() else []
        waited, latest = bool(waiting), 0
        for b in rows:
            latest = max(latest, int(b["ts"].max().timestamp() * 1000))
            said = b["text"].fillna("").str.strip(BLANK)
            waiting += zip(b["turn"].astype("int64").tolist(), b["role"].tolist(), said.tolist(), strict=True)
        waiting.sort(key=lambda t: t[0])
        joined = []
        while waiting and waiting[0][0] <= next_turn:  # a repeated turn, or one that comes after its wait was ended, follows
            joined.append(waiting.pop(0))
            next_turn = max(next_turn, joined[-1][0] + 1)
        if waiting:
            self.early.put(waiting)
            if not waited:
                self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.patience_ms)
        elif waited:
            self.early.clear()
        if joined:
            yield self._join(key, joined, next_turn)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.early.exists():
            waiting = [tuple(x) for x in self.early.get()]
            self.early.clear()
            yield self._join(key, waiting, waiting[-1][0] + 1)

    def close(self) -> None:
        pass


def conversation_memory(turns: DataFrame, delay: str = "10 minutes", patience_ms: int = 600_000, first: int = 0) -> DataFrame:
    """turns: conv_id, turn, role, text, ts, a stream -> conv_id, messages, cursor, summary, recent after each batch in
    which a conversation grew: its last row is that of conversation.summaries and memory over all turns.

    Turns may come in any batches and in any order; one whose predecessors (from `first`) are missing waits for them
    until event time has gone on by patience_ms from the latest of its batch. State is one row, RECENT messages and what waits, of each conversation.
    A null turn is an error, a null text blank. Needs the state store provider of RocksDB.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    late = turns.select("conv_id", "turn", "role", "text", "ts").withWatermark("ts", delay)
    return late.groupBy("conv_id").transformWithStateInPandas(Memory(first, patience_ms), COLUMNS.format(kind=kind), "Update", "EventTime")
