"""Lines of byte streams that arrive in pieces: the open line is state, carried from one micro-batch to the next.

A stream is told by an id; its pieces are numbered from 0. A chunk ends after a newline, or where a line without one has reached
`cap` and one bytes; each chunk is redacted by itself. What is cut by two pieces (a token, a character, a line) is whole in its chunk.
A stream's last part is flushed when a piece says `last`, or after `idle` without a new piece.

Pieces that were seen before (a source that sends again) change nothing; pieces that come early are held until those
before them are there, or until the stream has been idle. State and timers live in Spark's state store, so a query that starts again from its
checkpoint goes on in the middle of a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewall.functions.redact import LINE_BYTES, redact

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = "stream string, number long, chunk binary"


class LineCarry(StatefulProcessor):
    """Pieces (piece, data, last) of a stream -> its chunks, in order."""

    def __init__(self, cap: int = LINE_BYTES, idle_ms: int | None = None):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, number long, open binary")
        self.early = handle.getMapState("early", "piece long", "data binary, last boolean")

    def _chunks(self, open_: bytes, data: bytes) -> tuple[list[bytes], bytes]:
        """All chunks that end in data, and what stays open. Only new bytes are searched for a newline."""
        out, text, seen, start = [], open_ + data, len(open_), 0
        while True:
            to = text.find(b"\n", max(start, seen), start + self.cap)
            end = to + 1 if to >= 0 else start + self.cap
            if end > len(text):
                return out, text[start:]
            out.append(text[start:end])
            start = end

    def _rows(self, key: tuple, chunks: list[bytes], number: int) -> Iterator[pd.DataFrame]:
        if chunks:
            yield pd.DataFrame({"stream": key[0], "number": range(number, number + len(chunks)), "chunk": chunks})

    def _drained(self, key: tuple, fresh: dict[int, tuple[bytes, bool]], skip: bool) -> Iterator[pd.DataFrame]:
        """Takes pieces as far as they follow each other; with skip, also over gaps."""
        next_, number, open_ = self.at.get() if self.at.exists() else (0, 0, b"")
        held = {int(k[0]): (bytes(v[0]), bool(v[1])) for k, v in self.early.iterator()} if self.early.exists() else {}
        waiting, chunks = {**fresh, **held}, []
        while waiting:
            piece = next_ if next_ in waiting else min(waiting)
            if piece > next_ and not skip:
                break
            data, last = waiting.pop(piece)
            if piece in held:
                self.early.removeKey((piece,))
            if piece < next_:
                continue
            more, open_ = self._chunks(open_, data)
            if last and open_:
                more, open_ = [*more, open_], b""
            chunks += more
            next_ = piece + 1
        if skip and open_:
            chunks, open_ = [*chunks, open_], b""
        for piece, value in waiting.items():
            if piece not in held:
                self.early.updateValue((piece,), value)
        self.at.update((next_, number + len(chunks), bytes(open_)))
        yield from self._rows(key, chunks, number)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = {}
        for part in rows:
            for piece, data, last in zip(part["piece"], part["data"], part["last"], strict=True):
                fresh.setdefault(int(piece), (bytes(data) if data is not None else b"", bool(last)))
        yield from self._drained(key, fresh, skip=False)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drained(key, {}, skip=True)

    def close(self) -> None:
        pass


def chunks(pieces: DataFrame, cap: int = LINE_BYTES, idle_ms: int | None = None) -> DataFrame:
    """pieces (stream string, piece long, data binary, last boolean; a table or a stream) -> stream, number, chunk (binary, not redacted).

    Streams need the RocksDB state store (ROCKS). Pieces of a null stream or number are left out; a null `last` is false.
    """
    _ = pieces.sparkSession.streams  # its manager starts what state stores of batch jobs ask for
    known = pieces.where("stream is not null and piece is not null").select("stream", F.col("piece").cast("long").alias("piece"), "data", F.coalesce("last", F.lit(False)).alias("last"))
    return known.groupBy("stream").transformWithStateInPandas(LineCarry(cap, idle_ms), CHUNK, "Append", "ProcessingTime" if idle_ms is not None else "None")


def redacted_bytes(chunk):
    """Bytes without known tokens; a byte stands for a character, so that bytes which are no UTF-8 stay."""
    return F.encode(redact(F.decode(chunk, "ISO-8859-1")), "ISO-8859-1")


def redacted_chunks(pieces: DataFrame, cap: int = LINE_BYTES, idle_ms: int | None = None) -> DataFrame:
    """chunks() without known tokens: stream, number, chunk."""
    return chunks(pieces, cap, idle_ms).withColumn("chunk", redacted_bytes(F.col("chunk")))
