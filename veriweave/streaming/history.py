"""The case a conversation spoke of last, on a stream of its turns.

State per conversation, with a timer: what each turn said, and the latest of it. A turn that
follows all known ones costs a look at the latest. A late turn is answered from the turns before
it, and turns after it whose answer it changes are told again, so a sink that keeps the newest
answer of a turn holds what the batch form gives. Once the watermark is ``idle`` past the last
turn of a conversation, it is forgotten; a turn that comes later begins it anew. Turns behind the
watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veriweave.operators.questions import said_case

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_MS = 24 * 60 * 60 * 1000


def answers(said: list[tuple[int, str | None]]) -> list[str | None]:
    """For turns in order and the case each named: the case named last before each."""
    out, case = [], None
    for _, named in said:
        out.append(case)
        case = named or case
    return out


def merged(known: list[tuple[int, str | None]], new: list[tuple[int, str | None]]) -> list[tuple[int, str | None]]:
    """Turns to tell, with their answer: the new ones, and known ones that they change. Both lists are in order."""
    before = dict(zip((t for t, _ in known), answers(known)))
    both = sorted((dict(known) | dict(new)).items())
    fresh = {t for t, _ in new}
    return [(t, a) for (t, _), a in zip(both, answers(both)) if t in fresh or before.get(t) != a]


class History(StatefulProcessor):
    """One conversation: its turns so far, and the case named last."""

    def __init__(self, idle_ms: int = IDLE_MS) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The last turn, the case named last up to it, and when the conversation is forgotten.
        self.latest = handle.getValueState("latest", "turn bigint, said string, expires bigint")
        self.turns = handle.getMapState("turns", "turn bigint", "said string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Turns and case numbers only: of a turn that comes twice, the later.
        said_by, at = {}, 0
        for r in rows:
            said_by[r["turn"]] = r["said"]
            at = max(at, r["at"])
        new = sorted(said_by.items())
        latest = self.latest.get() if self.latest.exists() else None
        if latest is None or new[0][0] > latest[0]:
            case = latest[1] if latest else None
            told = []
            for turn, said in new:
                told.append((turn, case))
                case = said or case
            last = new[-1][0]
        else:
            known = sorted((k[0], v[0]) for k, v in self.turns.iterator())
            told = merged(known, new)
            both = sorted((dict(known) | dict(new)).items())
            last, case = both[-1][0], next((s for _, s in reversed(both) if s), None)
        for turn, said in new:
            self.turns.updateValue((turn,), (said,))
        expires = max(at + self.idle_ms, latest[2] if latest else 0)
        if latest is not None and latest[2] != expires:
            self.handle.deleteTimer(latest[2])
        self.handle.registerTimer(expires)
        self.latest.update((last, case, expires))
        for turn, answer in told:
            yield Row(conv_id=key[0], turn=turn, history_case=answer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.latest.clear()
        self.turns.clear()
        return iter(())

    def close(self) -> None:
        pass


def history_stream(turns: DataFrame, time: str, delay: str, text: str = "text", idle_ms: int = IDLE_MS) -> DataFrame:
    """(conv_id, turn, history_case) of a stream of turns, told again where a late turn changes it; for a sink that upserts.

    ``time`` is when a turn was said and ``delay`` how much later than others it may come.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    said = turns.withWatermark(time, delay).filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), said_case(F.col(text)).alias("said"),
        F.unix_millis(time).alias("at"), F.col(time).alias("time"),
    )
    return said.groupBy("conv_id").transformWithState(
        statefulProcessor=History(idle_ms), outputStructType="conv_id bigint, turn bigint, history_case string", outputMode="Update", timeMode="EventTime"
    )
