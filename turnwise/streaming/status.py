"""A recording's status, told while it streams: the watchdog's state beside the levels, and a line every few seconds."""

import logging
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnwise.operators import sessions as S

log = logging.getLogger(__name__)


class Watchdog:
    """Calibrating over the first blocks, waiting for speech, then armed; silence counts from the last activity."""

    def __init__(self, need: int, poll: float = S.POLL, state: tuple | None = None):
        self.need, self.poll = need, poll
        self.heard, self.thr, self.silence, self.armed = ([], -1.0, 0.0, False) if state is None else (list(state[0]), *state[1:4])

    def update(self, mic: float, system: float | None) -> None:
        if self.thr < 0:
            self.heard.append(float(mic))
            if len(self.heard) == self.need:
                self.thr, self.heard = max(sorted(self.heard)[self.need // 2] * S.FACTOR, S.MIC_FLOOR), []
            return
        active = mic > self.thr or (system is not None and system > S.SYSTEM_LIMIT)
        self.armed = self.armed or active
        self.silence = 0.0 if active or not self.armed else self.silence + self.poll

    @property
    def name(self) -> str:
        return "CALIBRATING" if self.thr < 0 else "ARMED" if self.armed else "WAITING_FOR_SPEECH"

    def state(self) -> tuple:
        return self.heard, self.thr, self.silence, self.armed


def states_stream(blocks: DataFrame, poll: float = S.POLL, calibration: float = S.CALIBRATION) -> DataFrame:
    """session_id, i, mic, system, state, silence: how each session of a micro-batch stands after it.

    blocks: session_id long, i long, mic double, system double (null if there is none)."""
    need = math.ceil(calibration / poll)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dog = Watchdog(need, poll, state.get if state.exists else None)
        row = None
        for row in pd.concat(list(batches)).sort_values("i").itertuples():
            dog.update(row.mic, None if pd.isna(row.system) else row.system)
        state.update(dog.state())
        yield pd.DataFrame([(key[0], row.i, row.mic, row.system, dog.name, dog.silence)], columns=["session_id", "i", "mic", "system", "state", "silence"])

    return blocks.groupBy("session_id").applyInPandasWithState(update, "session_id long, i long, mic double, system double, state string, silence double", "heard array<double>, thr double, silence double, armed boolean", "append", GroupStateTimeout.NoTimeout)


def line(observed: dict) -> str:
    """The line of a micro-batch's observed metrics; a missing system channel shows as a dash."""
    system = observed.get("system_rms")
    state = f" state={observed['state']}" if observed.get("state") else ""
    quiet = f" quiet for {observed['silence']:.0f}s" if observed.get("state") == "ARMED" and observed.get("silence") else ""
    return f"mic_rms={observed['mic_rms']:.4f} sys_rms={'-' if system is None else f'{system:.4f}'}{state}{quiet}"


class StatusLines(StreamingQueryListener):
    """Emits a line of what stateful.with_status observed, every `interval` seconds at most."""

    def __init__(self, emit: Callable[[str], None] = log.info, interval: float = 5.0, name: str = "status", clock: Callable[[], float] = time.monotonic):
        self.emit, self.interval, self.name, self.clock, self.last = emit, interval, name, clock, -math.inf

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = (event.progress.observedMetrics or {}).get(self.name)
        observed = row.asDict() if row else {}
        if observed.get("mic_rms") is None or self.clock() - self.last < self.interval:
            return
        self.last = self.clock()
        self.emit(line(observed))
