"""Per-key state machines for ``transformWithStateInPandas``.

Rows of a key may arrive in several Arrow batches and in any order, so each processor keeps the
few columns it needs, sorts them by time and id, and folds them into the stored state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ordered(rows: Iterator[pd.DataFrame], cols: list[str], by: list[str]) -> pd.DataFrame:
    parts = [pdf[cols] for pdf in rows]
    return pd.concat(parts).sort_values(by, kind="stable")


class StableFiles(StatefulProcessor):
    """Accept a path once: its mtime is old enough, or two looks in a row saw the same size and mtime."""

    def __init__(self, min_age_s: float):
        self.min_age_s = min_age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "size long, mtime double, accepted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get() if self.seen.exists() else None
        out = []
        for size, mtime, look in ordered(rows, ["size", "mtime_s", "look_s"], ["look_s", "size"]).itertuples(index=False):
            done = bool(last[2]) if last else False
            same = last is not None and int(last[0]) == int(size) and float(last[1]) == float(mtime)
            if not done and (look - mtime > self.min_age_s or same):
                done = True
                out.append((key[0], int(size), float(mtime), float(look)))
            last = (int(size), float(mtime), done)
        self.seen.update(last)
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "mtime_s", "accepted_at_s"])

    def close(self) -> None:
        pass


class EvalLimiter(StatefulProcessor):
    """After every attempt: may the session evaluate again, and with which timeouts."""

    def __init__(self, max_attempts=3, skip_after=2, max_time=300.0, max_recent=2, window_s=60.0):
        self.limits = (max_attempts, skip_after, max_time, max_recent, window_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("limiter", "n long, streak long, spent double, disabled boolean, recent array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        max_attempts, skip_after, max_time, max_recent, window = self.limits
        n, streak, spent, disabled, recent = self.state.get() if self.state.exists() else (0, 0, 0.0, False, [])
        recent = list(recent)
        out = []
        for aid, ts, result, duration in ordered(rows, ["attempt_id", "ts_s", "result", "duration"], ["ts_s", "attempt_id"]).itertuples(index=False):
            failed = result == "FAILURE"
            n, spent = n + 1, spent + float(duration)
            streak = streak + 1 if failed else 0
            recent = [t for t in recent if t >= ts - window] + ([float(ts)] if failed else [])
            disabled = bool(disabled) or streak >= skip_after
            if disabled:
                reason = "expensive_evaluations_disabled"
            elif n >= max_attempts:
                reason = "max_attempts_reached"
            elif streak >= skip_after:
                reason = "consecutive_failures"
            elif spent >= max_time:
                reason = "time_budget_exceeded"
            elif len(recent) >= max_recent:
                reason = "recent_failures"
            else:
                reason = None
            out.append((int(aid), int(key[0]), reason is not None, reason, max(30.0, max_time - spent)))
        self.state.update((int(n), int(streak), float(spent), bool(disabled), recent))
        yield pd.DataFrame(out, columns=["attempt_id", "session_id", "skip", "reason", "time_cap_s"])

    def close(self) -> None:
        pass


class RecentEvents(StatefulProcessor):
    """Running counter per key and its last ``keep`` event labels."""

    def __init__(self, keep: int = 20):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long")
        self.ring = handle.getListState("ring", "seq long, label string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = int(self.total.get()[0]) if self.total.exists() else 0
        held = [(int(s), str(t)) for s, t in self.ring.get()] if self.ring.exists() else []
        for pdf in rows:
            total += int(pdf["amount"].clip(lower=0).sum())
            held = sorted(held + list(zip(pdf["seq"].astype(int), pdf["label"])))[-self.keep:]
        self.total.update((total,))
        self.ring.put(held)
        yield pd.DataFrame({"metric": [key[0]], "total": [total], "recent": [[t for _, t in held]]})

    def close(self) -> None:
        pass
