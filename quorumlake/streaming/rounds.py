"""#159: rounds of work that one run at a time may do: a lease over numbered markers, with a fence for late
writers and a breaker for runs whose steps mostly fail."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from quorumlake.sources.markers import Markers

#: Seconds without news after which a run counts as given up.
ORPHANED = 180
#: Steps of a run, and the share of failed ones beyond which it is broken off.
LEAST_STEPS, MOST_FAILED = 8, 0.5


def breaks(ok: int, failed: int) -> bool:
    """Whether a run with so many steps is broken off."""
    return ok + failed >= LEAST_STEPS and failed / (ok + failed) > MOST_FAILED


class Rounds:
    """The rounds of a job. A claim, the end of a round and the end of a run are each the next marker, which one writer
    gets; the marker's number is the fence of what the round writes.

    Verdicts of a claim: claimed; other_run (an active run isn't the caller's); no_token, stale_token (the round that the
    caller saw isn't the current one); in_flight (the round before hasn't ended); closed (the run has ended).
    """

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], float] = time.time):
        self.markers, self.now = Markers(spark, path), now

    def _state(self) -> tuple[int, dict]:
        number, s = self.markers.last()
        if s.get("status") == "running" and self.now() - s["at"] > ORPHANED:
            s = s | {"status": "orphaned"}
        return number, s

    def claim(self, run: str | None = None, token: int | None = None) -> dict:
        """The verdict on beginning a round, with run, token (the rounds so far) and, if claimed, fence."""
        number, s = self._state()
        active = s.get("status") == "running"
        if run is not None and s.get("run") == run and not active:
            return {"verdict": "closed", "run": run}
        if active and run != s["run"]:
            return {"verdict": "other_run", "run": s["run"], "token": s["rounds"]}
        if active:
            if token is None:
                return {"verdict": "no_token", "run": run, "token": s["rounds"]}
            if s["rounds"] > s["done"]:
                return {"verdict": "in_flight", "run": run, "token": s["rounds"]}
            if token != s["rounds"]:
                return {"verdict": "stale_token", "run": run, "token": s["rounds"]}
        else:
            s = {"run": uuid.uuid4().hex, "rounds": 0, "done": 0, "ok": 0, "failed": 0}
        after = s | {"status": "running", "rounds": s["rounds"] + 1, "at": self.now()}
        if self.markers.put(number + 1, after):
            return {"verdict": "claimed", "run": after["run"], "token": after["rounds"], "fence": number + 1}
        s = self._state()[1]
        if s.get("run") != after["run"]:
            return {"verdict": "other_run", "run": s.get("run"), "token": s.get("rounds")}
        return {"verdict": "in_flight" if s["rounds"] > s["done"] else "stale_token", "run": s["run"], "token": s["rounds"]}

    def current(self, fence: int) -> bool:
        """Whether the round of this fence is still the one that runs."""
        number, s = self._state()
        return number == fence and s.get("status") == "running" and s["rounds"] > s["done"]

    def finish(self, fence: int, ok: int = 0, failed: int = 0, more: bool = True) -> str:
        """Ends a round with its counts of steps: running, drained (no more work), broken, or late if the round isn't current any more."""
        if not self.current(fence):
            return "late"
        s = self.markers.read(fence)
        s = s | {"done": s["rounds"], "ok": s["ok"] + ok, "failed": s["failed"] + failed, "at": self.now()}
        s["status"] = "broken" if breaks(s["ok"], s["failed"]) else "running" if more else "drained"
        return s["status"] if self.markers.put(fence + 1, s) else "late"
