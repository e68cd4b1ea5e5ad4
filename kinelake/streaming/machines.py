"""Record-at-a-time state machines. One class serves a stream (keyed state) and a batch (grouped rows in order).

A machine turns one input row into output rows: one, several or none. Its ``state`` holds scalars, :class:`Ring` and
:class:`Log`. On a stream a ring lives in map state and a log in list state: a row touches one slot, appending reads nothing
back, and a log is read only where its values are wanted. A ring is bounded by its capacity, a log by one recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, MutableMapping
from typing import Any

POLICY, ARMED, ROLLED_BACK, TAKEOVER = "policy", "armed", "rolled_back", "takeover"


class Ring:
    """The last ``capacity`` values. The k-th that was appended is in slot k modulo ``capacity`` of ``slots``."""

    def __init__(self, capacity: int, start: int = 0, end: int = 0, slots: MutableMapping[int, int] | None = None):
        self.capacity, self.start, self.end = capacity, start, end
        self.slots = {} if slots is None else slots

    def append(self, value: int) -> None:
        self.slots[self.end % self.capacity] = value
        self.end += 1
        self.start = max(self.start, self.end - self.capacity)

    def clear(self) -> None:
        self.start = self.end

    @property
    def first(self) -> int:
        return self.slots[self.start % self.capacity]

    def __len__(self) -> int:
        return self.end - self.start

    def __iter__(self) -> Iterator[int]:
        return (self.slots[k % self.capacity] for k in range(self.start, self.end))

    def __eq__(self, other: Iterable) -> bool:
        return list(self) == list(other)


class Log:
    """Values in order, only ever appended or all cleared. ``stored`` gives those of before, ``added`` has the new ones."""

    def __init__(self, size: int = 0, stored: Callable[[], Iterable[int]] = tuple):
        self.size, self.stored, self.added, self.cleared = size, stored, [], False

    def append(self, value: int) -> None:
        self.added.append(value)
        self.size += 1

    def clear(self) -> None:
        self.size, self.added, self.cleared = 0, [], True

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        if not self.cleared:
            yield from self.stored()
        yield from self.added

    def __eq__(self, other: Iterable) -> bool:
        return list(self) == list(other)


class Machine:
    """``output`` is the DDL of the rows that :meth:`tick` gives."""

    output = ""

    def __init__(self, state: dict[str, Any] | None = None):
        self.state = state or self.initial()

    def initial(self) -> dict[str, Any]:
        return {}

    def tick(self, row: dict[str, Any]) -> dict[str, Any] | list[dict[str, Any]] | None:
        raise NotImplementedError


class Collector(Machine):
    """Preference collection: a failure press rolls back, the trigger takes over, a commit press saves the pair.

    Input: event_id, failure, commit, trigger (0 to 1), pending (a batch is still running). Presses count on their rising
    edge. A press while a batch runs arms the rollback; it happens when the batch is done, and what ran after the press
    is rolled back but never part of the loser.
    """

    output = "event_id long, phase string, outcome string, n_loser int, n_winner int"
    capacity, horizon, threshold = 72, 64, 0.5

    def initial(self) -> dict[str, Any]:
        return {"phase": POLICY, "buffer": Ring(self.capacity), "loser": Log(), "winner": Log(), "failure": False, "commit": False, "armed_at": None}

    def _roll_back(self, candidates: list[int]) -> str:
        s = self.state
        if not candidates:
            s["phase"] = POLICY
            return "nothing_to_roll_back"
        s["loser"].clear()
        if len(candidates) >= self.horizon:
            for x in candidates[-self.horizon :]:
                s["loser"].append(x)
        s["phase"] = ROLLED_BACK
        return "rolled_back"

    def _clear(self) -> None:
        for held in ("buffer", "loser", "winner"):
            self.state[held].clear()
        self.state |= {"phase": POLICY, "armed_at": None}

    def _saved(self, pair: int) -> None:
        """Called with the id of the press that saves, while both recordings are still there."""

    def tick(self, row: dict[str, Any]) -> dict[str, Any]:
        s = self.state
        failure, commit = bool(row["failure"]) and not s["failure"], bool(row["commit"]) and not s["commit"]
        active = float(row["trigger"] or 0.0) >= self.threshold
        s["failure"], s["commit"] = bool(row["failure"]), bool(row["commit"])
        outcome, counts = "", None
        if s["phase"] == ARMED:
            if not row["pending"]:
                cut = s["armed_at"]
                s["armed_at"] = None
                outcome = self._roll_back([x for x in s["buffer"] if x <= cut])
            else:
                s["buffer"].append(row["event_id"])
        elif s["phase"] == POLICY:
            if failure and row["pending"]:
                s["phase"], s["armed_at"], outcome = ARMED, row["event_id"], "rollback_deferred"
            elif failure:
                outcome = self._roll_back(list(s["buffer"]))
            else:
                s["buffer"].append(row["event_id"])
        elif failure:
            outcome = "discarded"
            self._clear()
        else:
            if s["phase"] == TAKEOVER:
                s["winner"].append(row["event_id"])
            if active:
                s["phase"] = TAKEOVER
            if commit:
                counts = len(s["loser"]), len(s["winner"])
                outcome = "saved" if all(counts) else "incomplete"
                if outcome == "saved":
                    self._saved(row["event_id"])
                self._clear()
        n_loser, n_winner = counts or (len(s["loser"]), len(s["winner"]))
        return {"event_id": row["event_id"], "phase": s["phase"], "outcome": outcome, "n_loser": n_loser, "n_winner": n_winner}


class PairRecorder(Collector):
    """The same collection, of which only the saved pairs come out: one row for each step of the loser and of the winner."""

    output = "pair_id long, role string, position int, event_id long"

    def _saved(self, pair: int) -> None:
        for role in ("loser", "winner"):
            self.rows += [{"pair_id": pair, "role": role, "position": i, "event_id": x} for i, x in enumerate(self.state[role])]

    def tick(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        self.rows: list[dict[str, Any]] = []
        super().tick(row)
        return self.rows


class RateGate(Machine):
    """Passes a row if it comes at least ``interval`` seconds after the last one that passed."""

    output = "event_id long, t double"
    interval = 43200.0

    def initial(self) -> dict[str, Any]:
        return {"last": None}

    def tick(self, row: dict[str, Any]) -> dict[str, Any] | None:
        if self.state["last"] is not None and row["t"] - self.state["last"] < self.interval:
            return None
        self.state["last"] = row["t"]
        return {"event_id": row["event_id"], "t": row["t"]}


class ErrorTrip(Machine):
    """Counts failures in a row; trips at ``limit``."""

    output = "event_id long, streak long, tripped boolean"
    limit = 5

    def initial(self) -> dict[str, Any]:
        return {"streak": 0}

    def tick(self, row: dict[str, Any]) -> dict[str, Any]:
        self.state["streak"] = self.state["streak"] + 1 if row["failed"] else 0
        return {"event_id": row["event_id"], "streak": self.state["streak"], "tripped": self.state["streak"] >= self.limit}


class DeadMan(Machine):
    """A command counts as zero if nothing came for ``silence`` seconds before it."""

    output = "event_id long, held double"
    silence = 21600.0

    def initial(self) -> dict[str, Any]:
        return {"last": None}

    def tick(self, row: dict[str, Any]) -> dict[str, Any]:
        late = self.state["last"] is not None and row["t"] - self.state["last"] > self.silence
        self.state["last"] = row["t"]
        return {"event_id": row["event_id"], "held": 0.0 if late else row["value"]}


class GenerationFence(Machine):
    """Drops rows of an older generation than the newest seen."""

    output = "event_id long, generation long"

    def initial(self) -> dict[str, Any]:
        return {"newest": None}

    def tick(self, row: dict[str, Any]) -> dict[str, Any] | None:
        newest = self.state["newest"]
        if newest is not None and row["generation"] < newest:
            return None
        self.state["newest"] = row["generation"]
        return {"event_id": row["event_id"], "generation": row["generation"]}


class RingBuffer(Machine):
    """The ids of the last ``capacity`` rows."""

    output = "event_id long, held long, oldest long"
    capacity = 72

    def initial(self) -> dict[str, Any]:
        return {"ids": Ring(self.capacity)}

    def tick(self, row: dict[str, Any]) -> dict[str, Any]:
        ids = self.state["ids"]
        ids.append(row["event_id"])
        return {"event_id": row["event_id"], "held": len(ids), "oldest": ids.first}
