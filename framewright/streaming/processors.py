"""Keyed state machines over ordered packets, for streams and for tables.

A processor is a small class with ``push(row) -> rows`` and ``finish() -> rows`` and picklable state. ``run_batch`` feeds
it a table in order; ``run_stream`` keeps it in Structured Streaming's state, one for each key, so that a stream cut into
any micro-batches gives the rows that the batch gives. State changes only when a push succeeds; what a failure does is the
policy's: "sticky" ends the key, "reset" starts anew, "skip" drops the row.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Rows = list[dict]


class Reorder:
    """Pictures by presentation time out of a buffer of ``capacity``; an end row, or the end, empties it."""

    schema = "n long, pts long, released_by long"

    def __init__(self, capacity: int = 4):
        self.capacity, self.heap = capacity, []

    def push(self, row: dict) -> Rows:
        if row.get("end"):
            return self.finish()
        heapq.heappush(self.heap, (row["pts"], row["n"]))
        if len(self.heap) <= self.capacity:
            return []
        pts, n = heapq.heappop(self.heap)
        return [{"n": n, "pts": pts, "released_by": row["n"]}]

    def finish(self) -> Rows:
        out = [{"n": n, "pts": pts, "released_by": None} for pts, n in (heapq.heappop(self.heap) for _ in range(len(self.heap)))]
        return out


class AudioClock:
    """Times of frames from the last anchor and the samples since, by one division."""

    schema = "n long, ns long"

    def __init__(self, rate: int = 48000):
        self.rate, self.anchor, self.samples = rate, None, 0

    def push(self, row: dict) -> Rows:
        if row.get("anchor") is not None:
            self.anchor, self.samples = row["anchor"], 0
        ns = None if self.anchor is None else self.anchor + self.samples * 1_000_000_000 // self.rate
        self.samples += row["samples"]
        return [{"n": row["n"], "ns": ns}]

    def finish(self) -> Rows:
        return []


class Recovery:
    """Access units of a video stream: a bad unit that isn't a reference is dropped; after a bad reference all units are
    dropped up to the next one that stands alone. A bad last unit is an error."""

    schema = "n long, action string"

    def __init__(self):
        self.waiting, self.bad = False, None

    def push(self, row: dict) -> Rows:
        if row["bad"]:
            self.bad = row["n"]
            if row["reference"]:
                self.waiting = True
                return [{"n": row["n"], "action": "flush"}]
            return [{"n": row["n"], "action": "drop"}]
        self.bad = None
        if self.waiting and not row["key"]:
            return [{"n": row["n"], "action": "drop"}]
        self.waiting = False
        return [{"n": row["n"], "action": "decode"}]

    def finish(self) -> Rows:
        return [] if self.bad is None else [{"n": self.bad, "action": "error"}]


class Slots:
    """Bookkeeping of reference slots: which frame each holds after refreshes, and which are shown.

    ``refresh`` is a mask of slots that take the frame; a row with ``existing`` shows what a slot holds and takes nothing.
    Frames that aren't shown refresh slots all the same.
    """

    schema = "n long, shown long, slots string"

    def __init__(self, count: int = 8):
        self.slots: list[int | None] = [None] * count

    def push(self, row: dict) -> Rows:
        if row.get("existing") is not None:
            held = self.slots[row["existing"]]
            if held is None:
                raise ValueError("empty slot")
            return [{"n": row["n"], "shown": held, "slots": self._text()}]
        for i in range(len(self.slots)):
            if row["refresh"] >> i & 1:
                self.slots[i] = row["n"]
        return [{"n": row["n"], "shown": row["n"] if row["show"] else None, "slots": self._text()}]

    def _text(self) -> str:
        return ",".join("-" if s is None else str(s) for s in self.slots)

    def finish(self) -> Rows:
        return []


class ThreeReferences:
    """Last, golden and alternate frame; copies use what the slots held before this frame's refreshes."""

    schema = "n long, slots string"

    def __init__(self):
        self.slots: list[int | None] = [None, None, None]

    def push(self, row: dict) -> Rows:
        old, n = list(self.slots), row["n"]
        if row["key"]:
            self.slots = [n, n, n]
        else:
            golden = {0: old[1], 1: old[0], 2: old[2]}[row["copy_golden"]]
            alternate = {0: old[2], 1: old[0], 2: old[1]}[row["copy_alternate"]]
            self.slots = [n if row["refresh"] & 1 else old[0], n if row["refresh"] & 2 else golden, n if row["refresh"] & 4 else alternate]
        return [{"n": n, "slots": ",".join(map(str, self.slots))}]

    def finish(self) -> Rows:
        return []


class Tracks:
    """Audio and video of one file: a failing audio track gives one error row and then nothing; video goes on."""

    schema = "n long, kind string, error string"

    def __init__(self):
        self.failed = False

    def push(self, row: dict) -> Rows:
        if row["kind"] == "audio":
            if self.failed:
                return []
            if row["bad"]:
                self.failed = True
                return [{"n": row["n"], "kind": "audio_error", "error": "DecodeFailed"}]
        elif row["bad"]:
            raise ValueError("video")
        return [{"n": row["n"], "kind": row["kind"], "error": None}]

    def finish(self) -> Rows:
        return []


class Chunks:
    """Fixed-size records out of chunks of any size; what is left at the end is an error row."""

    schema = "n long, record binary, error string"

    def __init__(self, size: int = 188):
        self.size, self.rest, self.n = size, b"", 0

    def push(self, row: dict) -> Rows:
        data = self.rest + (row["bytes"] or b"")
        whole = len(data) // self.size
        out = [{"n": self.n + i, "record": data[i * self.size : (i + 1) * self.size], "error": None} for i in range(whole)]
        self.rest, self.n = data[whole * self.size :], self.n + whole
        return out

    def finish(self) -> Rows:
        return [{"n": self.n, "record": None, "error": "Incomplete"}] if self.rest else []


class Overlap:
    """Transform blocks into samples: each is the sum of its first half and the second half kept from the one before."""

    schema = "n long, samples array<double>"

    def __init__(self):
        self.kept: list[float] | None = None

    def push(self, row: dict) -> Rows:
        block = list(row["block"])
        half = len(block) // 2
        before = self.kept or [0.0] * half
        self.kept = block[half:]
        return [{"n": row["n"], "samples": [a + b for a, b in zip(block[:half], before, strict=True)]}]

    def finish(self) -> Rows:
        return []


class Guarded:
    """A machine with an error policy; failures become rows with error, state is as it was before them."""

    def __init__(self, make: Callable, policy: str):
        self.make, self.policy, self.machine, self.dead = make, policy, make(), False

    def push(self, row: dict) -> Rows:
        if self.dead:
            return []
        trial = copy.deepcopy(self.machine)
        try:
            out = trial.push(row)
        except (ValueError, KeyError, IndexError) as e:
            if self.policy == "sticky":
                self.dead = True
            elif self.policy == "reset":
                self.machine = self.make()
            return [{"failure": f"{type(e).__name__}: {e}"}]
        self.machine = trial
        return out

    def finish(self) -> Rows:
        return [] if self.dead else self.machine.finish()


def _frame(rows: Rows, key: str, value, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns, dtype=object)
    out.insert(0, key, value)
    return out


def _columns(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"{schema}, failure string").fieldNames()


def run_batch(rows: DataFrame, key: str, order: str, make: Callable, policy: str = "sticky") -> DataFrame:
    """Feeds each key's rows in order and ends it."""
    schema = make().schema
    columns, whole = _columns(schema), _whole(rows)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, out = Guarded(make, policy), []
        for row in pdf.sort_values(order).to_dict("records"):
            out += machine.push(_plain(row, whole))
        return _frame(out + machine.finish(), key, pdf[key].iloc[0], columns)

    return rows.groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, {schema}, failure string")


def _whole(rows: DataFrame) -> set[str]:
    return {c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint")}


def _plain(row: dict, whole: set[str]) -> dict:
    """Nulls as None, and whole numbers that nulls beside them had made floats."""
    return {k: None if v is None or isinstance(v, float) and v != v else int(v) if k in whole else v for k, v in row.items()}


class _Stateful(StatefulProcessor):
    def __init__(self, key: str, order: str, make: Callable, policy: str, columns: list[str], whole: set[str]):
        self.key, self.order, self.make, self.policy, self.columns, self.whole = key, order, make, policy, columns, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "pickled binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        machine = cloudpickle.loads(bytes(self.state.get()[0])) if self.state.exists() else None
        out: Rows = []
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            machine = machine or Guarded(self.make, self.policy)
            if row.get("end"):
                out += machine.finish()
                machine = None  # nothing of the key is kept
            else:
                out += machine.push(_plain(row, self.whole))
        if machine is not None:
            self.state.update((cloudpickle.dumps(machine),))
        elif self.state.exists():
            self.state.clear()
        yield _frame(out, self.key, key[0], self.columns)

    def close(self) -> None:
        pass


def run_stream(rows: DataFrame, key: str, order: str, make: Callable, policy: str = "sticky") -> DataFrame:
    """The same over a stream; a row whose column ``end`` is true ends its key and clears its state, so that a later row of the
    key begins anew. Needs the RocksDB state store."""
    schema = make().schema
    out = f"{key} {dict(rows.dtypes)[key]}, {schema}, failure string"
    return rows.groupBy(key).transformWithStateInPandas(_Stateful(key, order, make, policy, _columns(schema), _whole(rows)), out, "append", "none")
