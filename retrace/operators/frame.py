"""A coalescing frame over batches: what is recorded between its outermost begin and end is merged and released at the end."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrace.errors import FrameOverflow, InvalidDeclaration
from retrace.operators.coalesce import MAX_HELD, Fold, coalesce_records, crowded_frames, valve_turns


@dataclass
class CoalescingFrame:
    """Frames nest by depth and only the outermost releases. Held batches are plans, nothing is computed before the release.

    A frame that held more objects than it may is released in turns: an object that would be one too many opens the valve for all before
    it. An atomic frame is all or nothing: it has to be the outermost, its records go through one fold as they come, which holds and stages at
    most ``max_held`` of them, and if it would be more, nothing of it is written and it stays spoilt until its end. ``sink`` gets every release as one DataFrame.
    """

    sink: Callable[[DataFrame], None]
    enabled: bool = True
    types: Sequence[str] = ()
    numeric: Sequence[str] = ()
    comparators: Sequence[Callable[..., Column]] = ()
    max_held: int = MAX_HELD
    depth: int = 0
    atomic: bool = False
    number: int = 0
    spoilt: str | None = None
    held: list[DataFrame] = field(default_factory=list)
    staged: Fold | None = None

    def begin(self, atomic: bool = False) -> None:
        if atomic and self.depth:
            raise InvalidDeclaration("an atomic frame has to be the outermost one")
        if atomic and not self.enabled:
            raise InvalidDeclaration("coalescing is off, so nothing can be atomic")
        if atomic:
            self.staged = Fold(self.max_held, True, self._equal)
        self.atomic = atomic or self.atomic
        self.depth += 1

    def record(self, steps: DataFrame) -> None:
        """Takes records (the columns of coalesce_records but frame); outside a frame, or with coalescing off, they pass at once."""
        if self.spoilt:
            raise FrameOverflow(self.spoilt)
        if not self.depth or not self.enabled:
            self.sink(steps)
            return
        self.held.append(steps)
        if self.atomic:
            own = steps.where(F.col("objectType").isin(*self.types)) if self.types else steps
            try:
                for row in own.orderBy("seq").toLocalIterator():
                    self.staged.step({**row.asDict(recursive=True), "attributes": row["attributes"] or {}})
            except FrameOverflow as e:
                self.held.clear()
                self.spoilt = str(e)
                raise

    def _equal(self, kind: str, name: str, old: str | None, new: str | None) -> bool | None:
        """Numbers without a value are zero where a field is declared numeric; what other comparators say is for the release."""
        zero = lambda x: "0" if x in (None, "null") else x
        if name not in self.numeric and f"{kind}.{name}" not in self.numeric:
            return None
        try:
            return float(json.loads(zero(old))) == float(json.loads(zero(new)))
        except (TypeError, ValueError):
            return None

    def release(self) -> None:
        """Writes everything held now; what comes after is merged anew. Refused inside an atomic frame."""
        if self.atomic:
            raise FrameOverflow("an atomic frame is released by its end only")
        self._write()

    def end(self) -> None:
        if not self.depth:
            raise InvalidDeclaration("no frame is open")
        self.depth -= 1
        if not self.depth:
            spoilt, self.spoilt, self.atomic = self.spoilt, None, False
            if spoilt is None:
                self._write()

    def reset(self) -> None:
        """What a handler that ended left open is written, not lost."""
        self.depth, self.atomic, self.spoilt = 0, False, None
        self._write()

    def drop_everything(self) -> None:
        self.held.clear()
        self.depth, self.atomic, self.spoilt = 0, False, None

    @contextmanager
    def __call__(self, atomic: bool = False) -> Iterator[CoalescingFrame]:
        self.begin(atomic)
        try:
            yield self
        except BaseException:
            if self.atomic and self.depth == 1:
                self.held.clear()
            raise
        finally:
            self.end()

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.held)

    def _write(self) -> None:
        if self.held:
            steps = self._all().withColumn("frame", F.lit(str(self.number)))
            self.held, self.number = [], self.number + 1
            crowded = not self.atomic and not crowded_frames(steps, self.max_held).isEmpty()
            if crowded:
                steps = valve_turns(steps, self.max_held).withColumn("frame", F.concat_ws(":", "frame", F.format_string("%012d", "turn"))).drop("turn")
            out = coalesce_records(steps, self.numeric, self.comparators, self.types)
            out = out.orderBy("frame", "place")
            self.sink(out.withColumn("frame", F.substring_index("frame", ":", 1)) if crowded else out)
