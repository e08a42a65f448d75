"""Configuration of an engine: what is set, its defaults, and what can't go together."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from retrace.errors import InvalidDeclaration
from retrace.functions.values import index_name
from retrace.operators.coalesce import MAX_HELD
from retrace.operators.failures import report
from retrace.operators.frame import CoalescingFrame
from retrace.operators.redact import Rules
from retrace.operators.write import Writer
from retrace.plans.reader import Limits, Reader
from retrace.sources.store import Collector, Store, UnitOfWork, routes_of

TRANSPORTS = ("sync", "queue", "outbox", "collector")


@dataclass(frozen=True)
class EngineConfig:
    root: str
    default_table: str = "audit_log"
    routing: Mapping[str, str] = field(default_factory=dict)
    object_id_type: str = "keyword"
    transport: str = "sync"
    batch_size: int = 500
    on_failure: str = "log"
    failure_details: str = "cause"
    outbox_table: str = "outbox"
    require_transaction: bool = True
    fallback_actor: str = "system"
    limits: Limits = field(default_factory=Limits)
    rules: Rules = field(default_factory=lambda: Rules(()))
    coalescing: bool = False
    coalesced_types: tuple[str, ...] = ()
    numeric_fields: tuple[str, ...] = ()
    max_held: int = MAX_HELD
    on_overflow: str = "release"
    skip_empty_updates: bool = True
    nested_flush_provenance: str = "strict"

    def __post_init__(self) -> None:
        for name in (self.default_table, *self.routing.values()):
            index_name(name)
        for value, known, what in ((self.transport, TRANSPORTS, "transport"), (self.on_failure, ("log", "throw"), "on_failure"), (self.failure_details, ("none", "cause", "full"), "failure_details"), (self.on_overflow, ("release", "throw"), "on_overflow"), (self.nested_flush_provenance, ("strict", "outer"), "nested_flush_provenance")):
            if value not in known:
                raise InvalidDeclaration(f"{what} is one of {', '.join(known)}")
        if self.batch_size < 1 or self.max_held < 1:
            raise InvalidDeclaration("sizes count from 1")
        if not self.coalescing and (self.coalesced_types or self.numeric_fields):
            raise InvalidDeclaration("coalescing is off, but it is configured")
        if self.transport == "outbox" and self.outbox_table in {self.default_table, *self.routing.values()}:
            raise InvalidDeclaration("the outbox is a table of its own")

    def store(self, spark: SparkSession) -> Store:
        return Store(spark, self.root)

    def writer(self, **more: Any) -> Writer:
        return Writer(fallback_actor=self.fallback_actor, rules=self.rules, routing=self.routing, default=self.default_table, skip_empty_updates=self.skip_empty_updates, **more)

    def reader(self, tables: Mapping[str, DataFrame], **more: Any) -> Reader:
        return Reader(tables, self.routing, self.default_table, limits=self.limits, **more)

    def frame(self, sink: Callable[[DataFrame], None]) -> CoalescingFrame:
        """A frame that merges as configured; where an overflow is to throw, its outermost frame has to be begun as an atomic one."""
        return CoalescingFrame(sink, self.coalescing, self.coalesced_types, self.numeric_fields, max_held=self.max_held)

    def send(self, spark: SparkSession, records: DataFrame, run: str, collector: Collector | None = None, unit: UnitOfWork | None = None, **more: Any) -> dict[str, int]:
        """Records the way they are configured to go; what is refused is reported by the failure policy and counted by reason.

        sync: into their tables, one commit named by ``run``. queue: into the outbox table as a commit of its own, for a stream to take
        on. outbox: into the outbox inside a unit of work, which has to be open if one is required. collector: into the given collector.
        """
        accepted, rejected = self.writer(**more).write(records, run)
        counts = report(rejected, self.on_failure)
        store = self.store(spark)
        if self.transport == "collector":
            (collector or Collector()).write(accepted)
        elif self.transport == "sync":
            store.upsert(accepted, routes_of(self.routing, self.default_table), run)
        elif unit is not None:
            unit.write(accepted, self.outbox_table)
        elif self.transport == "outbox" and self.require_transaction:
            raise InvalidDeclaration("the outbox is written inside a unit of work")
        else:
            store.stage(accepted, self.outbox_table, run)
            store.publish(run)
        return counts
