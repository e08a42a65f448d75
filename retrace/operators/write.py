"""The write path: records are completed, numbered, enriched, redacted, routed and split into accepted and rejected."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrace.errors import InvalidDeclaration
from retrace.functions.values import resolved_actor
from retrace.model import RESERVED, WRITTEN_AT
from retrace.operators.redact import Rules, redact


@dataclass(frozen=True)
class Enricher:
    """Adds attributes, as Columns of JSON text by name, to records of some types, or of all if none is named.

    ``moment`` enrichers describe the unit of work and win over others on their own keys; ``merged`` ones run after coalescing.
    """

    attributes: Mapping[str, Column]
    types: tuple[str, ...] = ()
    moment: bool = False
    merged: bool = False

    def __post_init__(self) -> None:
        if self.moment and self.types:
            raise InvalidDeclaration("a moment has no object type")
        if bad := [n for n in self.attributes if n in RESERVED or n == WRITTEN_AT]:
            raise InvalidDeclaration(f"{bad[0]} is a field of the record itself")


@dataclass(frozen=True)
class Writer:
    """A configured write path. ``veto`` says which records are not written, ``replace`` rewrites them before the last redaction."""

    fallback_actor: str = "system"
    enrichers: Sequence[Enricher] = ()
    rules: Rules = field(default_factory=lambda: Rules(()))
    routing: Mapping[str, str] = field(default_factory=dict)
    default: str = "audit_log"
    veto: Column | None = None
    replace: Callable[[DataFrame], DataFrame] | None = None
    skip_empty_updates: bool = True

    def complete(self, records: DataFrame, run: str, now: Column | None = None) -> DataFrame:
        """Fills time (that of the batch unless ``now`` is given), actor and id; what a record has of its own wins. Adds the attributes of enrichers."""
        now = F.current_timestamp() if now is None else now
        out = records.withColumn("loggedAt", F.coalesce("loggedAt", now)).withColumn("source", resolved_actor(F.col("source"), fallback=self.fallback_actor))
        if self.skip_empty_updates:
            out = out.where(~((F.col("event") == "update") & (F.size("changes") == 0)))
        out = self._enriched(out, [e for e in self.enrichers if not e.merged])
        return with_ids(out, run)

    def prepare(self, records: DataFrame) -> DataFrame:
        """Merged enrichers, redaction, the application's veto and rewrite, and redaction once more of what it brought."""
        out = redact(self._enriched(records, [e for e in self.enrichers if e.merged]), self.rules)
        if self.veto is not None:
            out = out.where(~F.coalesce(self.veto, F.lit(False)))
        if self.replace is not None:
            out = redact(self.replace(out), self.rules)
        return out

    def routed(self, records: DataFrame) -> DataFrame:
        if not self.routing:
            return records.withColumn("route", F.lit(self.default))
        routes = F.create_map(*[F.lit(x) for pair in self.routing.items() for x in pair])
        return records.withColumn("route", F.coalesce(F.try_element_at(routes, F.col("objectType")), F.lit(self.default)))

    def split(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Accepted and rejected records, each rejected one with its reason; one bad record costs itself only."""
        reason = F.when(F.coalesce(F.col("objectType"), F.lit("")) == "", "no object type").when(F.coalesce(F.col("event"), F.lit("")) == "", "no event").when(F.col("objectId").isNull(), "no object id").when(F.exists(F.map_keys(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda k: k.isin(*RESERVED, WRITTEN_AT)), "an attribute has the name of a field")
        marked = records.withColumn("reason", reason)
        return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")

    def _enriched(self, records: DataFrame, enrichers: Sequence[Enricher]) -> DataFrame:
        """Ordinary enrichers give way to what a record has; moments win over them on their own keys, and give way to the record too."""
        own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
        added = F.create_map().cast("map<string,string>")
        for e in sorted(enrichers, key=lambda e: e.moment):
            more = F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in e.attributes.items()]))
            if e.types:
                more = F.when(F.col("objectType").isin(*e.types), more).otherwise(F.create_map().cast("map<string,string>"))
            added = overlay(added, more)
        return records.withColumn("attributes", overlay(F.map_filter(added, lambda _, v: v.isNotNull()), own)) if enrichers else records.withColumn("attributes", own)

    def write(self, records: DataFrame, run: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """All of it: routed accepted records, and rejected ones."""
        accepted, rejected = self.split(records)
        return self.routed(self.prepare(self.complete(accepted, run, now))), redact(rejected, self.rules)


def overlay(below: Column, above: Column) -> Column:
    """A map with the entries of both, those of ``above`` where keys meet."""
    return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)


def with_ids(records: DataFrame, run: str) -> DataFrame:
    """Gives records without an id one that sorts by time and order: 48 bits of milliseconds, a counter of 42 and random bits.

    Counter and bits follow from the run's name, the millisecond and the order (seq), so a recomputed stage gives the same ids. The
    counter starts at a hashed place in the lower half and counts the records of one millisecond.
    """
    ms = F.unix_millis("loggedAt")
    order = Window.partitionBy("loggedAt").orderBy("seq")
    start = F.pmod(F.xxhash64(F.lit(run), ms), F.lit(1 << 41))
    count = start + F.row_number().over(order) - 1
    bits = F.pmod(F.xxhash64(F.lit(run), ms, F.col("seq")), F.lit(1 << 32))
    # version 7 and the variant 10 stand in the middle of the counter: 12 bits above, 30 below
    high, low = F.shiftright(count, 30), count.bitwiseAND(F.lit((1 << 30) - 1)) + F.lit(1 << 31)
    pad = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    h = F.concat(pad(ms, 12), F.lit("7"), pad(high, 3), pad(low, 8), pad(bits, 8))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return records.withColumn("id", F.coalesce("id", text))


def documents(records: DataFrame, declared: Mapping[str, str], written_at: Column | None = None) -> DataFrame:
    """The stored form: base fields, declared attributes as typed columns, the rest in ``attributes``.

    Base fields win over attributes of their names, and the write's own time over an attribute of its.
    """
    typed = [F.from_json(F.concat(F.lit('{"v":'), F.try_element_at("attributes", F.lit(n)), F.lit("}")), f"v {t}")["v"].alias(n) for n, t in declared.items()]
    rest = F.map_filter("attributes", lambda k, _: ~k.isin(*declared, *RESERVED, WRITTEN_AT))
    at = F.date_trunc("second", F.current_timestamp() if written_at is None else written_at)
    return records.select("id", "objectType", "objectId", "event", F.date_trunc("second", "loggedAt").alias("loggedAt"), at.alias(WRITTEN_AT), "source", "changes", rest.alias("attributes"), *typed, *(["route"] if "route" in records.columns else []))


def late_publication(records: DataFrame, seconds: int = 0) -> DataFrame:
    """Records written more than so many seconds after they happened: a report, nothing is dropped."""
    gap = F.unix_timestamp(WRITTEN_AT) - F.unix_timestamp("loggedAt")
    return records.withColumn("gap", gap).where(F.col("gap") > seconds)


def retained(records: DataFrame, before: Column, types: Sequence[str] = ()) -> DataFrame:
    """What retention leaves: records from ``before`` on, and all of the types it is not for."""
    old = F.col("loggedAt") < before
    return records.where(~(old & F.col("objectType").isin(*types)) if types else ~old)


def forgotten(records: DataFrame, person: str, pseudonym: str) -> DataFrame:
    """Erasure: the person's name becomes a pseudonym and the contents of that person's changes go."""
    theirs = F.col("source").eqNullSafe(person)
    return records.withColumn("changes", F.when(theirs, F.map_filter("changes", lambda k, v: F.lit(False))).otherwise(F.col("changes"))).withColumn("source", F.when(theirs, F.lit(pseudonym)).otherwise(F.col("source")))
