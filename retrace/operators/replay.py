"""Replay: statements that stood become row versions, field changes, memberships and records.

Statements are bound to rows by their shape and the declared mapping, and everything after that is windows per row: the old
value of a column is the last one the log or a first account gave it. What can't be followed is a doubt, never a guess.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrace.errors import InvalidDeclaration
from retrace.functions.values import composite_id, element_key
from retrace.operators.folds import fold_ordered


@dataclass(frozen=True)
class Mapped:
    """A table that is followed: its key, audited columns to fields, and, for elements, the owner's foreign key."""

    table: str
    object_type: str
    key: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]  # column, field
    always: tuple[str, ...] = ()
    owner_key: str | None = None  # column that names the owner; elements only
    collection: str | None = None
    owner_type: str | None = None
    version: str | None = None
    root: str | None = None  # tables of one hierarchy share a root
    references: tuple[str, ...] = ()  # foreign keys of single related rows

    def __post_init__(self) -> None:
        if not self.key or not self.object_type:
            raise InvalidDeclaration(f"{self.table} needs a key and an object type")
        if (self.owner_key is None) != (self.collection is None):
            raise InvalidDeclaration(f"{self.table}: an element has an owner's key and a collection")


def mapping_table(spark: SparkSession, mappings: Sequence[Mapped]) -> DataFrame:
    """The declarations as a table, one row each: their number is fixed by the program, so it is broadcast."""
    rows = [(m.table.rpartition(".")[2].lower(), m.root or m.table, m.object_type, list(m.key), dict(m.fields), list(m.always), m.owner_key, m.collection, m.owner_type, m.version, list(m.references)) for m in mappings]
    return F.broadcast(spark.createDataFrame(rows, "mapped string, root string, objectType string, keys array<string>, fields map<string,string>, always array<string>, owner_key string, collection string, owner_type string, version string, references array<string>"))


def bound(statements: DataFrame, mapping: DataFrame) -> DataFrame:
    """Statements (with shape, params, affected, generated_key) and the row they are bound to.

    ``binding`` is ROW with its key, ROWS_OF_OWNER with the owner, or UNBOUND with a reason. ``set`` has what is assigned, as JSON text; an
    expression is null. An unmapped table is left out. Of unreadable statements those stay, unbound, that may write a mapped table, once for
    each, or any table at all.
    """
    last = lambda name: F.lower(F.element_at(F.split(name, r"\."), -1))
    written = F.col("written") if "written" in statements.columns else F.lit(None).cast("array<string>")
    names = F.when(F.col("shape").isNotNull(), F.array(last(F.col("shape.table_name")))).otherwise(F.array_distinct(F.transform(written, last)))
    anywhere = F.col("shape").isNull() & written.isNull()
    out = statements.withColumn("_name", F.explode_outer(names)).join(mapping, F.col("_name") == F.col("mapped"), "left").where(F.col("mapped").isNotNull() | anywhere)
    param = lambda i: F.get(F.col("params"), i)
    values = F.transform_values("shape.assigned", lambda _, i: F.when(i.isNotNull(), param(i)))
    where = F.transform_values("shape.where", lambda _, i: param(i))
    plain = lambda x: F.regexp_replace(x, '^"(.*)"$', "$1")
    # a single generated key stands in for a missing one
    key_of = lambda source: F.transform(F.col("keys"), lambda k: F.coalesce(plain(F.element_at(source, k)), F.when(F.size("keys") == 1, F.col("generated_key"))))
    joined = lambda ks: F.when(F.size(ks) == 1, ks[0]).otherwise(F.concat_ws("|", F.transform(ks, lambda k: F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))))
    insert = F.col("shape.kind") == "INSERT"
    names = F.map_keys("shape.where")
    whole = F.col("shape.exact") & (F.size(F.array_except(F.col("keys"), names)) == 0) & (F.size(F.array_except(names, F.concat("keys", F.array_compact(F.array("version"))))) == 0)
    of_owner = F.col("shape.exact") & (F.col("shape.kind") == "DELETE") & (F.size(names) == 1) & (names[0] == F.col("owner_key"))
    key = F.when(insert, joined(key_of(values))).when(whole, joined(F.transform(F.col("keys"), lambda k: plain(F.element_at(where, k)))))
    binding = F.when(F.col("shape").isNull(), "UNBOUND").when(key.isNotNull(), "ROW").when(of_owner, "ROWS_OF_OWNER").otherwise("UNBOUND")
    reason = F.when(F.col("shape").isNull(), "unreadable").when(binding == "UNBOUND", "condition is not the key")
    return out.select("connection", "seq", "flush", "affected", "root", "objectType", "fields", "always", "references", "owner_key", "collection", "owner_type", F.col("shape.kind").alias("statement"), binding.alias("binding"), key.alias("key"), F.when(binding == "ROWS_OF_OWNER", plain(F.element_at(where, F.col("owner_key")))).alias("of_owner"), values.alias("set"), reason.alias("reason"))


def row_states(rows: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Bound rows in order with what was known before: ``life`` counts the lives of a row, ``before`` is there, gone or unknown.

    A first account (root, key, row, taken_at) counts as what was known before everything after taken_at; the earliest one wins.
    """
    if initial is not None:
        first = initial.groupBy("root", "key").agg(F.min_by("row", "taken_at").alias("set"), F.min("taken_at").alias("seq"))
        rows = rows.unionByName(first.withColumn("statement", F.lit("INITIAL")), allowMissingColumns=True)
    own = Window.partitionBy("root", "key").orderBy("seq")
    born = F.col("statement").isin("INSERT", "INITIAL")
    alive = F.when(born, "there").when((F.col("statement") == "DELETE") & ~F.coalesce(F.col("affected") == 0, F.lit(False)), "gone")
    out = rows.withColumn("before", F.coalesce(F.last(alive, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit("unknown")))
    return out.withColumn("life", F.sum(born.cast("int")).over(own))


def touched(counts_changed_rows: bool = False) -> Column:
    """Whether a statement touched its row by the count it gave; no count says yes.

    Where a store counts changed rows instead of matched ones, an UPDATE that counts none may have set what was there already: it stands.
    """
    none = F.coalesce(F.col("affected") == 0, F.lit(False))
    return ~none | (F.col("statement") == "UPDATE") if counts_changed_rows else ~none


def field_changes(states: DataFrame, counts_changed_rows: bool = False) -> DataFrame:
    """``connection, seq, flush, root, objectType, key, statement, column, field, old, new`` of every audited column that changed.

    An INSERT has no old values, an UPDATE only columns that differ strictly, a DELETE the last value of every audited column. A statement
    that touched no row, or a row that is gone, has none; one on an unknown row has none and is a doubt. With ``counts_changed_rows`` an
    UPDATE that counts no row is one that found its values there: what it says of columns that were not known is taken as known from then on, and is no change.
    """
    live = states.where((F.col("statement").isin("INSERT", "INITIAL")) | ((F.col("before") == "there") & touched(counts_changed_rows)))
    idle = F.coalesce(F.col("affected") == 0, F.lit(False))
    # a delete says something about every audited column of the row
    said = F.when(F.col("statement") == "DELETE", F.transform_values("fields", lambda k, v: F.lit(None).cast("string"))).otherwise(F.col("set"))
    long = live.select("*", F.explode(said).alias("column", "new"))
    own = Window.partitionBy("root", "key", "life", "column").orderBy("seq")
    known = F.struct("new")
    old = F.last(F.when(F.col("statement") != "DELETE", known), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumn("_old", old).withColumn("old", F.col("_old.new"))
    kept = long.where((F.col("statement") == "INSERT") | ((F.col("statement") == "DELETE") & F.col("_old").isNotNull()) | ((F.col("statement") == "UPDATE") & ~F.col("old").eqNullSafe(F.col("new")) & ~idle))
    extra = [c for c in ("references",) if c in states.columns]
    return kept.withColumn("field", F.element_at("fields", F.col("column"))).select("connection", "seq", "flush", "root", "objectType", "key", "statement", "owner_key", "collection", "owner_type", "fields", "always", *extra, "column", "field", "old", "new")


def doubts(bound_rows: DataFrame, states: DataFrame) -> DataFrame:
    """``connection, seq, flush, root, text`` of statements that could not be followed."""
    unbound = bound_rows.where(F.col("binding") == "UNBOUND").select("connection", "seq", "flush", "root", F.col("reason").alias("text"))
    unknown = states.where((F.col("before") == "unknown") & F.col("statement").isin("UPDATE", "DELETE") & ~F.coalesce(F.col("affected") == 0, F.lit(False))).select("connection", "seq", "flush", "root", F.lit("the row was not known").alias("text"))
    return unbound.unionByName(unknown)


def executions(changes: DataFrame) -> DataFrame:
    """Numbers the executions: neighbouring statements of one flush on one object are one, as tables of a hierarchy are written one after the other.

    A table met twice begins the next execution.
    """
    statements = changes.select("connection", "seq", "flush", "objectType", "key", "statement", "root").distinct()
    own = Window.partitionBy("connection").orderBy("seq")
    same = (F.lag("objectType").over(own) == F.col("objectType")) & (F.lag("key").over(own) == F.col("key")) & F.lag("flush").over(own).eqNullSafe(F.col("flush")) & (F.lag("statement").over(own) == F.col("statement")) & (F.lag("root").over(own) != F.col("root"))
    statements = statements.withColumn("execution", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(own))
    return changes.join(statements.select("connection", "seq", "execution"), ["connection", "seq"])


def records(changes: DataFrame, flushes: DataFrame | None = None, by: Sequence[str] = ("connection", "seq")) -> DataFrame:
    """One record per execution (or statement): create, update or remove, with old and new of each audited field.

    A remove carries no changes. flushes (flush, at, actor, attributes) give time, actor and attributes. Fields that are always recorded
    join by ``drafts.with_context``.
    """
    event = F.when(F.col("statement") == "INSERT", "create").when(F.col("statement") == "UPDATE", "update").otherwise("remove")
    change = F.struct(F.lit(True).alias("pair"), F.coalesce("old", F.lit("null")).alias("old"), F.coalesce("new", F.lit("null")).alias("new"), F.lit(None).cast("string").alias("raw"))
    of = changes.where(F.col("statement") != "INITIAL").withColumn("event", event).where((F.col("event") == "remove") | F.col("field").isNotNull())
    out = of.groupBy(*by, "objectType", F.col("key").alias("objectId"), "event", "flush").agg(*([] if "seq" in by else [F.min("seq").alias("seq")]), F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("event") != "remove") & F.col("field").isNotNull(), F.struct("field", change.alias("change")))))).alias("changes"))
    if flushes is not None:
        out = out.join(flushes.select("flush", F.col("at").alias("loggedAt"), "actor", "attributes"), "flush", "left")
    return out


def completed_creates(changes: DataFrame, begins: DataFrame | None = None) -> DataFrame:
    """Folds an INSERT and the UPDATEs that fill its foreign keys into one create.

    An update belongs if it follows in the same flush, no flush began in between (``begins``: connection, seq of the marks), and all it sets
    are declared ``references`` that the insert set to null.
    """
    own = Window.partitionBy("root", "key", "flush").orderBy("seq")
    born = F.last(F.when(F.col("statement") == "INSERT", F.col("seq")), ignorenulls=True).over(own)
    marked = changes.withColumn("_born", born)
    if begins is None:
        marked = marked.withColumn("_begun", F.lit(None).cast("long"))
    else:
        marked = as_of(marked, begins.select("connection", F.col("seq").alias("_begun")), ["connection"], "seq", "_begun", ["_begun"], strictly=True)
    given = F.coalesce(F.array_contains("references", F.col("column")) & (F.col("old") == "null"), F.lit(False))
    only = F.min(given.cast("int")).over(Window.partitionBy("root", "key", "seq")) == 1
    belongs = (F.col("statement") == "UPDATE") & F.col("_born").isNotNull() & F.col("flush").isNotNull() & only & ~F.coalesce(F.col("_begun") > F.col("_born"), F.lit(False))
    marked = marked.withColumn("_belongs", F.coalesce(belongs, F.lit(False)))
    # what has been an update of its own ends the creation
    life = Window.partitionBy("root", "key", "flush", "_born").orderBy("seq")
    other = F.max(((F.col("statement") != "INSERT") & ~F.col("_belongs")).cast("int")).over(life)
    marked = marked.withColumn("_belongs", F.col("_belongs") & (other == 0))
    marked = marked.withColumn("_at", F.col("seq")).withColumn("seq", F.when(F.col("_belongs"), F.col("_born")).otherwise(F.col("seq"))).withColumn("statement", F.when(F.col("_belongs"), "INSERT").otherwise(F.col("statement")))
    last = Window.partitionBy("root", "key", "seq", "column").orderBy(F.col("_at").desc())
    out = marked.withColumn("_rank", F.row_number().over(last)).where("_rank = 1")
    return out.withColumn("old", F.when(F.col("statement") == "INSERT", F.lit(None)).otherwise(F.col("old"))).drop("_born", "_begun", "_belongs", "_rank", "_at")


def element_changes(changes: DataFrame) -> DataFrame:
    """``connection, seq, flush, objectType, objectId, name, old, new`` for owners of elements: fields and membership.

    A field of an element belongs to the owner the element has after the statement. Membership is told to both sides: an element that
    arrives is new in its owner's collection, one that leaves or moves is old in the owner it had.
    """
    elements = changes.where(F.col("owner_key").isNotNull())
    plain = lambda x: F.regexp_replace(x, '^"(.*)"$', "$1")
    own = Window.partitionBy("root", "key").orderBy("seq")
    owner_now = F.last(F.when((F.col("column") == F.col("owner_key")) & (F.col("statement") != "DELETE"), F.col("new")), ignorenulls=True).over(own.rangeBetween(Window.unboundedPreceding, 0))
    placed = elements.withColumn("_owner", owner_now)
    fields = placed.where((F.col("statement") == "UPDATE") & F.col("field").isNotNull() & (F.col("column") != F.col("owner_key"))).select("connection", "seq", "flush", F.col("owner_type").alias("objectType"), plain(F.col("_owner")).alias("objectId"), F.concat(F.col("collection"), F.lit("."), F.replace(F.replace("key", F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\.")), F.lit("."), F.col("field")).alias("name"), "old", "new")
    moves = placed.where(F.col("column") == F.col("owner_key"))
    side = lambda owner, old, new: moves.where(owner.isNotNull() & (owner != "null")).select("connection", "seq", "flush", F.col("owner_type").alias("objectType"), plain(owner).alias("objectId"), F.concat("collection", F.lit("."), F.replace(F.replace("key", F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))).alias("name"), old.alias("old"), new.alias("new"))
    nothing = F.lit(None).cast("string")
    return fields.unionByName(side(F.col("old"), F.col("key"), nothing)).unionByName(side(F.when(F.col("statement") != "DELETE", F.col("new")), nothing, F.col("key")))


def emptied(bound_rows: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and doubts of statements that delete all elements of an owner.

    The elements known to be the owner's just before are what was removed, if there are as many as the statement says; otherwise
    it is a doubt. Facts: ``connection, seq, flush, objectType, objectId, collection, old`` with old sorted by key.
    """
    asked = bound_rows.where(F.col("binding") == "ROWS_OF_OWNER").select("connection", F.col("seq").alias("at"), "flush", "affected", "root", "of_owner", "collection", "owner_type", "owner_key")
    own = Window.partitionBy("root", "key").orderBy("seq")
    owner = F.regexp_replace(F.element_at("set", F.col("owner_key")), '^"(.*)"$', "$1")
    told = states.withColumn("_owner", F.when(F.col("statement") != "DELETE", owner)).withColumn("_owner", F.last("_owner", ignorenulls=True).over(own))
    told = told.withColumn("_until", F.lead("seq").over(own)).where(F.col("statement") != "DELETE").select("root", "key", "_owner", F.col("seq").alias("_since"), "_until")
    held = asked.join(told, (asked["root"] == told["root"]) & (asked["of_owner"] == told["_owner"]) & (told["_since"] < asked["at"]) & (told["_until"].isNull() | (told["_until"] > asked["at"])), "left")
    lists = held.groupBy("connection", "at", "flush", "affected", asked["root"], "of_owner", "collection", "owner_type").agg(F.array_sort(F.collect_list("key")).alias("old"))
    right = F.coalesce(F.size("old") == F.col("affected"), F.lit(False))
    facts = lists.where(right).select("connection", F.col("at").alias("seq"), "flush", F.col("owner_type").alias("objectType"), F.col("of_owner").alias("objectId"), "collection", "old")
    return facts, lists.where(~right).select("connection", F.col("at").alias("seq"), "flush", "root", F.lit("the count does not fit what is known").alias("text"))


def versions(states: DataFrame) -> DataFrame:
    """``root, objectType, key, life, valid_from, valid_to, row``: every image of every row with the positions between which it stood.

    An image is the one before it with what a statement set, so a row's statements are read once, in order.
    """

    def images(key: tuple, rows: Iterator[dict[str, Any]]) -> Iterable[tuple]:
        life = kind = last = None
        image: dict[str, str | None] = {}
        for r in rows:
            if last is not None:
                yield (*last[:5], r["seq"], last[5])
            last, kind = None, kind or r["objectType"]
            if r["life"] != life:
                life, image = r["life"], {}
            if r["statement"] != "DELETE":
                image = {**image, **dict(r["set"] or ())}
                last = (key[0], kind, key[1], life, r["seq"], list(image.items()))
        if last is not None:
            yield (*last[:5], None, last[5])

    live = states.where(F.col("statement").isin("INSERT", "INITIAL") | (F.col("before") == "there")).select("root", "key", "objectType", "life", "seq", "statement", "set")
    return fold_ordered(live, ["root", "key"], ["seq"], images, "root string, objectType string, key string, life long, valid_from long, valid_to long, row map<string,string>")


def as_of(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str], strictly: bool = False) -> DataFrame:
    """Probes with the latest fact of their key at a position, or strictly before it.

    Both sides are unioned and one window carries the last fact forward: one shuffle by key, and no row meets another one.
    """
    side = lambda df, position, is_probe: df.withColumn("_at", F.col(position)).withColumn("_probe", F.lit(int(is_probe)))
    known = side(facts, since, False).select(*keys, "_at", "_probe", F.struct(*values).alias("_fact"))
    asked = side(probes, at, True).select(*keys, "_at", "_probe", F.struct(*probes.columns).alias("_row"))
    both = known.unionByName(asked, allowMissingColumns=True)
    # at one position facts come before probes, unless only earlier ones count
    own = Window.partitionBy(*keys).orderBy("_at", F.col("_probe").desc() if strictly else F.col("_probe").asc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_fact", F.last("_fact", ignorenulls=True).over(own)).where("_probe = 1").select("_row.*", *[F.col(f"_fact.{v}").alias(v) for v in values])


def represented(*fallbacks: Column) -> Column:
    """What a related row is shown as: the first of its fallbacks that is known."""
    return F.coalesce(*fallbacks)


__all__ = ["Mapped", "as_of", "bound", "completed_creates", "composite_id", "doubts", "element_changes", "element_key", "emptied", "executions", "field_changes", "mapping_table", "records", "represented", "row_states", "versions"]
