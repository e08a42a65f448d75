"""Scalar functions of the history: keys, instants, comparison, actors. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from retrace.errors import InvalidDeclaration


def second_text(at: Column) -> Column:
    """An instant in UTC to the second."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def instant_text(at: Column) -> Column:
    """An instant in UTC with microseconds only where there are any."""
    return F.when(F.date_format(at, "SSSSSS") == "000000", second_text(at)).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def escaped(text: Column, *marks: str) -> Column:
    """Puts a backslash before each backslash and each of ``marks``."""
    for mark in ("\\", *marks):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def composite_id(parts: Sequence[Column]) -> Column:
    """The id of a composite key: escaped parts in declared order, joined by a bar. One part stands as it is."""
    if len(parts) == 1:
        return parts[0].cast("string")
    return F.concat_ws("|", *[escaped(p.cast("string"), "|") for p in parts])


def element_key(collection: str, element_id: Column, field: str | None = None) -> Column:
    """The change key of an element of a collection, and of one of its fields."""
    key = F.concat(F.lit(collection + "."), escaped(element_id.cast("string"), "."))
    return key if field is None else F.concat(key, F.lit("." + field))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def strict_same(old: Column, new: Column) -> Column:
    """Sameness of canonical JSON texts."""
    return old.eqNullSafe(new)


def canonical_number(value: Column) -> Column:
    """A number in JSON text as one spelling: sign, digits without leading zeros, fraction without trailing ones.

    null, "", "-" count as 0; null where the text is no plain decimal, so there is no opinion on it.
    Exponents are shifted by text, up to 4096 places, so no digit is rounded.
    """
    shape = r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]{1,5}))?$"
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(F.lit(0), n))

    def spelled(p: Column) -> Column:
        power = F.coalesce(p["power"].try_cast("int"), F.lit(0))
        digits = F.concat(zeros(-power), p["whole"], p["fraction"], zeros(power))
        point = F.length(p["whole"]) + power + F.greatest(F.lit(0), -power)
        left, right = F.regexp_replace(F.substr(digits, F.lit(1), point), "^0+", ""), F.regexp_replace(F.substr(digits, point + 1), "0+$", "")
        body = F.concat(F.when(left == "", F.lit("0")).otherwise(left), F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))
        return F.when(F.abs(power) <= 4096, _bound(body, lambda b: F.when((p["sign"] == "-") & (b != "0"), F.concat(F.lit("-"), b)).otherwise(b)))

    def parts(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, shape, i)
        found = F.struct(part(1).alias("sign"), part(2).alias("whole"), part(3).alias("fraction"), part(4).alias("power"))
        return F.when(text.rlike(shape) & text.rlike("[0-9]"), _bound(found, spelled))

    return _bound(F.when(value.isNull() | value.isin("null", '""', '"-"'), F.lit("0")).otherwise(F.trim(F.regexp_replace(value, '^"(.*)"$', "$1"))), parts)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_as_zero(old: Column, new: Column) -> Column:
    """Three-valued sameness of numbers, with nothing as zero; null where one is no number."""
    return canonical_number(old) == canonical_number(new)


def covers(field: Column, object_type: Column, names: Sequence[str]) -> Column:
    """Whether a field is one of ``names``: itself, with its type before a dot, or by its last segment."""
    wanted = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return F.array_contains(wanted, field) | F.array_contains(wanted, F.concat(object_type, F.lit("."), field)) | F.array_contains(wanted, last_segment(field))


def same(object_type: Column, field: Column, old: Column, new: Column, numeric: Sequence[str] = (), others: Sequence = ()) -> Column:
    """Sameness by a chain of comparators, the first with an opinion; strict sameness if none has one."""
    opinions = [f(object_type, field, old, new) for f in others]
    if numeric:
        opinions.append(F.when(covers(field, object_type, numeric), null_as_zero(old, new)))
    return F.coalesce(*opinions, strict_same(old, new))


def same_day(object_type: Column, field: Column, old: Column, new: Column) -> Column:
    """A comparator: instants of one day are the same; no opinion on what is no instant."""
    day = lambda x: F.to_date(F.try_to_timestamp(F.regexp_replace(x, '^"|"$', "")))
    return day(old) == day(new)


def resolved_actor(*chain: Column, fallback: str = "system") -> Column:
    """The first actor of the chain that is not empty, else the fallback."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in chain], F.lit(fallback))


def affected_count(text: Column) -> Column:
    """A count of affected rows: digits only; what doesn't fit a long is unknown."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def safe_error(message: Column) -> Column:
    """An error text without credentials in URLs and without quoted values."""
    out = F.regexp_replace(message, r"(?i)([a-z][a-z0-9+.-]*://)[^/@\s:]+(?::[^@\s]*)?@", "$1***@")
    return F.regexp_replace(out, r"(?i)(preview of field'?s? value: )'[^']*'", "$1'***'")


def refused_field(message: Column) -> Column:
    """The field that a refusal names, never its value."""
    return F.nullif(F.regexp_extract(message, r"field \[([^\]]{1,128})\]", 1), F.lit(""))


def index_name(name: str) -> str:
    """A valid table name: lower case, without the characters that paths and lists use."""
    if not name or name != name.lower() or name[0] in "-_+." or any(c in '\\/*?"<>| ,#:' for c in name) or len(name.encode()) > 255:
        raise InvalidDeclaration(f"{name!r} is no name for a table")
    return name
