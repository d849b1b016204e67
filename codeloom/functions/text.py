"""Column functions: folding, ranks, namespaces, notices and recovery rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CALLABLE = ("Method", "Constructor")
CALL_LIKE = ("Calls", "Constructs")


def fold(c: Column) -> Column:
    """ASCII letters in lower case; others as they are."""
    return F.translate(c, UPPER, LOWER)


def match_rank(name: Column, signature: Column, query: str | Column) -> Column:
    """0 exact name or signature, 1 the last part of a dotted name, 2 a prefix, 3 inside the name, 4 the signature only,
    null without a match; ASCII case does not matter."""
    q = fold(F.lit(query) if isinstance(query, str) else query)
    n, s = fold(name), fold(signature)
    return (
        F.when((n == q) | (s == q), 0).when(n.endswith(F.concat(F.lit("."), q)), 1).when(n.startswith(q), 2).when(n.contains(q), 3).when(s.contains(q), 4)
    )


def namespace(canonical_key: Column) -> Column:
    """What stands before the last dot of a key's qualified name, without its member; empty if there is none."""
    name = F.substring_index(F.get(F.split(canonical_key, ":", 4), F.lit(3)), "::", 1)
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def body_status(kind: Column, status: Column) -> Column:
    """Of callables the status, unknown if missing; of others none."""
    return F.when(kind.isin(*CALLABLE), F.coalesce(status, F.lit("Unknown")))


def body_recovery(has_body: Column, by_design: Column, stub: Column, il_bytes: Column, instructions: Column, references: Column) -> Column:
    """Classify recovery of a body from facts about it: an empty body is a stub, and one without references needs three
    instructions and three bytes to count as recovered."""
    empty = ~has_body | stub | (F.least(il_bytes, instructions) == 0)
    enough = (references > 0) | (F.least(il_bytes, instructions) >= 3)
    return F.when(by_design, "NoBodyByDesign").when(empty, "StubOrUnavailable").when(enough, "Recovered").otherwise("Unknown")


def path_is_safe(path: Column) -> Column:
    """Relative, and without empty, ``.`` or ``..`` parts."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~path.rlike("^[A-Za-z]:")


def relative_change(before: Column, after: Column) -> Column:
    """|after - before| / before; null on a zero baseline."""
    return F.when(before != 0, F.abs(after - before) / before)


SEVERITY = ("FullyRecovered", "Unknown", "GraphOnly", "PartiallyRecovered", "StubOrUnavailable")  # fixed: from best to worst


def worst_recovery(status: Column) -> Column:
    """Aggregate: the worst status of a group, unknown for an empty one."""
    rank = F.max(F.array_position(F.array(*map(F.lit, SEVERITY)), status))
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITY)), (rank - 1).cast("int")), F.lit("Unknown"))


def scene_recovery(evaluated: Column, readable: Column, graph: Column, fields: Column, complete: Column) -> Column:
    """How far an object of a scene was recovered, from five facts."""
    return (
        F.when(~evaluated, "Unknown").when(~readable, "StubOrUnavailable").when(graph & ~fields, "GraphOnly").when(graph & fields & complete, "FullyRecovered").otherwise("PartiallyRecovered")
    )


NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")  # fixed: written as words


def number_text(n: Column) -> Column:
    return F.when(n.between(0, 10), F.get(F.array(*map(F.lit, NUMBERS)), n.cast("int"))).otherwise(n.cast("string"))


def count_text(n: Column, singular: str, plural: str) -> Column:
    """A number and what it counts."""
    return F.concat(number_text(n), F.lit(" "), F.when(n == 1, singular).otherwise(plural))


def coverage_text(shown: Column, total: Column) -> Column:
    return F.concat(F.lit("showing "), number_text(shown), F.lit(" of "), number_text(total))


MOST_DAYS = 36_500  # fixed: of a duration


def duration_minutes(text: Column) -> Column:
    """Minutes of a whole number and m, h or d; null for anything else, for none, and for more than ``MOST_DAYS``."""
    digits = F.regexp_extract(text, "^([0-9]{1,18})[mhd]$", 1)
    unit = F.element_at(F.create_map(F.lit("m"), F.lit(1), F.lit("h"), F.lit(60), F.lit("d"), F.lit(1440)), F.right(text, F.lit(1)))
    minutes = F.when(digits != "", digits.cast("decimal(38,0)") * F.coalesce(unit, F.lit(0)))
    return F.when((minutes > 0) & (minutes <= MOST_DAYS * 1440), minutes.cast("long"))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_guid(text: Column) -> Column:
    """Thirty-two digits in lower case, as in names of folders."""
    return F.coalesce(text.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))
