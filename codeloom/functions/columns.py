"""Small rules as column expressions: base names, bound names, precedence, ratios, time limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a name bound by an assignment, a loop, an alias or a walrus.
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
NAMES = NAME + r"(?:[ \t]*,[ \t]*" + NAME + ")*"
ASSIGNED = r"^[ \t]*(" + NAMES + r")[ \t]*(?::[^=]+)?=(?:[^=]|$)"
LOOPED = r"\bfor[ \t]+(" + NAMES + r")[ \t]+in\b"
ALIASED = r"\bas[ \t]+(" + NAME + ")"
WALRUS = "(" + NAME + r")[ \t]*:="


def base_name(text: Column) -> Column:
    """The name to look up for a base class: no subscript, last dotted part; empty for keyword arguments. Null stays null."""
    head = F.trim(F.substring_index(text, "[", 1))
    return F.when(F.contains(head, F.lit("=")), "").otherwise(F.trim(F.substring_index(head, ".", -1)))


def bound_names(line: Column) -> Column:
    """The distinct names that a line binds, in order of the alphabet; an empty array for a null line."""
    line = F.coalesce(line, F.lit(""))
    groups = F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(1)) for p in (ASSIGNED, LOOPED, ALIASED, WALRUS)])
    names = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.btrim(x, F.lit(" \t")))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def precedence(explicit: Column, configured: Column, default: Column) -> Column:
    """What is given, else what the repository sets, else the default."""
    return F.coalesce(explicit, configured, default)


def compression_ratio(source_tokens: Column, skeleton_tokens: Column) -> Column:
    """Tokens of a source for each token of its skeleton, of which one at least is counted."""
    return source_tokens.cast("double") / F.greatest(F.lit(1), skeleton_tokens)


def command_timeout(per_command: Column, remaining: Column) -> Column:
    """A command's seconds within the time a run has left (null: no limit); null where none is left."""
    limit = per_command.cast("double")
    return F.when(remaining.isNull(), limit).when(remaining > 0, F.least(limit, remaining))
