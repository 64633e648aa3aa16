"""Tree-number algebra on dotted paths, as Columns (FN-20 to FN-23, FN-27)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(t: Column) -> Column:
    return F.filter(F.split(t, r"\."), lambda p: p != "")


def depth(t: Column) -> Column:
    return F.size(parts(t))


def parent(t: Column) -> Column:
    """The path one up; null at a root."""
    p = parts(t)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), "."))


def ancestors(t: Column, own: bool = False) -> Column:
    """All prefixes of a path, roots first, with or without itself."""
    p = parts(t)
    n = F.size(p) if own else F.size(p) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(p, 1, k), "."))).otherwise(F.array().cast("array<string>"))


def shared(a: Column, b: Column) -> Column:
    """Components that two paths have in common from the root."""
    same = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def distance(a: Column, b: Column) -> Column:
    """Edges between two paths; null without a common root."""
    s = shared(a, b)
    return F.when(s > 0, depth(a) + depth(b) - 2 * s)


def similarity(a: Column, b: Column) -> Column:
    return 1.0 / (1 + distance(a, b))


def key(kind: str, value: Column) -> Column:
    """A typed node id; dots and blanks become underscores (PRJ-18)."""
    return F.concat(F.lit(f"{kind}:"), F.translate(value, ". /", "___"))


def concepts(t: Column, least: int = 3) -> Column:
    """A path as typed concepts: itself (from a depth on), its parent and its ancestors (FN-22)."""
    own = F.when(depth(t) >= least, F.array(key("tree", t))).otherwise(F.array().cast("array<string>"))
    up = F.when(parent(t).isNotNull(), F.array(key("tree_parent", parent(t)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, up, F.transform(ancestors(t), lambda a: key("tree_ancestor", a))))


def category(t: Column) -> Column:
    """By the first component, compared whole, so that only bare root letters match (FN-27)."""
    first = F.element_at(F.split(t, r"\."), 1)
    return F.when(first == "C", F.lit("disease")).when(first == "D", F.lit("chemical")).when(first == "E02", F.lit("intervention"))


def topic_weight(major: Column, multiplier: float = 1.25) -> Column:
    """FN-23."""
    return F.when(F.coalesce(major, F.lit(False)), F.lit(multiplier)).otherwise(F.lit(1.0))
