"""Tag filters as column expressions over ``metric`` and ``tags``: array<struct<key, value, raw>>, or, where the keys are known, a mapping of
each key to its value, which leaves plain tests of columns.

Filters that name values look at every value of a key; patterns look at its first value in the order of the tags. The
expressions are built-in functions only, so they stay in the scan's generated code.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import MatchType, Query, TagMatcher


Tags = Column | str | Mapping[str, Column]


def has_key(key: str, tags: Tags = "tags") -> Column:
    if isinstance(tags, Mapping):
        return F.lit(key in tags)
    return F.exists(tags, lambda t: t["key"] == key)


def first_value(key: str, tags: Tags = "tags") -> Column:
    """The first value of a key, null without one."""
    if isinstance(tags, Mapping):
        return tags.get(key, F.lit(None).cast("string"))
    return F.try_element_at(F.filter(tags, lambda t: t["key"] == key), F.lit(1))["value"]


def any_of(key: str, values: list[str], tags: Tags = "tags") -> Column:
    if not values:
        return F.lit(False)
    if isinstance(tags, Mapping):
        return F.coalesce(tags[key].isin(values), F.lit(False)) if key in tags else F.lit(False)
    return F.exists(tags, lambda t: (t["key"] == key) & t["value"].isin(values))


def wildcard(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The pattern's parts between stars, each sought from as many characters on as the parts before it have; a star
    at one end only also ties the other end. This is looser than LIKE, on purpose."""
    if ignore_case:
        value, pattern = F.lower(value), pattern.lower()
    open_start, open_end = pattern.startswith("*"), pattern.endswith("*")
    body = pattern.strip("*")
    if not body:  # stars only: they are one part, "*", which matches all
        return value.isNotNull()
    parts = body.split("*")
    tests = [value.isNotNull()]
    if open_start and not open_end:
        tests.append(value.endswith(parts[-1]))
    if open_end and not open_start:
        tests.append(value.startswith(parts[0]))
    skipped = 0
    for part in parts:
        if part:
            tests.append(F.locate(part, value, skipped + 1) > 0)
        skipped += len(part)
    return F.coalesce(reduce(and_, tests), F.lit(False))


def alternatives(pattern: str, ignore_case: bool) -> list[str]:
    return [p.lower() if ignore_case else p for p in pattern.split("|") if p]


def matches(m: TagMatcher, tags: Tags = "tags") -> Column:
    """Whether the series has the key and its value matches; for an excluding type, whether it is among the excluded."""
    value = first_value(m.key, tags)
    match m.type:
        case MatchType.EXACT:
            return any_of(m.key, [m.pattern], tags)
        case MatchType.WILDCARD | MatchType.IWILDCARD if m.pattern == "*":
            return has_key(m.key, tags)
        case MatchType.WILDCARD | MatchType.IWILDCARD:
            return wildcard(value, m.pattern, m.type is MatchType.IWILDCARD)
        case MatchType.LITERAL_OR | MatchType.NOT_LITERAL_OR:
            return any_of(m.key, alternatives(m.pattern, False), tags)
        case MatchType.ILITERAL_OR | MatchType.NOT_ILITERAL_OR:
            names = alternatives(m.pattern, True)
            return F.coalesce(F.lower(value).isin(names), F.lit(False)) if names else F.lit(False)
        case MatchType.REGEXP:
            return F.coalesce(value.rlike(m.pattern), F.lit(False))


def selects(q: Query, metric: Column | str = "metric", tags: Tags = "tags") -> Column:
    """Which series a query selects.

    All including matchers must hold. With excluding matchers only, the series must have all their keys; beside
    including ones, a series without an excluded key stays. A series goes if all excluding matchers name its values."""
    including = [m for m in q.matchers if not m.type.excludes]
    excluding = [m for m in q.matchers if m.type.excludes]
    name = F.col(metric) if isinstance(metric, str) else metric
    tests = [name == q.metric, *(matches(m, tags) for m in including)]
    if excluding and not including:
        tests += [has_key(m.key, tags) for m in excluding]
    if excluding:
        tests.append(~reduce(and_, [matches(m, tags) for m in excluding]))
    return reduce(and_, tests)
