"""Tags, series names, tag filters and queries, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

TAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("raw", T.StringType())])
SERIES = T.StructType([
    T.StructField("series_id", T.LongType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("tags", T.ArrayType(TAG)),
])
#: Points as they are stored: those of a later write come after all of an earlier one; within a write, seq tells the order.
POINTS = T.StructType([
    T.StructField("series_id", T.LongType()),
    T.StructField("ts", T.LongType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("write", T.LongType()),
    T.StructField("seq", T.DecimalType(38, 0)),
    T.StructField("chunk_start", T.LongType()),
])

CHUNK_SECONDS = 7200
MAX_TS = 2**31 - 1


class MatchType(Enum):
    EXACT = "exact"
    WILDCARD = "wildcard"
    IWILDCARD = "iwildcard"
    LITERAL_OR = "literal_or"
    ILITERAL_OR = "iliteral_or"
    NOT_LITERAL_OR = "not_literal_or"
    NOT_ILITERAL_OR = "not_iliteral_or"
    REGEXP = "regexp"

    @property
    def excludes(self) -> bool:
        return self in (MatchType.NOT_LITERAL_OR, MatchType.NOT_ILITERAL_OR)


class QueryAggregation(Enum):
    NONE = "none"
    ZIMSUM = "zimsum"


def _present(text: str | None, what: str) -> str:
    if text is None or not text.strip():
        raise ValueError(f"{what} must not be blank")
    return text


@dataclass(frozen=True, order=True)
class Tag:
    key: str
    value: str

    def __post_init__(self) -> None:
        _present(self.key, "tag key")
        _present(self.value, "tag value")

    @property
    def raw(self) -> str:
        return f"{self.key}={self.value}"

    @classmethod
    def parse(cls, raw: str) -> Tag:
        """Split at the first equals sign."""
        key, sign, value = raw.partition("=")
        if not (key and sign and value):
            raise ValueError(f"not a tag: {raw!r}")
        return cls(key, value)


@dataclass(frozen=True)
class Metric:
    """A series: its name and its tags, sorted, each once. A key may have several values."""

    name: str
    tags: tuple[Tag, ...] = ()

    def __post_init__(self) -> None:
        _present(self.name, "metric name")

    @classmethod
    def of(cls, name: str, raw_tags: list[str | None]) -> Metric:
        raw = sorted({t.strip() for t in raw_tags if t and t.strip()})
        return cls(name, tuple(Tag.parse(t) for t in raw))

    @property
    def full_name(self) -> str:
        return " ".join([self.name, *sorted({t.raw for t in self.tags})])


@dataclass(frozen=True)
class TagMatcher:
    type: MatchType
    key: str
    pattern: str

    def __post_init__(self) -> None:
        if not isinstance(self.type, MatchType):
            raise ValueError("a matcher needs a type")
        _present(self.key, "tag key")
        _present(self.pattern, "tag pattern")

    @classmethod
    def exact(cls, key: str, value: str) -> TagMatcher:
        return cls(MatchType.EXACT, key, value)

    @classmethod
    def wildcard(cls, key: str, pattern: str, ignore_case: bool = False) -> TagMatcher:
        if "*" not in _present(pattern, "tag pattern"):
            raise ValueError(f"no * in the pattern {pattern!r}")
        return cls(MatchType.IWILDCARD if ignore_case else MatchType.WILDCARD, key, pattern)

    @classmethod
    def literal_or(cls, key: str, pattern: str, ignore_case: bool = False) -> TagMatcher:
        return cls(MatchType.ILITERAL_OR if ignore_case else MatchType.LITERAL_OR, key, pattern)

    @classmethod
    def not_literal_or(cls, key: str, pattern: str, ignore_case: bool = False) -> TagMatcher:
        return cls(MatchType.NOT_ILITERAL_OR if ignore_case else MatchType.NOT_LITERAL_OR, key, pattern)

    @classmethod
    def regexp(cls, key: str, pattern: str) -> TagMatcher:
        return cls(MatchType.REGEXP, key, pattern)


@dataclass(frozen=True)
class Query:
    metric: str
    matchers: tuple[TagMatcher, ...] = ()

    def __post_init__(self) -> None:
        _present(self.metric, "metric name")
        object.__setattr__(self, "matchers", tuple(self.matchers))
        keys = [m.key for m in self.matchers]
        if len(keys) != len(set(keys)):
            raise ValueError("a query takes one matcher for each tag key")

    @classmethod
    def parse(cls, text: str) -> Query:
        """``metric key=value key=*``: a lone * asks for the key, all else is exact."""
        name, *raw = _present(text, "query").split(" ")
        tags = [Tag.parse(t) for t in raw if t]
        return cls(name, tuple(TagMatcher.wildcard(t.key, "*") if t.value == "*" else TagMatcher.exact(t.key, t.value) for t in tags))

    @property
    def label(self) -> str:
        inside = ",".join(f"{m.key}={m.type.value}:{m.pattern}" for m in self.matchers)
        return f"{self.metric}{{{inside}}}" if inside else self.metric
