import pytest

from tickloom.plans.model import MatchType, Metric, Query, Tag, TagMatcher


def test_tags_split_at_the_first_equals_sign():
    assert Tag.parse("k=v=1") == Tag("k", "v=1")
    for bad in ("a", "a=", "=a", "=", ""):
        with pytest.raises(ValueError):
            Tag.parse(bad)


def test_canonical_names_are_sorted_trimmed_and_unique():
    m = Metric.of("load", [" host=b ", "host=a", None, "", "dc=x", "host=a"])
    assert m.full_name == "load dc=x host=a host=b"
    assert Metric.of("load", []).full_name == "load"
    for bad in ("", " "):
        with pytest.raises(ValueError):
            Metric.of(bad, [])


def test_queries_parse_stars_as_presence_and_all_else_as_exact():
    q = Query.parse("load host=* dc=a* rack=a|b")
    assert [(m.type, m.pattern) for m in q.matchers] == [(MatchType.WILDCARD, "*"), (MatchType.EXACT, "a*"), (MatchType.EXACT, "a|b")]
    assert q.label == "load{host=wildcard:*,dc=exact:a*,rack=exact:a|b}"


def test_validation():
    for make in (
        lambda: Query("m", (TagMatcher.exact("k", "a"), TagMatcher.exact("k", "b"))),
        lambda: Query(""),
        lambda: TagMatcher.exact("", "a"),
        lambda: TagMatcher.exact("k", " "),
        lambda: TagMatcher.wildcard("k", "abc"),
        lambda: TagMatcher("exact", "k", "v"),
    ):
        with pytest.raises(ValueError):
            make()
