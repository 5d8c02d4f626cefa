import random

import pytest
from tickloom.functions.matching import selects
from tickloom.functions.parsing import parse_put
from tickloom.operators.catalog import series_of
from tickloom.plans.model import Query, TagMatcher

M = TagMatcher


def series(spark, *names):
    lines = [(f"put {n.split(' ')[0]} 1 1 {' '.join(n.split(' ')[1:])}".rstrip(),) for n in names]
    return series_of(parse_put(spark.createDataFrame(lines, "value string")).filter("reject_reason IS NULL"))


def found(rows, q):
    return {r.full_name for r in rows.filter(selects(q)).select("full_name").collect()}


@pytest.fixture(scope="module")
def hosts(spark):
    return series(spark, "m k=v", "m k=V2 z=1", "m k=v3 z=2", "m z=3", "n k=v", "m k=a*b", "m k=ogg-01.ops.ankh.morpork.com", "m k=Здравствуй")


CASES = [
    (Query("m"), 7),
    (Query("none"), 0),
    (Query("m", (M.exact("k", "v"),)), 1),
    (Query("m", (M.exact("q", "v"),)), 0),
    (Query("m", (M.exact("k", "v3"), M.exact("z", "2"))), 1),
    (Query("m", (M.exact("k", "v3"), M.exact("z", "1"))), 0),
    (Query("m", (M.wildcard("k", "*"),)), 6),
    (Query("m", (M.wildcard("k", "v*"),)), 2),
    (Query("m", (M.wildcard("k", "v*", True),)), 3),
    (Query("m", (M.wildcard("k", "*3"),)), 1),
    (Query("m", (M.wildcard("k", "ogg*ops*mor"),)), 1),
    (Query("m", (M.wildcard("k", "*ops*mor"),)), 0),
    (Query("m", (M.wildcard("k", "ogg*OPS*", True),)), 1),
    (Query("m", (M.wildcard("k", "Здр*"),)), 1),
    (Query("m", (M.wildcard("k", "здр*уй", True),)), 1),
    (Query("m", (M.wildcard("k", "*****"),)), 6),
    (Query("m", (M.literal_or("k", "v|v3|"),)), 2),
    (Query("m", (M.literal_or("k", "|"),)), 0),
    (Query("m", (M.literal_or("k", "v2|V3", True),)), 2),
    (Query("m", (M.not_literal_or("k", "v|v3"),)), 4),
    (Query("m", (M.not_literal_or("k", "|"),)), 6),
    (Query("m", (M.not_literal_or("k", "v2", True),)), 5),
    (Query("m", (M.wildcard("z", "*"), M.not_literal_or("k", "v3"))), 2),  # a series without the key stays
    (Query("m", (M.not_literal_or("k", "v3|V2"), M.not_literal_or("z", "1"))), 1),  # goes only if both name it
    (Query("m", (M.regexp("k", "v[0-9]"),)), 1),
    (Query("m", (M.regexp("k", "(?i)V"),)), 3),
    (Query("m", (M.regexp("k", "^a"), M.exact("k2", "x"))), 0),
]


@pytest.mark.parametrize("q,n", CASES, ids=lambda x: getattr(x, "label", str(x)))
def test_cases(hosts, q, n):
    assert len(found(hosts, q)) == n


def test_a_repeated_key(spark):
    rows = series(spark, "m k=a k=b")
    assert found(rows, Query("m", (M.exact("k", "b"),)))
    assert found(rows, Query("m", (M.literal_or("k", "b"),)))
    assert not found(rows, Query("m", (M.regexp("k", "b"),)))  # patterns see the first value
    assert not found(rows, Query("m", (M.wildcard("k", "b*"),)))


def test_a_bad_pattern_fails(hosts):
    with pytest.raises(Exception, match="PATTERN"):
        found(hosts, Query("m", (M.regexp("k", "(["),)))


def glob(value, pattern):
    lead, trail, body = pattern[0] == "*", pattern[-1] == "*", pattern.strip("*")
    if not body:
        return True
    parts, at = body.split("*"), 0
    if lead and not trail and not value.endswith(parts[-1]) or trail and not lead and not value.startswith(parts[0]):
        return False
    for p in parts:
        if value.find(p, at) < 0:
            return False
        at += len(p)
    return True


def test_wildcards_against_a_plain_version(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)})
    rows = series(spark, *(f"m k={v}" for v in values))
    for _ in range(25):
        pattern = "".join(rng.choices("ab*", k=rng.randint(1, 5)))
        if "*" in pattern:
            assert found(rows, Query("m", (M.wildcard("k", pattern),))) == {f"m k={v}" for v in values if glob(v, pattern)}, pattern


def test_selection_stays_in_built_in_functions(hosts):
    plan = hosts.filter(selects(Query("m", (M.wildcard("k", "v*"), M.not_literal_or("z", "1")))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
