"""``put`` lines, graphite lines and tags, to columns and back. A line that can't be parsed gets a reason, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import MAX_TS
from .chunks import chunk_start

CONTROL = "".join(map(chr, range(33)))  # what counts as white space at the ends of a tag


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(CONTROL))


def tag_struct(raw: Column) -> Column:
    """Key and value at the first equals sign."""
    at = F.locate("=", raw)
    return F.struct(F.substring(raw, F.lit(1), at - 1).alias("key"), F.substring(raw, at + 1, F.length(raw)).alias("value"), raw.alias("raw"))


def is_tag(raw: Column) -> Column:
    at = F.locate("=", raw)
    return (at > 1) & (at < F.length(raw))


def clean_tags(raw: Column) -> Column:
    """Trimmed, without nulls and blanks, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, trimmed), lambda t: t.isNotNull() & (t != ""))))


def canonical_name(metric: Column, raw: Column) -> Column:
    return F.array_join(F.concat(F.array(metric), clean_tags(raw)), " ")


def series_id(full_name: Column) -> Column:
    return F.xxhash64(full_name)


def parse_put(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines with (metric, ts, val, tags, full_name, series_id, chunk_start, reject_reason); of a rejected line all but the reason are null.

    Fields are split at single spaces; empty ones at the end don't count. White space at
    the ends of a value doesn't count, at those of a timestamp it does. Checks come in the order of name and tags, timestamp, value, range."""
    f = F.split(F.rtrim(F.col(line)), " ", -1)
    raw = clean_tags(F.when(F.size(f) > 4, F.slice(f, 5, F.greatest(F.size(f) - 4, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    name, ts, val = F.try_element_at(f, F.lit(2)), F.try_element_at(f, F.lit(3)), F.try_element_at(f, F.lit(4))
    number, value = ts.try_cast("bigint"), trimmed(val).try_cast("double")
    reason = (
        F.when(F.col(line).isNull() | (F.size(f) < 4), "fields")
        .when(f[0] != "put", "not put")
        .when(trimmed(name) == "", "name")
        .when(~F.forall(raw, is_tag), "tags")
        .when(number.isNull() | (trimmed(ts) != ts), "timestamp")
        .when(value.isNull(), "value")
        .when((number < 0) | (number > MAX_TS), "range")
    )
    parsed = lines.select("*", reason.alias("reject_reason"), name.alias("_name"), number.alias("_ts"), value.alias("_val"), raw.alias("_raw"))
    good = F.col("reject_reason").isNull()
    full = F.array_join(F.concat(F.array("_name"), F.col("_raw")), " ")
    return parsed.select(
        *[parsed[c] for c in lines.columns],
        F.when(good, F.col("_name")).alias("metric"),
        F.when(good, F.col("_ts")).alias("ts"),
        F.when(good, F.col("_val")).alias("val"),
        F.when(good, F.transform("_raw", tag_struct)).alias("tags"),
        F.when(good, full).alias("full_name"),
        F.when(good, series_id(full)).alias("series_id"),
        F.when(good, chunk_start(F.col("_ts"))).alias("chunk_start"),
        "reject_reason",
    )


def format_put(metric: Column, ts: Column, val: Column, raw_tags: Column) -> Column:
    return F.concat_ws(" ", F.lit("put"), metric, ts.cast("string"), val.cast("string"), F.array_join(raw_tags, " "))


def graphite_to_put(line: Column) -> Column:
    """``name value ts`` to a put line without tags; null for other lines."""
    f = F.split(line, " ", -1)
    return F.when(F.size(f) == 3, F.concat(F.lit("put "), f[0], F.lit(" "), f[2], F.lit(" "), f[1], F.lit(" ")))
