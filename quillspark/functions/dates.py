"""Dates, years and version numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def when_label(ts: Column, now: Column) -> Column:
    """A time for today, Yesterday, the weekday within a week, else the day with its month and, in another year, the year."""
    days = F.datediff(now, ts)
    hour = F.when(F.hour(ts) % 12 == 0, 12).otherwise(F.hour(ts) % 12)
    clock = F.concat(hour.cast("string"), F.lit(":"), F.lpad(F.minute(ts).cast("string"), 2, "0"), F.when(F.hour(ts) < 12, " am").otherwise(" pm"))
    day = F.concat_ws(" ", F.dayofmonth(ts), F.date_format(ts, "MMM"))
    return F.when(days == 0, clock).when(days == 1, "Yesterday").when(days < 7, F.date_format(ts, "EEEE")).when(F.year(ts) == F.year(now), day).otherwise(F.concat_ws(" ", day, F.year(ts)))


def years(text: Column) -> Column:
    """All numbers of three or four digits, as years."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b\d{3,4}\b"), F.lit(0)), lambda y: y.cast("int"))


def year_range(text: Column) -> Column:
    """`1616-1683`, `c. 280–367` or a single year as a struct of first and last; null without a year."""
    found = years(text)
    return F.when(F.size(found) > 0, F.struct(F.array_min(found).alias("first"), F.array_max(found).alias("last")))


def iso(ts: Column) -> Column:
    """A time as ISO 8601 text to the millisecond, as stored records have it."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def from_iso(text: Column) -> Column:
    """ISO 8601 text, with or without fraction, zone or time of day, as a time; null for anything else."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd")))


def version_key(version: Column) -> Column:
    """A version as a struct of numeric parts and build, which compares as versions do; null for anything that is none.

    A leading v is dropped, the build stands behind the first plus, and closing zeros do not count, so
    2026.8 and 2026.8.0 are one version. Numbers have 64 bits: a part beyond that is none, a build
    that is no number, or is beyond that, is 0.
    """
    halves = F.split(F.regexp_replace(F.trim(version), "^[vV]", ""), r"\+", 2)
    number = lambda digits: F.when(F.trim(digits).rlike("^[0-9]+$"), F.trim(digits).try_cast("long"))
    build = F.trim(F.get(halves, F.lit(1))).rlike("^-?[0-9]+$")
    given = F.transform(F.split(halves[0], r"\."), number)
    parts = F.transform(F.split(F.regexp_replace(halves[0], r"(?:\.\s*0+\s*)+$", ""), r"\."), number)
    return F.when(F.forall(given, lambda n: n.isNotNull()), F.struct(parts.alias("parts"), F.coalesce(F.when(build, F.trim(halves[1]).try_cast("long")), F.lit(0).cast("long")).alias("build")))


RELEASE = "version string, build int, notes string, url string, platforms map<string, struct<kind: string, url: string, version: string, build: int, bytes: long, sha256: string>>"
# How a release is delivered.
DELIVERIES = ("download", "store")


def release(json: Column) -> Column:
    """A release manifest as a struct of version, notes and platforms; null where it has no usable version or platform.

    A platform of an unknown kind, without an https address, or a download without a size and a SHA-256
    is left out; one without a version of its own has the manifest's.
    """
    def usable(_, p: Column) -> Column:
        file = F.coalesce((p["bytes"] > 0) & F.lower(p["sha256"]).rlike("^[0-9a-f]{64}$"), F.lit(False))
        return p["kind"].isin(*DELIVERIES) & F.coalesce(p["url"].rlike(r"^https://[^/\s]+"), F.lit(False)) & ((p["kind"] == "store") | file)

    doc = F.from_json(json, RELEASE)
    own = F.transform_values(F.map_filter(doc["platforms"], lambda k, p: F.coalesce(usable(k, p), F.lit(False))), lambda k, p: F.struct(p["kind"].alias("kind"), p["url"].alias("url"), F.when(version_key(p["version"]).isNull(), doc["version"]).otherwise(p["version"]).alias("version"), p["bytes"].alias("bytes"), F.lower(p["sha256"]).alias("sha256")))
    return F.when(version_key(doc["version"]).isNotNull() & (F.size(own) > 0), F.struct(doc["version"].alias("version"), F.nullif(F.trim(doc["notes"]), F.lit("")).alias("notes"), own.alias("platforms")))
