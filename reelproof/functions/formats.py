"""Renderings: hex, times, sizes, durations, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIAGNOSES = {
    "Clean": "every copy agrees", "MissingCopy": "a copy that should be there was not measured", "TwinMismatch": "the two cards disagree",
    "BadDestination": "a copy differs from the card", "Systematic": "every copy differs from the card in the same way",
    "SourceReadCorrupt": "the bytes read while copying differ from the card, and every copy has them", "UnrepeatableSourceRead": "the bytes read while copying differ from every later read",
    "Unclassified": "the copies disagree in no known way",
}
SLOW_MBPS = 50.0


def hex64(x: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def hex64_short(x: Column) -> Column:
    """the first eight."""
    return F.substring(hex64(x), 1, 8)


def parse_hex(text: Column) -> Column:
    """canonical digits, null if there are none or too many."""
    return F.when(F.lower(text).rlike("^[0-9a-f]{1,16}$"), F.lpad(F.lower(text), 16, "0"))


def serial_hex(n: Column) -> Column:
    """F2"""
    return F.lpad(F.hex(n), 8, "0")


def rfc3339(ts: Column) -> Column:
    """seconds, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """any offset; null if it is no time."""
    return F.try_to_timestamp(text)


def local(ts: Column, tz: Column, pattern: str) -> Column:
    """an instant as the operator's own clock shows it."""
    return F.date_format(F.from_utc_timestamp(ts, tz), pattern)


def session_id(ts: Column, tz: Column) -> Column:
    """the operator's own date and time."""
    return local(ts, tz, "yyyyMMdd-HHmmss")


def local_clock(ts: Column, tz: Column) -> Column:
    """F4"""
    return local(ts, tz, "HH:mm:ss.SSS")


def local_offset(ts: Column, tz: Column) -> Column:
    """how far the operator's clock is from UTC."""
    minutes = F.floor((F.unix_seconds(F.from_utc_timestamp(ts, tz)) - F.unix_seconds(ts)) / 60)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))


def thousands(n: Column) -> Column:
    """F7"""
    return F.format_number(n, 0)


def gigabytes(n: Column) -> Column:
    return F.concat(F.format_string("%.1f", n / F.lit(1e9)), F.lit(" GB"))


def detail_line(files: Column, size: Column, twin_matched: Column, distinct: Column, failed: Column) -> Column:
    """what a verdict has established, in one line."""
    failures = F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" FAILED")))
    return F.concat_ws(" · ", F.concat(thousands(files), F.lit(" files")), gigabytes(size), F.when(twin_matched, "twin-matched"), F.when(distinct, "2 distinct volumes"), failures)


def scaled(n: Column, units: tuple[tuple[str, float], ...], form: str, bare: Column) -> Column:
    out = F.when(n >= units[0][1], F.concat(F.format_string(form, n / F.lit(units[0][1])), F.lit(f" {units[0][0]}")))
    for unit, by in units[1:]:
        out = out.when(n >= by, F.concat(F.format_string(form, n / F.lit(by)), F.lit(f" {unit}")))
    return out.otherwise(bare)


def human_bytes(n: Column) -> Column:
    """F8: in the largest of GB, MB, KB and B that it reaches."""
    return scaled(n, (("GB", 1e9), ("MB", 1e6), ("KB", 1e3)), "%.1f", F.concat(n.cast("string"), F.lit(" B")))


def fixed_bytes(n: Column) -> Column:
    """F8: in a fixed width, up to TB."""
    return scaled(n, (("TB", 1e12), ("GB", 1e9), ("MB", 1e6), ("kB", 1e3)), "%7.2f", F.format_string("%7d B ", n))


def mbps(rate: Column) -> Column:
    """F8: in a fixed width; a dash for a device that does nothing."""
    return F.when(rate <= 0, F.lit("—".rjust(11))).otherwise(F.format_string("%6.0f MB/s", rate))


def plain_duration(seconds: Column) -> Column:
    """1 h 42 m, 8 m, 30 s."""
    s = seconds.cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60)
    return (
        F.when(s >= 3600, F.concat(hours.cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" m")))
        .when(s >= 60, F.concat(minutes.cast("string"), F.lit(" m")))
        .otherwise(F.concat(s.cast("string"), F.lit(" s")))
    )


def clock_duration(seconds: Column) -> Column:
    """8m 12s."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))


def slow_link(rate: Column, remaining: Column) -> Column:
    """Projected seconds over a link known to be slow; null if it is not."""
    known = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate <= SLOW_MBPS)
    return F.when(known, F.floor(remaining / (rate * F.lit(1e6))).cast("long"))


def describe(kind: Column) -> Column:
    """P18"""
    out = F.when(F.lit(False), F.lit(""))
    for k, text in DIAGNOSES.items():
        out = out.when(kind == k, text)
    return out.otherwise(F.concat(F.lit("unknown: "), kind))


def with_field(json: Column, schema: str, field: str, value: Column) -> Column:
    """one field of a JSON object set, the rest as it was."""
    return F.to_json(F.from_json(json, schema).withField(field, value))


def log_line(at: Column, level: Column, stage: Column, msg: Column) -> Column:
    """Time, level and stage in fixed columns, then the message."""
    return F.concat(F.date_format(at, "HH:mm:ss"), F.lit("  "), F.rpad(level, 5, " "), F.lit("  "), F.rpad(stage, 10, " "), F.lit("  "), msg)


def log_matches(level: Column, stage: Column, msg: Column, wanted: str | None, needle: str) -> Column:
    """The level, if one is wanted, and the needle in message or stage, whatever its case."""
    low = needle.lower()
    found = F.lower(msg).contains(low) | F.lower(stage).contains(low)
    return found if wanted is None else (level == wanted) & found


def is_droppable(event: Column) -> Column:
    """Events that may be lost when the sink is behind."""
    return event.isin("bytes", "queue", "throughput")
