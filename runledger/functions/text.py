"""Scalar column functions (N-*) as built-in Spark expressions.

All of them compile to JVM expressions inside whole-stage codegen; none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats.
DISPLAY_FORMAT = "MM/dd/yyyy, HH:mm:ss"          # strftime "%m/%d/%Y, %H:%M:%S"
DATE_STAMP_FORMAT = "yyyy-MM-dd"                 # strftime "%Y-%m-%d"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


_NTZ_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` value, computed
    without the session time zone (a cast to TIMESTAMP would shift by the
    zone's offset and lose or gain an hour across daylight-saving changes)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_NTZ_EPOCH), _c(ts))


def micros_between(start, end) -> Column:
    """``end - start`` in microseconds for ``timestamp_ntz`` values."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


# N-3
def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def dir_name(path) -> Column:
    """Everything before the last '/' ('' when there is none)."""
    return F.regexp_extract(_c(path), r"^(.*)/", 1)


# N-4 / N-6
def display_time(ts) -> Column:
    return F.date_format(_c(ts), DISPLAY_FORMAT)


def date_stamp(ts) -> Column:
    return F.date_format(_c(ts), DATE_STAMP_FORMAT)


# N-5
def iso_format(ts) -> Column:
    """``datetime.isoformat()``: microseconds only when non-zero."""
    t = _c(ts)
    return F.when(epoch_micros(t) % 1_000_000 == 0, F.date_format(t, ISO_SECONDS)) \
        .otherwise(F.date_format(t, ISO_MICROS))


def from_iso(text) -> Column:
    return F.to_timestamp_ntz(_c(text))


# N-7
def status_label(status) -> Column:
    """Lower case, first '_' replaced by a space."""
    return F.regexp_replace(F.lower(_c(status)), "^([^_]*)_", "$1 ")


# N-9
def line_ending(text) -> Column:
    """'\\r\\n' when CR, LF and CRLF counts are all equal, '\\r' when CR outnumbers
    LF, else '\\n'; NULL when the text has no line break."""
    t = _c(text)
    cr = F.length(t) - F.length(F.replace(t, F.lit("\r"), F.lit("")))
    lf = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    crlf = (F.length(t) - F.length(F.replace(t, F.lit("\r\n"), F.lit("")))) / 2
    return (F.when(cr + lf == 0, F.lit(None).cast("string"))
            .when((crlf == cr) & (crlf == lf), F.lit("\r\n"))
            .when(cr > lf, F.lit("\r"))
            .otherwise(F.lit("\n")))


def line_ending_name(text) -> Column:
    le = line_ending(text)
    return F.when(le == "\r\n", "CRLF").when(le == "\r", "CR").when(le == "\n", "LF")


# N-13
def preprocess_upper(text) -> Column:
    return F.upper(_c(text))


# N-14 / N-15
def url_scheme(url) -> Column:
    return F.parse_url(_c(url), F.lit("PROTOCOL"))


def url_authority(url) -> Column:
    return F.parse_url(_c(url), F.lit("AUTHORITY"))


def url_path(url) -> Column:
    return F.parse_url(_c(url), F.lit("PATH"))


def url_last_segment(url) -> Column:
    return F.element_at(F.split(url_path(url), "/"), -1)


def is_https(url) -> Column:
    return F.coalesce(url_scheme(url) == "https", F.lit(False))
