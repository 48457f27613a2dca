"""Column functions on log positions and PostgreSQL timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PG_EPOCH_S = 946_684_800
MAX = 9_223_372_036_854_775_807


def format_lsn(lsn: Column) -> Column:
    """`high/low` in upper-case hex without padding."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def parse_lsn(text: Column) -> Column:
    """The position of `high/low`, null unless both are hex numbers of at most 32 bits; from 80000000/0 on too, as positions are signed here."""
    fits = text.rlike(r"^0*[0-9A-Fa-f]{1,8}/0*[0-9A-Fa-f]{1,8}$")
    part = lambda i: F.conv(F.split(text, "/")[i], 16, 10).cast("long")
    return F.when(fits & (part(0) < 0x80000000), part(0) * F.lit(1 << 32) + part(1))


def unix_seconds(pg_us: Column) -> Column:
    """Unix seconds of microseconds since 2000-01-01, cut toward zero before the shift."""
    return F.call_function("div", pg_us, F.lit(1_000_000)) + PG_EPOCH_S


def pg_micros(unix_s: Column) -> Column:
    return (unix_s - PG_EPOCH_S) * 1_000_000


def now_pg_micros() -> Column:
    return F.unix_micros(F.current_timestamp()) - PG_EPOCH_S * 1_000_000


def timestamp(pg_us: Column) -> Column:
    return F.timestamp_micros(pg_us + PG_EPOCH_S * 1_000_000)


def url_parts(url: Column) -> Column:
    """host, port, user and database of postgres URLs, with the usual defaults."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    user = F.split(F.try_parse_url(url, F.lit("USERINFO")), ":")[0]
    database = F.ltrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    filled = lambda c, other: F.coalesce(F.when(c != "", c), F.lit(other))
    return F.struct(
        filled(F.try_parse_url(url, F.lit("HOST")), "localhost").alias("host"), F.coalesce(F.when(port != "", port).cast("int"), F.lit(5432)).alias("port"),
        filled(user, "postgres").alias("user"), filled(database, "postgres").alias("database"),
    )


def minus(a: Column, b: Column) -> Column:
    """Saturating difference."""
    return F.greatest(a - b, F.lit(0).cast("long"))


def plus(a: Column, b: Column) -> Column:
    """Saturating sum."""
    return F.coalesce(F.try_add(a, b), F.lit(MAX))
