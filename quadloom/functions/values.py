"""Typed lanes of a quad's object, coercion on write, and formatting."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = "s string, p string, o string, o_kind string, dt string, lang string, o_num double, o_long long, o_ts timestamp_ntz, o_bool boolean, g string"
LANES = ["o", "o_kind", "dt", "lang", "o_num", "o_long", "o_ts", "o_bool"]
NUMBERS = ("xsd:int", "xsd:integer", "xsd:long", "xsd:short", "xsd:unsignedInt", "xsd:duration", "xsd:double", "xsd:float", "xsd:decimal")
WHOLE = ("xsd:int", "xsd:integer", "xsd:long", "xsd:short", "xsd:unsignedInt", "xsd:duration")


def lanes(o: Column, kind: str, datatype: str | None) -> list[Column]:
    """The lanes of a value of a column whose datatype is known; only the one that fits is set."""
    null = lambda t: F.lit(None).cast(t)
    text = o.cast("string")
    return [
        text.alias("o"),
        F.lit(kind).alias("o_kind"),
        F.lit(datatype).cast("string").alias("dt"),
        null("string").alias("lang"),
        (o.cast("double") if datatype in NUMBERS else null("double")).alias("o_num"),
        (o.cast("long") if datatype in WHOLE else null("long")).alias("o_long"),
        (o.cast("timestamp_ntz") if datatype in ("xsd:dateTime", "xsd:date") else null("timestamp_ntz")).alias("o_ts"),
        (o.cast("boolean") if datatype == "xsd:boolean" else null("boolean")).alias("o_bool"),
    ]


def parsed_lanes(o: str = "o", datatype: str = "dt") -> dict[str, Column]:
    """Lanes of lexical values with a datatype column; what doesn't parse has no lane."""
    text, kind = F.col(o), F.col(datatype)
    return {
        "o_num": F.when(kind.isin(*NUMBERS), text.try_cast("double")),
        "o_long": F.when(kind.isin(*WHOLE), text.try_cast("long")),
        "o_ts": F.when(kind.isin("xsd:dateTime", "xsd:date"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).cast("timestamp_ntz")),
        "o_bool": F.when(kind == "xsd:boolean", text.isin("true", "1")),
    }


def lane_of(value: object) -> tuple[str, object]:
    """The lane that a literal is compared in."""
    if isinstance(value, bool):
        return "o_bool", value
    if isinstance(value, int | float):
        return "o_num", float(value)
    if isinstance(value, dt.datetime):
        return "o_ts", value
    if isinstance(value, dt.date):
        return "o_ts", dt.datetime.combine(value, dt.time())
    return "o", str(value)


def coerced(o: str, range_: str) -> Column:
    """What a written value becomes under a property's range; null where it cannot."""
    text, to = F.col(o), F.col(range_)
    fraction = F.when(text.rlike(r"^-?\d+/\d+$"), F.try_divide(F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")).cast("string"))
    year = F.when(text.rlike(r"^\d{1,4}$") & (text.try_cast("int") > 0), F.concat(F.lpad(text, 4, "0"), F.lit("-01-01T00:00:00")))
    url = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit("file:"), F.when(text.startswith("/"), F.lit("//")).otherwise(F.lit("")), text))
    return (
        F.when(to.isin("xsd:double", "xsd:float", "xsd:decimal"), F.coalesce(fraction, F.when(text.try_cast("double").isNotNull(), text)))
        .when(to.isin(*WHOLE), F.when(text.try_cast("long").isNotNull(), text))
        .when(to == "xsd:boolean", F.when(F.lower(text).isin("true", "1"), "true").when(F.lower(text).isin("false", "0"), "false"))
        .when(to.isin("xsd:dateTime", "xsd:date"), F.coalesce(year, F.when(F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).isNotNull(), text)))
        .when(to == "nie:url", url)
        .otherwise(text)
    )


def byte_size(n: Column) -> Column:
    """1.5 MiB and the like."""
    step = F.when(n < 1024, 0).otherwise(F.least(F.lit(4), F.floor(F.log(2.0, F.greatest(n, F.lit(1)).cast("double")) / 10))).cast("int")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("B", "KiB", "MiB", "GiB", "TiB")]), step + 1)
    return F.concat(F.when(step == 0, n.cast("string")).otherwise(F.format_number(n / F.pow(F.lit(1024.0), step), 1)), F.lit(" "), unit)


def duration(seconds: Column) -> Column:
    """h:mm:ss"""
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


#: The date formats that file metadata comes in, in the order in which they are tried.
DATE_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd MMM yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy-MM", "yyyy",
)


def any_date(text: Column) -> Column:
    """The first of DATE_FORMATS that a text has, as a timestamp; null if it has none."""
    bare = F.regexp_replace(F.trim(text), r"(?:Z|[+-]\d\d:?\d\d)$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS])


def contacts(text: Column) -> Column:
    """The names in a list of contacts, without what stands in brackets."""
    parts = F.split(F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", ""), r"[,;]| ft\.? | feat\.? ")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
