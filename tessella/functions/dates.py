"""Dates and times as ISO text. Date and timestamp columns are accepted as well. No zone is ever shifted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import as_column

#: Zone suffix of an ISO text.
ZONE = r"(Z|[+-]\d{2}:\d{2})$"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def iso(value) -> Column:
    """ISO text of a text, date or timestamp value."""
    value = as_column(value)
    return F.regexp_replace(F.trim(value.cast("string")), r"^(\d{4,}-\d\d-\d\d) ", "$1T")


def local(value) -> Column:
    """The local timestamp of ISO text, without its zone; 24:00:00 is the next day's midnight."""
    value = as_column(value)

    def read(s: Column) -> Column:
        late = s.rlike(r"T24:00(:00(\.0+)?)?$")
        return F.when(late, F.to_timestamp_ntz(F.regexp_replace(s, r"T24:00", "T00:00")) + F.expr("interval 1 day")).otherwise(F.to_timestamp_ntz(F.regexp_replace(s, r"T24:00", "T00:00")))

    # A timestamp is what its text says.
    return F.when(F.typeof(value).isin("timestamp", "timestamp_ntz"), value.cast("timestamp_ntz")).otherwise(bound(F.regexp_replace(iso(value), ZONE, ""), read))


def date_from_datetime(value) -> Column:
    return F.trim(F.get(F.split(iso(value), "T"), F.lit(0)))


def time_from_datetime(value) -> Column:
    return F.get(F.split(iso(value), "T"), F.lit(1))


def year_from_datetime(value) -> Column:
    return F.year(local(value))


def month_from_datetime(value) -> Column:
    return F.month(local(value))


def day_from_datetime(value) -> Column:
    return F.day(local(value))


def weekday(value) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(local(value)) + 1


def hours_from_datetime(value) -> Column:
    return F.hour(local(value))


def minutes_from_datetime(value) -> Column:
    return F.minute(local(value))


def zone_of(value) -> Column:
    return F.regexp_extract(iso(value), ZONE, 1)


def coerce_datetime(value) -> Column:
    """A date becomes its midnight and keeps its zone; a date and time stays."""
    s = iso(value)
    return F.when(s.contains("T"), s).otherwise(F.concat(F.regexp_replace(s, ZONE, ""), F.lit("T00:00:00"), zone_of(s)))


def datetime_from_date_and_time(date, time=None) -> Column:
    """A missing time is midnight; two different zones are an error."""
    d = iso(date)
    t = F.coalesce(as_column(time).cast("string"), F.lit("00:00:00")) if time is not None else F.lit("00:00:00")
    dz, tz = F.regexp_extract(d, ZONE, 1), F.regexp_extract(t, ZONE, 1)
    clash = (dz != "") & (tz != "") & (dz != tz)
    zone = F.when(clash, F.raise_error(F.lit("date and time have different zones")).cast("string")).when(tz != "", tz).otherwise(dz)
    return F.concat(F.regexp_replace(d, r"(Z|(?<=\d{4}-\d\d-\d\d)[+-]\d{2}:\d{2})$", ""), F.lit("T"), F.regexp_replace(t, ZONE, ""), zone)


def zone_text(minutes) -> Column:
    m = as_column(minutes)
    bad = (m < -840) | (m > 840)
    shown = F.format_string("%s%02d:%02d", F.when(m < 0, "-").otherwise("+"), F.floor(F.abs(m) / 60), F.abs(m) % 60)
    return F.when(bad, F.raise_error(F.lit("zone beyond 14 hours")).cast("string")).when(m == 0, "Z").otherwise(shown)


def datetime_from_parts(year, month, day, hour=0, minute=0, second=0, millis=0, zone=None) -> Column:
    """ISO text of checked parts; zone in minutes."""
    y, mo, d, h, mi, s, ms = map(as_column, (year, month, day, hour, minute, second, millis))
    stamp = F.make_timestamp_ntz(y, mo, d, h, mi, s.cast("decimal(16,6)"))
    shown = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(ms > 0, F.regexp_replace(F.format_string(".%03d", ms), "0+$", "")).otherwise("")
    return F.concat(shown, fraction, zone_text(zone) if zone is not None else F.lit(""))


def duration_from_parts(year=0, month=0, day=0, hour=0, minute=0, second=0, millis=0, negative=False) -> Column:
    """ISO duration without zero parts; PT0S if all are zero."""
    y, mo, d, h, mi, s, ms = map(as_column, (year, month, day, hour, minute, second, millis))
    part = lambda v, mark: F.when(v != 0, F.concat(v.cast("string"), F.lit(mark))).otherwise("")
    seconds = F.when((s != 0) | (ms != 0), F.concat(s.cast("string"), F.when(ms != 0, F.regexp_replace(F.format_string(".%03d", ms), "0+$", "")).otherwise(""), F.lit("S"))).otherwise("")
    date, time = F.concat(part(y, "Y"), part(mo, "M"), part(d, "D")), F.concat(part(h, "H"), part(mi, "M"), seconds)
    body = F.concat(date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(body == "", "PT0S").otherwise(F.concat(F.when(as_column(negative), "-").otherwise(""), F.lit("P"), body))


def duration_parts(duration) -> tuple[Column, Column]:
    """Months, and seconds as a decimal, of an ISO duration."""
    s = as_column(duration)
    part = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("decimal(18,3)"), F.lit(0))
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    date = r"^-?P[^T]*?"
    months = part(date + r"(\d+)Y") * 12 + part(date + r"(\d+)M")
    seconds = part(date + r"(\d+)D") * 86400 + part(r"T(?:.*?)(\d+)H") * 3600 + part(r"T(?:[^S]*?)(\d+)M") * 60 + part(r"T(?:.*?)(\d+(?:\.\d+)?)S")
    return (sign * months).cast("int"), (sign * seconds).cast("decimal(18,6)")


def datetime_add(value, *durations) -> Column:
    """Each duration adds its months first, with the day held within the month, then its seconds; null durations add
    nothing. The zone is kept."""
    stamp = local(value)
    for d in durations:
        months, seconds = duration_parts(d)
        moved = stamp + F.make_interval(months=months) + F.make_dt_interval(secs=seconds)
        stamp = F.when(as_column(d).isNull(), stamp).otherwise(moved)
    shown = F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), zone_of(value))
    return shown


#: Picture components: marker -> (pattern letter by minimal width, text to match).
FORMAT = {"Y": {1: "yyyy", 2: "yy", 4: "yyyy"}, "M": {1: "M", 2: "MM"}, "D": {1: "d", 2: "dd"}, "H": {1: "H", 2: "HH"}, "h": {1: "h", 2: "hh"}, "m": {1: "m", 2: "mm"}, "s": {1: "s", 2: "ss"}}
#: Components that are two digits wide unless the picture says otherwise (fixed value).
TWO = {"m", "s"}


def picture_parts(picture: str) -> list[tuple[str, str, str]]:
    """('text', literal, '') and (component, presentation, width) in order; [[ and ]] are brackets."""
    out, at = [], 0
    for m in re.finditer(r"\[\[|\]\]|\[([YMDdFHhmsfPZzW])([^\],]*)(?:,([^\]]*))?\]", picture):
        if m.start() > at:
            out.append(("text", picture[at : m.start()], ""))
        out.append(("text", m[0][0], "") if m[1] is None else (m[1], m[2], m[3] or ""))
        at = m.end()
    if at < len(picture):
        out.append(("text", picture[at:], ""))
    if any(k == "text" and ("[" in v) and len(v) > 1 for k, v, _ in out):
        raise ValueError(f"bad picture: {picture}")
    return out


def width_of(component: str, presentation: str, width: str) -> int:
    found = re.match(r"(\d+)", width)
    if found:
        return int(found[1])
    return len(presentation) if presentation.isdigit() else 2 if component in TWO else 1


def format_datetime(value, picture: str) -> Column:
    """An XPath picture such as '[D01] [MNn] [Y]'; names are English."""
    parts = [(kind, shown, width_of(kind, shown, width), width) for kind, shown, width in picture_parts(picture)]
    if all(kind == "text" or kind in FORMAT and shown[:1] not in ("N", "n") for kind, shown, _, _ in parts):
        # Digits and text only: one pattern.
        pattern = "".join("'" + shown.replace("'", "''") + "'" if kind == "text" else FORMAT[kind].get(n) or FORMAT[kind][max(FORMAT[kind])] for kind, shown, n, _ in parts)
        return F.when(as_column(value).isNotNull(), F.date_format(local(value), pattern))
    return bound(local(value), lambda stamp: shown_parts(value, stamp, parts))


def shown_parts(value, stamp: Column, parts: list) -> Column:
    pieces = []
    for kind, shown, n, width in parts:
        if kind == "text":
            pieces.append(F.lit(shown))
        elif kind in ("M", "F") and shown[:1] in ("N", "n"):
            name = F.date_format(stamp, "MMMM" if kind == "M" else "EEEE")
            most = re.search(r"-(\d+)$", width)
            name = F.left(name, F.lit(int(most[1]))) if most else name
            pieces.append(F.upper(name) if shown == "N" else F.lower(name) if shown == "n" else name)
        elif kind == "F":
            pieces.append((F.weekday(stamp) + 1).cast("string"))
        elif kind == "P":
            mark = F.lower(F.date_format(stamp, "a"))
            pieces.append(F.upper(mark) if shown == "N" else mark)
        elif kind == "d":
            pieces.append(F.lpad(F.dayofyear(stamp).cast("string"), max(n, 1), "0") if n > 1 else F.dayofyear(stamp).cast("string"))
        elif kind == "W":
            pieces.append(F.weekofyear(stamp).cast("string"))
        elif kind == "f":
            pieces.append(F.left(F.date_format(stamp, "SSSSSS"), F.lit(n)))
        elif kind in "Zz":
            pieces.append(F.when(zone_of(value) == "Z", "+00:00").otherwise(zone_of(value)))
        else:
            known = FORMAT[kind]
            pieces.append(F.date_format(stamp, known.get(n) or known[max(known)]))
    return F.when(as_column(value).isNotNull(), F.concat(*pieces))


def format_date(value, picture: str) -> Column:
    return format_datetime(value, picture)


def format_time(value, picture: str) -> Column:
    return format_datetime(F.concat(F.lit("1970-01-01T"), as_column(value)), picture)


#: English month names by number (fixed values).
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


#: Stands between the components that a text was cut into.
UNIT = "\x1f"


def parsed(value, picture: str, use) -> Column:
    """use(the components of a text that follows a picture, as texts; null where the text does not)."""
    pattern, groups = "", []
    for kind, shown, width in picture_parts(picture):
        if kind == "text":
            pattern += re.escape(shown).replace("/", "\\/")
            continue
        n = width_of(kind, shown, width)
        if shown[:1] in ("N", "n") and kind in "MFP":
            pattern += r"(\p{L}+)"
        elif kind in "Zz":
            pattern += r"(Z|[+-]\d\d:?\d\d)"
        elif kind == "Y" and n in (1, 4):
            pattern += r"(\d{4})"
        else:
            pattern += rf"(\d{{{n}}})" if n > 1 else r"(\d{1,2})" if kind != "f" else r"(\d+)"
        groups.append(kind + ("n" if shown[:1] in ("N", "n") else ""))
    s = as_column(value)
    cut = F.when(s.rlike(f"^{pattern}$"), F.split(F.regexp_replace(s, f"^{pattern}$", UNIT.join(f"${i}" for i in range(1, len(groups) + 1))), UNIT))

    def named(parts: Column) -> Column:
        out = {}
        for i, kind in enumerate(groups):
            got = F.nullif(F.get(parts, F.lit(i)), F.lit(""))
            if kind == "Mn":
                got = F.coalesce(*[F.when(F.lower(got).isin(m, m[:3]), f"{k:02d}") for k, m in enumerate(MONTHS, 1)])
                kind = "M"
            out[kind] = got
        return use(out)

    return bound(cut, named)


def parse_date(value, picture: str) -> Column:
    """ISO date of a text in a picture such as '[D01].[M01].[Y]'; null for null, an error for another form."""

    def made(p: dict[str, Column]) -> Column:
        year = F.when(F.length(p["Y"]) == 2, F.concat(F.lit("20"), p["Y"])).otherwise(p["Y"])
        text = F.concat_ws("-", year, F.lpad(p.get("M", F.lit("01")), 2, "0"), F.lpad(p.get("D", F.lit("01")), 2, "0"))
        return bound(text, lambda t: checked(value, F.try_to_date(t, "yyyy-MM-dd").isNotNull() & p["Y"].isNotNull(), t))

    return parsed(value, picture, made)


def checked(value, ok: Column, made: Column) -> Column:
    value = as_column(value)
    return F.when(ok, made).when(value.isNotNull(), F.raise_error(F.concat(F.lit("not in this form: "), value)).cast("string"))


def parse_time(value, picture: str) -> Column:
    def made(p: dict[str, Column]) -> Column:
        hour = p.get("H")
        if hour is None:
            twelve = p["h"].try_cast("int") % 12
            late = F.lower(p["Pn"]).startswith("p") if "Pn" in p else F.lit(False)
            hour = (twelve + F.when(late, 12).otherwise(0)).cast("string")
        two = lambda c: F.lpad(c, 2, "0")
        text = F.concat_ws(":", two(hour), two(p.get("m", F.lit("00"))), two(p.get("s", F.lit("00"))))
        if "f" in p:
            text = F.concat(text, F.lit("."), p["f"])
        if "Z" in p:
            text = F.concat(text, F.regexp_replace(p["Z"], r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
        return bound(text, lambda t: checked(value, t.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d"), t))

    return parsed(value, picture, made)


def parse_datetime(value, picture: str) -> Column:
    return F.concat(parse_date(value, picture), F.lit("T"), parse_time(value, picture))


#: Zone names of code 303 and 304 and their offsets (fixed values).
ZONES = {"UTC": "Z", "GMT": "Z", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-09:00"}
#: Compact forms by code: digits of date and time (fixed values).
CODES = {"102": "YYYYMMDD", "203": "YYYYMMDDhhmm", "204": "YYYYMMDDhhmmss", "205": "YYYYMMDDhhmm+zzzz", "303": "YYYYMMDDhhmm zone", "304": "YYYYMMDDhhmmss zone"}


def compact_datetime(value, code: str) -> Column:
    """ISO text of a compact date and time by its format code."""
    if code not in CODES:
        raise ValueError(f"unknown code {code}")
    s = as_column(value)
    at = lambda i, n: F.substring(s, i, n)
    date = F.concat_ws("-", at(1, 4), at(5, 2), at(7, 2))
    if code == "102":
        time, rest = F.lit("00:00:00"), F.lit("")
    else:
        time = F.concat_ws(":", at(9, 2), at(11, 2), at(13, 2) if "ss" in CODES[code] else F.lit("00"))
        rest = F.trim(F.substring(s, F.lit(9 + (6 if "ss" in CODES[code] else 4)), F.length(s)))
    named = F.coalesce(*[F.when(rest == k, v) for k, v in ZONES.items()])
    zone = F.when(rest == "", "").when(rest.rlike(r"^[+-]0000$"), "Z").when(rest.rlike(r"^[+-]\d{4}$"), F.concat(F.left(rest, F.lit(3)), F.lit(":"), F.right(rest, F.lit(2)))).otherwise(named)
    return F.concat(date, F.lit("T"), time, zone)
