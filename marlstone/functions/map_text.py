"""Coordinates and places in map addresses and in visible text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of coordinates with what they are called, their confidence and the provider that they imply, in order of precedence.
COORDINATES = (
    ("at", r"(?i)@\s*(-?\d{1,2}\.\d{4,})\s*,\s*(-?\d{1,3}\.\d{4,})", 92, None),
    ("query", r"(?i)(?:q|ll|center|query|destination|origin|daddr|saddr)\s*=\s*(-?\d{1,2}\.\d{4,})\s*(?:,|;|\+|\s)+\s*(-?\d{1,3}\.\d{4,})", 88, None),
    ("geo uri", r"(?i)\bgeo:\s*(-?\d{1,2}\.\d{4,})\s*,\s*(-?\d{1,3}\.\d{4,})", 90, "Geo URI"),
    ("marker", r"(?i)(?:mlat|lat)=\s*(-?\d{1,2}\.\d{4,}).{0,80}?(?:mlon|lon)=\s*(-?\d{1,3}\.\d{4,})", 88, "OpenStreetMap or other"),
    ("map hash", r"(?i)#map=\d+(?:\.\d+)?/(-?\d{1,2}\.\d{4,})/(-?\d{1,3}\.\d{4,})", 87, "OpenStreetMap or other"),
    ("pin", r"(?i)!3d(-?\d{1,2}\.\d{4,})!4d(-?\d{1,3}\.\d{4,})", 90, "Google Maps"),
    ("labelled", r"(?i)(?:lat(?:itude)?|خط العرض)\s*[:=]\s*(-?\d{1,2}\.\d{4,}).{0,80}?(?:lon(?:gitude)?|lng|خط الطول)\s*[:=]\s*(-?\d{1,3}\.\d{4,})", 84, "Visible labelled coordinate"),
)
PLAIN = r"\b(-?\d{1,2}\.\d{4,})\s*,\s*(-?\d{1,3}\.\d{4,})\b"
DMS = r"(?i)(\d{1,2})[°\s]+(\d{1,2})['′\s]+(\d{1,2}(?:\.\d+)?)?[\"″\s]*([NS])\s+(\d{1,3})[°\s]+(\d{1,2})['′\s]+(\d{1,2}(?:\.\d+)?)?[\"″\s]*([EW])"
PLUS_CODE = r"(?i)\b(?:[23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,3})\b"
URL = r"(?i)(?:https?://|www\.)[^\s<>'\"()]+"
PROVIDERS = ((r"google\.com/maps|maps\.app\.goo\.gl|goo\.gl/maps", "Google Maps"), (r"maps\.apple", "Apple Maps"), (r"openstreetmap\.org|osm\.org", "OpenStreetMap"), (r"^geo:", "Geo URI"))

_SIGNAL = "array<struct<kind:string,provider:string,lat:double,lon:double,place:string,confidence:int>>"


def decoded(text: Column) -> Column:
    """Percent escapes undone; a plus stays, and so does a text with broken escapes."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def provider(text: Column) -> Column:
    low, out = F.lower(text), None
    for pattern, name in PROVIDERS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, n + 1)]


def _signal(kind, name, lat, lon, place, confidence) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("provider"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), place.cast("string").alias("place"), F.lit(confidence).cast("int").alias("confidence"))


def dms_decimal(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    """Degrees, minutes and seconds (texts) as a number of seven places; south and west are negative."""
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("double"), F.lit(0.0))
    value = number(degrees) + number(minutes) / 60 + number(seconds) / 3600
    return F.round(F.when(F.upper(side).isin("S", "W"), -value).otherwise(value), 7)


def _of_candidate(text: Column) -> Column:
    """Signals of one address or text."""
    maker, none = provider(text), F.lit(None).cast("string")

    def pairs(kind: str, pattern: str, confidence: int, given: str | None) -> Column:
        name = F.coalesce(maker, F.lit("Map/coordinate text")) if given is None else F.coalesce(maker, F.lit("OpenStreetMap")) if given.startswith("OpenStreetMap") else F.lit(given)
        a, b = _groups(text, pattern, 2)
        return F.zip_with(a, b, lambda x, y: _signal(kind, name, x, y, none, confidence))

    d = _groups(text, DMS, 8)
    north = F.zip_with(F.arrays_zip(d[0].alias("a"), d[1].alias("b")), F.arrays_zip(d[2].alias("c"), d[3].alias("d")), lambda x, y: dms_decimal(x["a"], x["b"], y["c"], y["d"]))
    east = F.zip_with(F.arrays_zip(d[4].alias("a"), d[5].alias("b")), F.arrays_zip(d[6].alias("c"), d[7].alias("d")), lambda x, y: dms_decimal(x["a"], x["b"], y["c"], y["d"]))
    dms = F.zip_with(north, east, lambda x, y: _signal("dms", F.lit("DMS coordinate text"), x, y, none, 84))
    valid = lambda s: s["lat"].between(-90, 90) & s["lon"].between(-180, 180)
    precise = F.filter(F.concat(*(pairs(*c) for c in COORDINATES), dms), valid)
    a, b = _groups(text, PLAIN, 2)
    plain = F.filter(F.zip_with(a, b, lambda x, y: _signal("plain", F.coalesce(maker, F.lit("Visible coordinate text")), x, y, none, 86)), valid)
    coordinates = F.when(F.size(precise) > 0, precise).otherwise(plain)
    place = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?i)/place/([^/?#]+)", 1), "[+_]+", " ")), F.lit(""))
    wanted = maker.isNotNull() & (place.isNotNull() | (F.size(coordinates) == 0))
    address = F.when(wanted, F.array(_signal("provider", maker, none, none, place, 82))).otherwise(F.array().cast(_SIGNAL))
    address = F.transform(address, lambda s: F.struct(s["kind"].alias("kind"), s["provider"].alias("provider"), s["lat"].alias("lat"), s["lon"].alias("lon"), s["place"].alias("place"), F.when(s["place"].isNull(), 72).otherwise(82).alias("confidence")))
    codes = F.transform(F.regexp_extract_all(text, F.lit(PLUS_CODE), F.lit(0)), lambda x: _signal("plus code", F.lit("Plus Code"), none, none, x, 72))
    return F.concat(coordinates, address, codes)


def map_signals(text: Column, limit: int | None = None) -> Column:
    """array<struct<kind, provider, lat, lon, place, confidence>> of the addresses in a text, then of the text itself; first of equals.

    A plain pair counts only where its address or text has nothing more precise, and an address without
    coordinates or a place still names its provider.
    """
    whole = decoded(F.coalesce(text, F.lit("")))
    addresses = F.transform(F.regexp_extract_all(whole, F.lit(URL), F.lit(0)), lambda x: F.regexp_replace(x, r"[.,;\]]+$", ""))
    candidates = F.array_distinct(F.concat(addresses, F.array(whole)))
    out = F.array_distinct(F.flatten(F.transform(candidates, lambda x: _of_candidate(x))))
    return out if limit is None else F.slice(out, 1, limit)


def first_coordinate(signals: Column) -> Column:
    """struct of the first signal with coordinates, null if none has."""
    return F.get(F.filter(signals, lambda s: s["lat"].isNotNull()), F.lit(0))
