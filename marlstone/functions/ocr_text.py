"""Visible text line by line: which lines can be read, which are place labels, routes, questions and their answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a map's own interface, kinds of questions with their words, weights of image regions.
INTERFACE = ("google maps", "maps", "route", "directions", "screenshot", "image")
QUESTIONS = (
    ("city_state", ("city-state", "city state", "city and state")),
    ("coordinates", ("coordinate", "gps", "lat", "long", "latitude", "longitude", "exact location")),
    ("landmark", ("landmark", "temple", "bridge", "tower", "museum", "building", "monument", "poi")),
    ("city", ("city", "town")),
    ("country", ("country", "nation", "region")),
    ("date", ("date", "timestamp", "published", "when")),
    ("map_app", ("map app", "platform", "which app", "google maps")),
    ("route", ("route", "start", "end", "from", "to", "bypass")),
)
REGIONS = {"map_search_bar": 92, "map_bottom_sheet": 88, "top": 74, "bottom": 72, "left": 66, "right": 58, "center": 54, "full": 42}
_NAME = r"[A-Za-z\x{0600}-\x{06ff}][A-Za-z0-9\x{0600}-\x{06ff}'’ .-]{2,60}?"
ROUTES = (rf"(?i)\bfrom\s+({_NAME})\s+(?:to|→|->)\s+({_NAME})(?:$|,|\||•)", rf"(?i)^({_NAME})\s+(?:to|→|->)\s+({_NAME})(?:$|,|\||•)")


def clean(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", ""))


def readable(line: Column) -> Column:
    """Whether a recognised line holds text: enough letters and digits, and not one letter among marks."""
    t = clean(line)
    n, letters, digits = F.length(t), _count(t, r"\p{L}"), _count(t, r"\p{Nd}")
    enough = letters + digits + _count(t, " ") >= F.greatest(F.lit(3), F.floor(n * 0.35))
    return (n >= 3) & enough & t.rlike(r"[\p{L}\p{N}]") & ~((n <= 4) & (letters <= 1) & (digits == 0))


def readable_string(text: Column) -> Column:
    """Whether a run of bytes is text that a person wrote: addresses and key words, or word shapes with few marks."""
    t = clean(text)
    low, n = F.lower(t), F.length(t)
    letters, digits, spaces = _count(t, r"\p{L}"), _count(t, r"\p{Nd}"), _count(t, " ")
    marks = n - letters - digits - spaces
    shaped = t.rlike(r"[aeiou]|[A-Z][a-z]{2,}|[a-z]{4,}")
    heads = low.rlike(r"^(jfif|exif|ihdr|idat|iend|photoshop 3\.0)")
    telling = low.rlike(r"http://|https://|www\.|\.com|maps|token|secret|password|script")
    plain = ((letters + digits + spaces) / n >= 0.76) & (marks / n <= 0.24) & (shaped | ~t.rlike(r"(.)\1{4,}")) & (marks <= F.greatest(F.lit(8.0), n * 0.22)) & ((letters / n >= 0.38) | shaped) & (shaped | (spaces > 0))
    return F.when((n < 8) | heads, False).otherwise(telling | plain)


def good_label(label: Column) -> Column:
    """Whether a text may name a place: three characters or more, a letter, and no word of a map's interface."""
    t = F.regexp_replace(clean(label), r"^[ \-:|•·]+|[ \-:|•·]+$", "")
    return (F.length(t) >= 3) & t.rlike(r"\p{L}") & ~F.lower(t).isin(*INTERFACE)


def ocr_score(lines: Column, zones: Column, signals: Column) -> Column:
    """Confidence of recognised text from its lines, the zones it was found in and the signals in it."""
    return F.least(F.lit(95), F.least(F.lit(92), 28 + 4 * lines + 6 * zones) + F.least(F.lit(18), 3 * signals)).cast("int")


def route(lines: Column) -> Column:
    """struct<start, finish> of the shortest line that says from where to where, null if none does."""
    def ends(line: Column) -> Column:
        out = F.lit(None).cast("struct<start:string,finish:string>")
        for pattern in reversed(ROUTES):
            a, b = (F.trim(F.regexp_extract(line, pattern, k)) for k in (1, 2))
            a = F.regexp_replace(a, r"(?i)^from\s+", "")
            fits = (a != "") & good_label(a) & good_label(b) & (F.lower(a) != F.lower(b))
            out = F.when(fits, F.struct(a.alias("start"), b.alias("finish"))).otherwise(out)
        return out

    ordered = F.array_sort(F.transform(F.filter(F.transform(lines, clean), lambda x: x != ""), lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))))
    return F.get(F.filter(F.transform(ordered, lambda x: ends(x["line"])), lambda x: x.isNotNull()), F.lit(0))


def question_kind(question: Column) -> Column:
    """What a question asks for, by the first kind with one of its words."""
    low, out = F.lower(F.coalesce(question, F.lit(""))), None
    for kind, words in QUESTIONS:
        holds = low.contains(words[0])
        for w in words[1:]:
            holds = holds | low.contains(w)
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out.otherwise("generic")


def flag_format(question: Column) -> Column:
    """The form that a question wants its answer in; empty if it names none."""
    raw = clean(question)
    named = F.trim(F.regexp_extract(raw, r"(?i)(?:flag\s*format|format)\s*[:\-]?\s*([A-Za-z0-9_{}:.,/\\|<>\-\s]+)", 1))
    return F.when(named != "", named).otherwise(F.regexp_extract(raw, r"\b[A-Za-z0-9_]+\{[^}]+\}", 0))


def flag_answer(answer: Column, form: Column) -> Column:
    """An answer in the wanted form: inside braces, commas and spaces become hyphens."""
    t = F.trim(F.coalesce(answer, F.lit("")))
    inner = F.replace(F.replace(F.replace(t, F.lit(", "), F.lit("-")), F.lit(","), F.lit("-")), F.lit(" "), F.lit("-"))
    braced = F.concat(F.substring_index(form, "{", 1), F.lit("{"), inner, F.lit("}"))
    none = F.lower(t).isin("", "unknown", "unavailable", "none", "n/a")
    return F.when(none, "No stable answer yet").when(form.rlike(r"\{[^}]+\}"), braced).otherwise(t)


def region_weight(region: Column) -> Column:
    out = None
    for name, weight in REGIONS.items():
        out = F.when(region == name, weight) if out is None else out.when(region == name, weight)
    return out.otherwise(40)


def rank_label(label: Column) -> Column:
    """struct<place, score, category> of a label 'place — score% — category'."""
    parts = F.transform(F.split(F.coalesce(label, F.lit("")), "—"), lambda x: F.trim(x))
    score = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "%", "").try_cast("int")
    return F.struct(F.get(parts, F.lit(0)).alias("place"), F.coalesce(score, F.lit(0)).alias("score"), F.coalesce(F.get(parts, F.lit(2)), F.lit("candidate")).alias("category"))


def region_hint(profile: Column) -> Column:
    low = F.lower(F.coalesce(profile, F.lit("")))
    return F.when(low.contains("egypt"), "Egypt").when(low.rlike("gulf|middle east"), "Middle East").when(low.contains("united kingdom"), "UK").when(low.contains("united states"), "USA").otherwise("Google Maps")


def file_name_hints(name: Column, aliases: list[str]) -> Column:
    """Aliases that stand as words in a file name; hints only, never evidence of a place."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.array_compact(F.array(*(F.when(words.contains(f" {a.lower()} "), F.lit(a)) for a in aliases)))
