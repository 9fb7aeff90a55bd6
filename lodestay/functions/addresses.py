"""What kind of address a text is, and the precision of the source of its point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of addresses, sources of points and how exact they are.
STREET_WORDS = ["רחוב", "רח'", "רח׳", "שדרות", "שד'", "שד׳", "דרך", "סמטת", "סמטה", "שביל", "רחבת", "כיכר", "משעול"]
NEAR = r"ליד|קרוב\s+ל|בסמוך|קרבת|צמוד\s+ל|מול\s+שער|במרחק"
_INSTITUTION = (
    r"אוניברסיט\S*(?:\s+בן\s+גוריון)?|בן\s+גוריון\s+אוניברסיט\S*"
    r"|סורוקה|בית\s+חולים|ביה[\"״']?ח|הקריה\s+הרפואית|קמפוס|שער\s+האוניברסיטה"
)
#: The city's name; floors, entrances and asides behind an address; numbers and quarters; words for a road.
CITY = "(?iu)באר\\s*שבע|ב['\"׳״]ש(?![\\p{L}\\p{N}_])|beer\\s*sheva"
TAIL = r"\([^)]*\)|(?<![\p{L}\p{N}_])קומ[הת]\s*\S*|(?<![\p{L}\p{N}_])כניס[הת]\s*\S*|(?<![\p{L}\p{N}_])דיר[הת]\s+[0-9]+|(?<![\p{L}\p{N}_])מעל\s+\S+"
NUMBERS = r"\d+(?:/\d+)?|שכונ[הת]\s*[א-י]?['׳]?"
ROADS = "רחוב|רח['׳]|שדרות|שדרה|שד['׳]|דרך|סמטת|סמטה|שביל|רחבת|רחבה|כיכר|משעול"
_QUARTER_PHRASE = "שכונ[הת]\\s*[א-ת]['׳\"״]?"
PRECISE_SOURCES = ["static", "google", "osm_addr", "interpolated", "manual"]
CONFIDENCE = {
    "manual": "exact", "static": "exact", "google": "exact", "osm_addr": "exact", "interpolated": "high", "extrapolated": "high",
    "projected": "street", "static_area": "area", "street_geom": "street", "anchor_neighbour": "street", "overpass": "street", "nominatim": "street",
}


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def precise(address: Column) -> Column:
    """Whether an address has a number or a word for a street."""
    return _yes(F.regexp_like(address, F.lit("[0-9]")) | F.exists(F.array(*map(F.lit, STREET_WORDS)), lambda w: F.contains(address, w)))


def bare_quarter(address: Column) -> Column:
    """Whether an address is a whole quarter without a street."""
    return _yes(F.contains(address, F.lit("שכונה")) | F.contains(address, F.lit("שכונת"))) & ~precise(address)


def bare_street(address: Column) -> Column:
    """Whether an address is a street or an area without a number."""
    return _yes((F.length(address) > 0) & ~F.regexp_like(address, F.lit("[0-9]"))) & ~bare_quarter(address)


def vague(address: Column) -> Column:
    """Whether an address names neither a quarter nor a street by a word for one nor a number behind letters: nothing can be pinned."""
    street = F.exists(F.array(*map(F.lit, STREET_WORDS)), lambda w: F.contains(address, w))
    return _yes(~bare_quarter(address) & ~street & ~F.regexp_like(address, F.lit(r"[א-ת]\s*\d")))


def only_quarter(address: Column) -> Column:
    """Whether nothing is left of an address when the names of quarters are taken away."""
    left = F.regexp_replace(F.regexp_replace(address, _QUARTER_PHRASE, " "), "^[\\s,\\-–'\"׳״־]+|[\\s,\\-–'\"׳״־]+$", "")
    return _yes(F.regexp_like(address, F.lit(_QUARTER_PHRASE)) & (left == ""))


def only_bearing(address: Column, names_street: Column | None = None) -> Column:
    """Whether an address is only near something, or an institution: no number and, where that is known, no street."""
    said = F.regexp_like(address, F.lit(f"{NEAR}|{_INSTITUTION}"))
    numbered = F.regexp_like(address, F.lit(r"(?<![\p{L}\p{N}_])[0-9]{1,4}(?![\p{L}\p{N}_])"))
    return _yes(said & ~numbered) & (~_yes(names_street) if names_street is not None else F.lit(True))


def street_core(address: Column) -> Column:
    """What of an address may be the name of a street: without the city, floors, numbers, quarters and words for a road."""
    bare = address
    for pattern in (CITY, TAIL, f"{NUMBERS}|{ROADS}"):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.trim(F.regexp_replace(F.translate(bare, '"\\/,', ""), r"\s+", " "))


def with_number_of(address: Column, text: Column) -> Column:
    """An address without a number, with the one that follows its street's name in the text; any other address as it is.

    The name is sought as it stands, so the pattern is another one in each row: the name, white space, one to four digits that
    end there. Of several places the first counts. Quarters, and names of fewer than three letters, stay without a number.
    """
    core = street_core(address)
    pattern = F.concat(F.lit(r"\Q"), core, F.lit(r"\E\s+(\d{1,4})(?![\p{L}\p{N}_])"))
    number = F.get(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(0))
    open_ = ~F.regexp_like(address, F.lit(r"\d")) & ~bare_quarter(address) & (F.length(core) >= 3)
    return F.coalesce(F.when(open_, F.concat(address, F.lit(" "), number)), address)


def confidence(source: Column) -> Column:
    """exact, high, street, area or none; an unknown source is street."""
    grades = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return F.when(F.coalesce(source, F.lit("")) == "", "none").otherwise(F.coalesce(F.try_element_at(grades, source), F.lit("street")))


def precise_source(source: Column) -> Column:
    return _yes(source.isin(*PRECISE_SOURCES))


def located(source: Column) -> Column:
    """Whether a source knows the street at least."""
    return confidence(source).isin("exact", "high", "street")


def approximate(source: Column) -> Column:
    return confidence(source).isin("street", "area", "none")
