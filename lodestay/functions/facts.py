"""Facts of a rental post recovered from its text: prices, rooms, dates, phones, floors, claims and addresses.

All are column expressions. Null and empty texts give null or false, as each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestay.functions import addresses

# Words and patterns of the posts' language.
PRICE_MARKERS = ["₪", 'ש"ח', "ש״ח", "שח", 'שכ"ד', "שכ״ד", "שכד", "לחודש", "מחיר"]
NUMERALS = {"שני": 2, "שתי": 2, "שניים": 2, "שתיים": 2, "שלושה": 3, "שלוש": 3, "ארבעה": 4, "ארבע": 4}
MONTHS = ["ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"]
FLOORS = {
    "קרקע": 0, "כניסה": 0, "ראשונה": 1, "שניה": 2, "שנייה": 2, "שלישית": 3, "רביעית": 4,
    "חמישית": 5, "שישית": 6, "שביעית": 7, "שמינית": 8, "תשיעית": 9, "עשירית": 10,
}
KEYWORDS = [
    "דירה", "דירת", "שותף", "שותפה", "שותפים", "שותפות", "חדר", "חדרים", "להשכרה", "השכרה", "שכירות", "מפנים",
    "מתפנה", "מתפנים", "מושכר", 'שכ"ד', "שכ״ד", "שכד", "סאבלט", "סבלט", "כניסה",
]
_NUMERAL = "|".join(NUMERALS)
_FREEING = rf"מתפנ(?:ים|ות)\s*([0-9]+|{_NUMERAL})?\s*חדרים"
_SEEKING = rf"מחפש(?:ים|ות|ת)?\s*([0-9]+|{_NUMERAL})?\s*שותפ"
_ONE_ROOM = "מפנה חדר|חדר פנוי|מתפנה חדר|יחידת דיור"
_WHOLE_FLAT = r"דיר[הת]\s*(?:בת\s*)?([0-9]+(?:\.[0-9]+)?)\s*חדרים"
_PER_PERSON = "לשותף|לכל שותף|לאדם|לנפש|לחדר|לבנאדם|לבן אדם"
_IMMEDIATE, _FLEXIBLE = r"מיידית|מידית|מייד|מיד(?![\p{L}\p{N}_])|עכשיו|היום", "גמיש"
_FEMALE = r"שותפה(?![\p{L}\p{N}_])|שותפות(?![\p{L}\p{N}_])|בנות בלבד|לבנות(?![\p{L}\p{N}_])|שותפ' ?בלבד|בחורה(?![\p{L}\p{N}_])"
_WALK_CLAIM = r"([0-9]{1,2})\s*(?:-\s*([0-9]{1,2}))?\s*דק(?:ות|׳|')?\s*הליכה"
_QUARTER = r"שכונ[הת]?\s+([א-י])(?![א-ת])"
_CORNER = r"\s*\(?\s*(?<![\p{L}\p{N}_])פינ(?:ת|ה)(?![\p{L}\p{N}_])[^,/|()]*\)?"

#: No letter or digit before and after: a word's or a number's own edges.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_DATE = _BEFORE + r"([0-9]{1,2})[-./]([0-9]{1,2})"
#: Most a room may cost; bounds of a believable price of one.
MAX_PRICE, PRICE_LOW, PRICE_HIGH = 2000, 500, 3000


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, or null if nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def windows(text: Column, marker: str, reach: int) -> Column:
    """Around each occurrence of ``marker`` the text from ``reach`` characters before it to as many after it."""
    parts = F.split(text, rf"\Q{marker}\E", -1)

    def around(j: Column) -> Column:
        first = F.greatest(F.lit(1), j - reach)
        before = F.array_join(F.slice(parts, first, j - first + 1), marker)
        after = F.array_join(F.slice(parts, j + 1, F.lit(reach + 1)), marker)
        return F.concat(F.substring(before, -reach, reach), F.lit(marker), F.substring(after, 1, reach))

    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), around))


def price_near_markers(text: Column, markers: list[str] = PRICE_MARKERS, reach: int = 20, low: int = PRICE_LOW, high: int = PRICE_HIGH) -> Column:
    """First number of three or four digits in [low, high] within ``reach`` characters of a marker; earlier markers win."""
    joined = F.regexp_replace(text, r"([0-9])[.,]([0-9]{3})", "$1$2")

    def near(marker: str) -> Column:
        numbers = F.flatten(F.transform(windows(joined, marker, reach), lambda w: F.regexp_extract_all(w, F.lit(rf"{_BEFORE}[0-9]{{3,4}}{_AFTER}"), F.lit(0))))
        return F.get(F.filter(F.transform(numbers, lambda n: n.cast("int")), lambda n: n.between(low, high)), F.lit(0))

    return F.coalesce(*(near(m) for m in markers))


def numeral(token: Column) -> Column:
    """A number in digits or as a word; null for anything else."""
    words = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.coalesce(F.try_element_at(words, token), token.try_cast("int"))


def whole_flat_rooms(text: Column) -> Column:
    """Rooms of "a flat of N rooms", fractions cut off."""
    return found(text, _WHOLE_FLAT, 1).cast("double").cast("int")


def rooms_from_text(text: Column) -> Column:
    """Free rooms that a text speaks of: rooms that fall free, flatmates sought, one room, else a whole flat less its salon."""
    said = lambda pattern: F.when(F.regexp_like(text, F.lit(pattern)), F.coalesce(F.nullif(numeral(found(text, pattern, 1)), F.lit(0)), F.lit(1)))
    whole = whole_flat_rooms(text)
    return F.coalesce(said(_FREEING), said(_SEEKING), F.when(F.regexp_like(text, F.lit(_ONE_ROOM)), 1), F.when(whole.between(1, 10), whole - 1))


def divided_price(price: Column, mates: Column, rooms: Column, text: Column, most: int = MAX_PRICE) -> Column:
    """The share of a whole flat's price, or null where it is none.

    Only a price above ``most`` is divided, and only if the text names no price per person, a number of residents is
    known (flatmates, else rooms of the whole flat less one, else free rooms; two at least) and the share is within ``most``.
    """
    whole = whole_flat_rooms(text)
    two = lambda n: F.when(n >= 2, n)
    share = F.coalesce(two(mates), two(F.when(whole.between(2, 10), whole - 1)), two(rooms))
    derived = F.bround(price / share).cast("int")
    per_person = F.coalesce(F.regexp_like(text, F.lit(_PER_PERSON)), F.lit(False))
    return F.when((price > most) & ~per_person & (derived <= most), derived)


def entry_date(text: Column) -> Column:
    """``DD.MM`` of all dates, then of month names (the first of the month without a day), then flexible and immediate.

    Distinct, comma-separated; a text without any of these is trimmed, and null if nothing is left.
    """
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    dates = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))
    parts = F.transform(dates, lambda d: F.transform(F.split(d, "[-./]"), lambda n: n.cast("int")))
    fits = F.filter(parts, lambda p: p[0].between(1, 31) & p[1].between(1, 12))
    written = F.transform(fits, lambda p: F.concat(two(p[0]), F.lit("."), two(p[1])))

    def named(number: int, name: str) -> Column:
        at = F.instr(text, name)
        before = F.substring(text, F.greatest(at - 6, F.lit(1)), F.least(at - 1, F.lit(6)))
        day = found(before, r"([0-9]{1,2})\s*ב?ל?\s*$", 1).cast("int")
        return F.when(at > 0, F.concat(two(F.when(day.between(1, 31), day).otherwise(1)), F.lit(f".{number:02d}")))

    words = [F.when(F.regexp_like(text, F.lit(p)), F.lit(w)) for p, w in ((_FLEXIBLE, "גמיש"), (_IMMEDIATE, "מיידי"))]
    others = F.filter(F.array(*(named(i, m) for i, m in enumerate(MONTHS, 1)), *words), lambda x: x.isNotNull())
    everything = F.array_distinct(F.concat(written, others))
    return F.when(F.size(everything) > 0, F.array_join(everything, ", ")).otherwise(F.nullif(F.trim(text), F.lit("")))


def phones(contact: Column) -> Column:
    """Mobile numbers as ``05X-XXXXXXX``, distinct, comma-separated; a contact without any stays as it is."""
    chunks = F.regexp_extract_all(contact, F.lit(r"(?:\+?972|0)[0-9\s().\-]{8,}"), F.lit(0))
    digits = F.transform(chunks, lambda c: F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^972", "0"))
    mobile = F.filter(digits, lambda d: (F.length(d) == 10) & d.startswith("05"))
    shown = F.array_distinct(F.transform(mobile, lambda d: F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 7))))
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(contact)


def contact_numbers(contact: Column) -> Column:
    """The last nine digits of every number of a contact, sorted; runs of 18 digits and more are several numbers."""
    runs = F.transform(F.regexp_extract_all(contact, F.lit(r"[0-9][0-9\-\s]{6,}[0-9]"), F.lit(0)), lambda r: F.regexp_replace(r, "[^0-9]", ""))
    several = lambda d: F.transform(F.sequence(F.lit(0), F.floor(F.length(d) / 9).cast("int") - 1), lambda i: F.substring(d, 9 * i + 1, F.lit(9)))
    parts = F.flatten(F.transform(runs, lambda d: F.when(F.length(d) >= 18, several(d)).otherwise(F.array(F.substring(d, -9, 9)))))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 9))), F.array().cast("array<string>"))


def floor_number(floor: Column) -> Column:
    """The first number of a floor, else that of the first ordinal word."""
    words = [F.when(F.contains(floor, F.lit(w)), n) for w, n in FLOORS.items()]
    return F.coalesce(found(floor, "[0-9]+").try_cast("int"), *words)


def month_of(text: Column, names: list[str] = MONTHS) -> Column:
    """Month of the first ``D.M``, else of the first name in ``names`` that occurs; an impossible ``D.M`` is null at once."""
    number = found(text, _DATE, 2).cast("int")
    named = F.coalesce(*(F.when(F.contains(text, F.lit(n)), i) for i, n in enumerate(names, 1)))
    return F.when(number.isNotNull(), F.when(number.between(1, 12), number)).otherwise(named)


def clean_address(address: Column) -> Column:
    """Trimmed of marks; Latin letters go from an address without a number if letters of its own script are left."""
    flat = F.trim(F.regexp_replace(F.replace(address, F.lit("__"), F.lit(" ")), r"\s{2,}", " "))
    edges = lambda c: F.regexp_replace(c, "^[ \\-,/'\"]+|[ \\-,/'\"]+$", "")
    bare = edges(F.trim(F.regexp_replace(F.regexp_replace(flat, "[A-Za-z]+", ""), r"\s{2,}", " ")))
    strip = ~F.regexp_like(flat, F.lit("[0-9]")) & F.regexp_like(bare, F.lit("[א-ת]"))
    return F.when(strip, bare).otherwise(F.nullif(edges(flat), F.lit("")))


def house_number(address: Column) -> Column:
    """The first number of one to four digits that stands alone."""
    return found(address, rf"{_BEFORE}([0-9]{{1,4}}){_AFTER}", 1)


def without_corner(address: Column) -> Column:
    """An address without the clause that names a cross street."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(address, _CORNER, " "), r"\s+", " ")), r"^[,\s]+|[,\s]+$", "")


def quarter_letter(address: Column) -> Column:
    """The letter of the quarter that an address names."""
    return found(F.translate(address, "״׳'`\"", ""), _QUARTER, 1)


def seeks_women(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(_FEMALE)), F.lit(False))


def claimed_walk(text: Column) -> Column:
    """Minutes of walk that a text claims, the upper end of a range."""
    return F.coalesce(found(text, _WALK_CLAIM, 2), found(text, _WALK_CLAIM, 1)).cast("int")


def walk_conflict(text: Column, minutes: Column) -> Column:
    """Whether a known walk takes more than twice what the text claims, and more than eight minutes more."""
    claim = claimed_walk(text)
    return F.coalesce((claim > 0) & (minutes > 2 * claim) & (minutes - claim > 8), F.lit(False))


def has_keyword(text: Column, words: list[str] = KEYWORDS) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(False))


def is_picture(text: Column, images: Column, least: int = 40) -> Column:
    """Whether a post is a picture of its text: it has images and next to no words."""
    return (F.coalesce(F.size(images), F.lit(0)) > 0) & (F.length(F.trim(F.coalesce(text, F.lit("")))) < least)


def postprocess(posts: DataFrame) -> DataFrame:
    """``posts`` (text, comments, price, rooms, mates, address, lease, contact) with its facts mended, in one fixed order.

    Adds price_from_comment and price_is_derived. A price is recovered from text and comments where it is missing, then
    rooms, then the share of a whole flat's price; address, lease and contact take their one form. Doing it twice changes nothing.
    """
    c = F.col
    both = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("comments", F.lit("")))
    step = posts.withColumn("_near", F.when(c("price").isNull(), price_near_markers(both)))
    step = step.withColumns({"price": F.coalesce("price", "_near"), "price_from_comment": c("_near").isNotNull()})
    step = step.withColumn("rooms", F.coalesce("rooms", rooms_from_text(c("text"))))
    step = step.withColumn("_share", divided_price(c("price"), c("mates"), c("rooms"), c("text")))
    step = step.withColumns({"price": F.coalesce("_share", "price"), "price_is_derived": c("_share").isNotNull()})
    done = {"address": addresses.with_number_of(clean_address(c("address")), c("text")), "lease": entry_date(c("lease")), "contact": phones(c("contact"))}
    return step.withColumns(done).drop("_near", "_share")
