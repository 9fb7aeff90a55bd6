"""Text normalisation, keys and recovery of facts from free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction marks and joiners that some editors leave in pasted text.
BIDI = "[‎‏‪-‮⁦-⁩﻿]"


def signature(text: Column) -> Column:
    """``text:`` and 16 hex digits of the SHA-1 of the first 150 characters, white space collapsed."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, BIDI, ""), r"\s+", " "))
    return F.concat(F.lit("text:"), F.substring(F.sha1(F.substring(flat, 1, 150).cast("binary")), 1, 16))


def tokens(text: Column, least: int = 3) -> Column:
    """Sorted distinct lower-case words of ``least`` letters or more, in any script."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def phone_key(contact: Column) -> Column:
    """``phone:`` and the last nine digits, if there are seven digits or more."""
    digits = F.regexp_replace(contact, "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.concat(F.lit("phone:"), F.right(digits, F.lit(9))))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags go, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


_NAMED = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def html_text(html: Column) -> Column:
    """Text of a message: scripts and styles go, ends of blocks are line breaks, common entities and numbers become characters."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?i)<br\s*/?>|</(?:p|div|tr|li|table|h[1-6])\s*>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    pieces = F.regexp_extract_all(bare, F.lit(r"(?s)&#x?[0-9a-fA-F]{1,6};|&|[^&]+"), F.lit(0))
    number = lambda p: F.coalesce(F.conv(F.nullif(F.regexp_extract(p, "(?i)^&#x([0-9a-f]+);$", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(p, "^&#([0-9]+);$", 1), F.lit(""))).cast("int")
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    decoded = F.array_join(F.transform(pieces, lambda p: F.when(number(p).between(1, 0x10FFFF), letter(number(p))).otherwise(p)), "")
    for name, mark in _NAMED.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(mark))
    decoded = F.regexp_replace(F.replace(decoded, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(decoded, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def blocks(text: Column, least: int = 40) -> Column:
    """Lines that have ``least`` characters or more."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda b: F.length(b) >= least)


def sections(text: Column, heading: str, chrome: str | None = None, least: int = 40) -> Column:
    """The advertisements of a message: cut before each ``heading`` if it has two or more, else at blank lines.

    Sections that match ``chrome`` or have fewer than ``least`` characters go.
    """
    seams = F.size(F.regexp_extract_all(text, F.lit(f"(?m){heading}"), F.lit(0)))
    parts = F.when(seams >= 2, F.split(text, f"(?m)(?={heading})")).otherwise(F.split(text, r"\n\s*\n"))
    good = lambda b: (F.length(b) >= least) & (~F.regexp_like(b, F.lit(chrome)) if chrome else F.lit(True))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), good)


def post_id(url: Column) -> Column:
    """The number of a post in its address."""
    pattern = r"/(?:posts|permalink)/([0-9]+)|[?&]story_fbid=([0-9]+)"
    return F.coalesce(*(F.nullif(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2)))


def clean_url(url: Column) -> Column:
    """An address without its query and its last slash."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")


def chat_link(contact: Column) -> Column:
    """A link to write to the first mobile number of a contact, or the link that it is."""
    digits = F.regexp_replace(F.regexp_extract(contact, r"0?5[0-9][\s\-]?[0-9]{3}[\s\-]?[0-9]{4}", 0), "[^0-9]", "")
    return F.when(F.startswith(contact, F.lit("http")), contact).when(digits != "", F.concat(F.lit("https://wa.me/972"), F.regexp_replace(digits, "^0", "")))


def story(text: Column, tails: list[str], chrome: str) -> Column:
    """A post's own text: cut at the first of ``tails``, without lines that match ``chrome``, counts and single characters."""
    cut = text
    for t in tails:
        cut = F.substring_index(cut, t, 1)
    lines = F.filter(F.transform(F.split(cut, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & ~F.regexp_like(x, F.lit(chrome)) & ~F.regexp_like(x, F.lit("^[0-9.,KM ]+$")))
    return F.array_join(lines, "\n")


#: The age that stands under the author of a post; an author's name is no longer than this.
STORY_AGE, AUTHOR = r"^[0-9]{1,2}\s*[smhdw]$", 40
#: A post has this many characters at least, and a letter of the posts' language.
LEAST_POST, LETTER = 40, "[\u0590-\u05ff]"


def first_story(text: Column) -> Column:
    """The lines of a text without blank ones, up to the author and age of a second post that was captured with it.

    Such a header is an age alone in its line, with a short line above it; the first two lines are the post's own.
    """
    lines = F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    places = F.when(F.size(lines) > 2, F.sequence(F.lit(2), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    header = lambda i: F.regexp_like(F.get(lines, i), F.lit(STORY_AGE)) & (F.length(F.get(lines, i - 1)) <= AUTHOR)
    first = F.get(F.filter(places, header), F.lit(0))
    return F.array_join(F.slice(lines, F.lit(1), F.coalesce(first - 1, F.size(lines))), "\n")


def holds_another_story(text: Column) -> Column:
    """Whether a text runs on into a second post."""
    lines = F.array_join(F.filter(F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return F.coalesce(first_story(text) != lines, F.lit(False))


def is_post(text: Column, images: Column) -> Column:
    """Whether something captured is a post: long enough and in the posts' language, or with a picture that may hold its text."""
    said = F.coalesce((F.length(text) >= LEAST_POST) & F.regexp_like(text, F.lit(LETTER)), F.lit(False))
    return said | (F.coalesce(F.size(images), F.lit(0)) > 0)


def core_token(name: Column, generic: list[str]) -> Column:
    """The longest word of a name that is not a generic one, of equal ones the first; null if all are."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: ~w.isin(*generic) & (w != ""))
    return F.get(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), F.lit(0))["w"]


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([_*\[\]()~`>#+\-=|{}.!\\])", r"\\$1")


def script_json(value: Column) -> Column:
    """JSON that can stand in a script element."""
    out = F.to_json(value)
    for mark, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def with_comments(text: Column, comments: Column, label: str = "\n\n") -> Column:
    """A post's text with its comments behind it, where it has any."""
    return F.concat_ws(label, text, F.nullif(comments, F.lit("")))


def pictures(urls: Column, sizes: Column, most: int = 6) -> Column:
    """The ``most`` largest distinct web addresses of pictures."""
    both = F.array_sort(F.transform(F.arrays_zip(urls.alias("u"), sizes.alias("s")), lambda x: F.struct((-F.coalesce(x["s"], F.lit(0))).alias("s"), x["u"].alias("u"))))
    web = F.filter(F.transform(both, lambda x: x["u"]), lambda u: F.coalesce(F.startswith(u, F.lit("http")), F.lit(False)))
    return F.slice(F.array_distinct(web), 1, most)


def every_index_once(indexes: Column, n: Column) -> Column:
    """Whether an answer has each of the numbers 0 to n - 1 exactly once."""
    return F.coalesce(F.array_sort(indexes) == F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), F.lit(False))
