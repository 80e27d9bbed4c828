"""Text fields of landed pages -> typed values, with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The address grammar of the pages, their dates, and what HTML says of tags, attributes and character references.
TEAM_ID = r"/team/(\d+)"
TEAM_SLUG = r"/team/\d+/([^/]+)$"
MATCH_ID = r"/(\d+)/"
PAGE_DATE = r"(?<!\d)\d{4}[-/]\d{2}[-/]\d{2}(?!\d)"
SKIPPED = r"(?is)<!--.*?(?:--!?>|\z)|<(script|style|template|textarea|title|noscript)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
TAG = r"""<[A-Za-z/!?][^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
HREF = r"""(?is)^<(?:a|area)(?:\s++(?!href\s*+=)[^\s=>"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?+)*+\s++href\s*+=\s*+("[^"]++"|'[^']++'|[^\s"'>]++)"""
REFERENCE = r"&(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};?|(?:amp|lt|gt|quot|apos);)"
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def team_id(href: Column) -> Column:
    return _group(href, TEAM_ID).try_cast("bigint")


def team_slug(href: Column) -> Column:
    return _group(href, TEAM_SLUG)


def match_id(href: Column) -> Column:
    return _group(href, MATCH_ID).try_cast("bigint")


def path_part(path: Column, index: int) -> Column:
    """Piece of a '/'-separated path, counted from 0."""
    return F.get(F.split(path, "/"), F.lit(index))


def link_kind(href: Column) -> Column:
    return (
        F.when(href.rlike(r"^/team/\d+"), "team")
        .when(href.rlike(r"^/\d+/"), "match")
        .when(href.rlike(r"^/event/"), "event")
        .otherwise("other")
    )


def decoded(text: Column) -> Column:
    """Character references as characters; each is read once, so ``&amp;#47;`` is ``&#47;``."""
    refs, gaps = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), F.split(text, REFERENCE, -1)

    def character(ref: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(ref, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)
        code = F.when(ref.rlike("^&#[xX]"), hexadecimal).otherwise(F.regexp_extract(ref, r"^&#(\d+)", 1)).try_cast("int")
        # what is no character stays as it stands
        fits = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        told = F.when(ref.startswith("&#"), F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        for name, value in NAMED.items():
            told = told.when(ref == name, F.lit(value))
        return F.coalesce(told, ref)

    pieces = F.zip_with(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), refs, lambda gap, ref: F.concat(character(ref), gap))
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))).otherwise(text)


def href_of(tag: Column) -> Column:
    """The address of an ``a`` or ``area`` tag, with or without quotes; null for other tags."""
    def address(value: Column) -> Column:
        bare = F.when(value.startswith('"') | value.startswith("'"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.when(value != "", _once(F.trim(bare), decoded))

    return _once(F.regexp_extract(tag, HREF, 1), address)


#: Marks in a stream of tokens; no text holds them, as they are taken out of it first.
_DATE, _LINK = "\x01", "\x02"


def dated_hrefs(html: Column) -> Column:
    """(date, hrefs) of the stretches of a page: links behind a date mark have that date, those before the first one none.

    The page is one stream of tags and dates. Comments and the bodies of scripts and the like are skipped, dates in attributes
    are no marks, and neither are texts that only look like a date.
    """
    shown = F.regexp_replace(F.translate(html, _DATE + _LINK, ""), SKIPPED, " ")
    tokens = F.regexp_extract_all(shown, F.lit(f"{TAG}|{PAGE_DATE}"), F.lit(0))
    marks = F.transform(tokens, lambda t: F.when(t.startswith("<"), F.concat(F.lit(_LINK), href_of(t))).otherwise(F.concat(F.lit(_DATE), slash_date(t).cast("string"))))
    stretches = F.split(F.array_join(F.filter(marks, lambda m: m.isNotNull()), ""), _DATE, -1)
    parts = F.transform(stretches, lambda s: F.split(s, _LINK, -1))
    return F.transform(parts, lambda p: F.struct(p[0].try_cast("date").alias("date"), F.slice(p, F.lit(2), F.size(p) - 1).alias("hrefs")))


def links(html: Column) -> Column:
    """The addresses that a page links to."""
    return F.flatten(F.transform(dated_hrefs(html), lambda s: s["hrefs"]))


def stamp_date(text: Column) -> Column:
    """Date part of 'yyyy-MM-dd hh:mm:ss'."""
    return F.substring_index(F.trim(text), " ", 1).try_cast("date")


def slash_date(text: Column) -> Column:
    """Date of 'yyyy/MM/dd' text."""
    return F.replace(F.trim(text), F.lit("/"), F.lit("-")).try_cast("date")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def leading_int(text: Column) -> Column:
    """Digits at the start of the trimmed text, else 0."""
    return F.coalesce(_group(F.trim(text), r"^(\d+)").try_cast("int"), F.lit(0))


def digits_or_null(text: Column) -> Column:
    return _group(F.trim(text), r"^(\d+)$").try_cast("int")


def won_lost(text: Column) -> tuple[Column, Column]:
    """'7 (3)' -> 7, 3."""
    pattern = r"^\s*(\d+)\s*\(\s*(\d+)\s*\)\s*$"
    return _group(text, pattern).try_cast("int"), _group(text, pattern, 2).try_cast("int")


def score_pair(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, ":")
    return digits_or_null(F.get(parts, F.lit(0))), digits_or_null(F.get(parts, F.lit(1)))


def alternating_net(values: Column) -> Column:
    """Even places minus odd places over the first ten texts, up to the first that is no integer."""
    def net(numbers: Column) -> Column:
        bad = F.array_position(F.transform(numbers, lambda v: v.isNull()), F.lit(True))
        kept = _once(bad, lambda at: F.when(at > 0, F.slice(numbers, F.lit(1), (at - 1).cast("int"))).otherwise(numbers))
        signed = F.transform(kept, lambda v, i: F.when(i % 2 == 0, v).otherwise(-v))
        return F.aggregate(signed, F.lit(0), lambda acc, v: acc + v)

    return _once(F.transform(F.slice(values, 1, 10), lambda v: F.trim(v).try_cast("int")), net)


def history_net(wins: Column, losses: Column) -> Column:
    """Sum of games won minus sum of games lost; null when the page has no history block."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda acc, v: acc + F.trim(v).try_cast("int"))

    return total(wins) - total(losses)


def bad_history(wins: Column, losses: Column) -> Column:
    """Whether a history block holds a text that is no integer."""
    def bad(values: Column) -> Column:
        return F.coalesce(F.exists(values, lambda v: F.trim(v).try_cast("int").isNull()), F.lit(False))

    return bad(wins) | bad(losses)


def prices(texts: Column) -> Column:
    """'$182' -> 182.0 for each text."""
    return F.transform(texts, lambda t: t.substr(F.lit(2), F.length(t)).try_cast("double"))
