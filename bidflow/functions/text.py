"""Text columns: truthy fallbacks, stripping, bid titles, HTML and JSON payloads."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word between source and item in a bid title.
TITLE_WORD = "заявка"

# White space as str.strip() sees it, spelled out because the
# Unicode flag of the regex engine is several times slower.
_BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

# A character of a word in any script.
_WORD = r"[\p{L}\p{M}\p{N}_]"

# Named HTML entities as the standard lists them, without "&" and ";".
ENTITIES = {name.rstrip(";"): text for name, text in html5.items() if name.endswith(";")}
# Those that a text may also name without ";", the longest first.
BARE_ENTITIES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    """First column that is neither NULL nor '' (for text) nor 0 (given as ``nullif``)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def strip(c: Column) -> Column:
    """Remove every kind of white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"\A{_BLANK}", ""), rf"{_BLANK}\z", "")


def squeeze(c: Column) -> Column:
    """Collapse runs of white space (the no-break and thin blanks too) to one blank and trim.

    The short class matters: it is tried on every character of whole texts.
    """
    return F.trim(F.regexp_replace(c, "[\\s\\xa0\\u2000-\\u200a\\u202f]+", " "))


def bid_title(name: Column, code: Column, external_id: Column, raw_id: Column) -> Column:
    """``<name or code>: <word> <external id or raw id or nothing>``, stripped as a whole."""
    item = first_truthy(external_id, F.nullif(raw_id, F.lit(0)).cast("string"))
    return strip(F.concat(first_truthy(name, code), F.lit(f": {TITLE_WORD} "), item))


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def unescape(c: Column, bare: bool = False) -> Column:
    """Decode named, decimal and hexadecimal entities in one pass; what they give is not decoded again.

    The text is split at its entities once; unknown names and codes that are no
    characters stay as they are. ``bare`` decodes numbers, and the old names that
    may stand without one, without ";" too: right in texts, wrong in addresses.
    """
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    end = ";?" if bare else ";"
    old = "|" + "|".join(BARE_ENTITIES) if bare else ""
    entity = rf"&(?:#\d{{1,7}}{end}|#[xX][0-9a-fA-F]{{1,6}}{end}|[A-Za-z][A-Za-z0-9]{{1,31}};{old})"

    def char(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def decoded(found: Column) -> Column:
        body = F.rtrim(F.substring(found, 2, 40), F.lit(";"))
        hexadecimal = F.conv(F.regexp_extract(body, r"^#[xX](.*)$", 1), 16, 10).try_cast("bigint")
        decimal = F.regexp_extract(body, r"^#(\d+)$", 1).try_cast("bigint")
        return F.coalesce(
            F.when(body.rlike("^#[xX]"), char(hexadecimal)).when(body.startswith("#"), char(decimal)).otherwise(
                F.element_at(names, body)
            ),
            found,
        )

    def whole(text: Column) -> Column:
        between, found = F.split(text, entity, -1), F.regexp_extract_all(text, F.lit(f"({entity})"), F.lit(1))
        pairs = F.zip_with(between, found, lambda t, e: F.concat(t, F.coalesce(decoded(e), F.lit(""))))
        return F.when(text.contains("&"), F.array_join(pairs, "")).otherwise(text)

    return let(c, whole)


# Inside a tag a ">" in quotes after "=" does not end it. Runs without "=" are one step, so long tags are safe.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*(?:"[^"]*"|'[^']*')|=)*+"""
# Comments, scripts and styles, whichever begins first: their bodies may hold what looks like the others.
_HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\z)"


def html_title(html: Column) -> Column:
    """Text of the first ``<title>``; NULL when there is none."""
    found = F.regexp_extract(html, rf"(?is)<title\b{_ATTRIBUTES}>(.*?)</title\s*>", 1)
    return F.nullif(squeeze(unescape(found, bare=True)), F.lit(""))


def html_text(html: Column) -> Column:
    """Visible text of the body: no head, no tags, entities decoded, blanks collapsed."""
    shown = F.regexp_replace(html, _HIDDEN, " ")
    bare = F.regexp_replace(shown, rf"(?is)<head\b{_ATTRIBUTES}>.*?</head\s*>|<[a-z/!]{_ATTRIBUTES}>", " ")
    return squeeze(unescape(bare, bare=True))


def html_links(html: Column) -> Column:
    """Targets of all links (``href`` in double, single or no quotes) in order, duplicates kept."""
    shown = F.regexp_replace(html, _HIDDEN, " ")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)(<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)"), F.lit(1))

    def target(tag: Column) -> Column:
        value = F.regexp_extract(tag, r"(?is)[\s\"']href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        return F.when(tag.rlike(r"(?is)[\s\"']href\s*="), F.regexp_replace(value, r"^[\"']|[\"']$", ""))

    return F.transform(F.filter(F.transform(tags, target), lambda t: t.isNotNull()), lambda t: unescape(t))


def json_field(payload: Column, field: str) -> Column:
    """One field of a JSON payload as text; NULL on anything that is not JSON."""
    return F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "string")


def tokens(c: Column) -> Column:
    """Lower-case words (letters, digits, inner hyphens) of a text."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"{_WORD}+(?:-{_WORD}+)*"), F.lit(0))
