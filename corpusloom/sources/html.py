"""Visible words of HTML, by column expressions."""

from __future__ import annotations

import html as entities
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: elements that end a line, and those whose text isn't shown
BLOCKS = "p div br tr li h1 h2 h3 h4 h5 h6 blockquote table ul ol hr".split()
SILENT = "script style head title".split()

#: what stands in a tag after its name: values in quotes may hold >
_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_NOTES = r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*(?:>|\z)"
_UNSEEN = "|".join(rf"<{tag}(?=[\s/>]){_REST}>.*?(?:</{tag}\s*>|\z)" for tag in SILENT)
_LINE_ENDS = rf"(?i)</?(?:{'|'.join(BLOCKS)})(?=[\s/>]){_REST}>"
_TAGS = rf"</?[a-zA-Z]{_REST}>"
#: names of characters that need no semicolon, the longest first
_SHORT = "|".join(sorted((name for name in html5 if name[-1] != ";"), key=lambda name: (-len(name), name)))


def _character(number: Column) -> Column:
    """The character of a code point; those that HTML reads as Windows-1252 are read so, those that are none become U+FFFD."""
    windows = F.create_map(*(F.lit(x) for n in range(0x80, 0xA0) for x in (n, bytes([n]).decode("cp1252", "replace"))))
    none = (number <= 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    point = F.when(none, 0xFFFD).otherwise(number)
    return F.coalesce(windows[number.cast("int")], F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def unescaped(text: Column) -> Column:
    """The text with its character references resolved: decimal, hexadecimal and by name."""
    names = F.create_map(*(F.lit(x) for name, value in sorted(html5.items()) for x in (name, value)))

    def one(piece: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(piece, r"^#(\d{1,9});?", 1), F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]{1,7});?", 1)
        whole, short = F.regexp_extract(piece, r"^[A-Za-z0-9]{1,32};", 0), F.regexp_extract(piece, f"^(?:{_SHORT})", 0)
        rest = lambda pattern: F.regexp_replace(piece, pattern, "")
        return (
            F.when(decimal != "", F.concat(_character(decimal.cast("long")), rest(r"^#\d{1,9};?")))
            .when(hexadecimal != "", F.concat(_character(F.conv(hexadecimal, 16, 10).cast("long")), rest(r"^#[xX][0-9a-fA-F]{1,7};?")))
            .when((whole != "") & names[whole].isNotNull(), F.concat(names[whole], rest(r"^[A-Za-z0-9]{1,32};")))
            .when(short != "", F.concat(names[short], rest(f"^(?:{_SHORT})")))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    found = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, 1 << 30), one), ""))
    return F.when(text.contains("&"), found).otherwise(text)


def html_text(html: Column) -> Column:
    """Lines with single spaces, at most one blank line between; null for null."""
    shown = F.regexp_replace(F.regexp_replace(html, _NOTES, ""), f"(?is){_UNSEEN}", "")
    plain = unescaped(F.regexp_replace(F.regexp_replace(shown, _LINE_ENDS, "\n"), _TAGS, ""))
    lines = F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s&&[^\n]]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def visible_text(html: str | None) -> str | None:
    """``html_text`` of one string, for readers that have a text inside a container."""
    if html is None:
        return None
    for pattern, by in ((_NOTES, ""), (f"(?is){_UNSEEN}", ""), (_LINE_ENDS, "\n"), (_TAGS, "")):
        html = re.sub(pattern.replace(r"\z", r"\Z"), by, html)
    lines = re.sub(r" ?\n ?", "\n", re.sub(r"[^\S\n]+", " ", entities.unescape(html)))
    return re.sub(r"\n{3,}", "\n\n", lines).strip(" \n")
