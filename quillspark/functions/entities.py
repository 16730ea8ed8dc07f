"""Character references of HTML as an expression: the text is parted at its ampersands, what follows each is looked up."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that also count without their semicolon, longest first, so that the longest wins.
_SHORT = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_SHORT_NAME = f"^({'|'.join(_SHORT)})"
#: References that texts are full of: looked for first, as a map is searched from its front.
_COMMON = {n: html5[n] for n in ("amp;", "nbsp;", "quot;", "lt;", "gt;")}
_LAST, _UNKNOWN = 0x10FFFF, "\ufffd"


def _names(initial_lower: bool) -> Column:
    """The names with lower-case initials, or the others, as one literal map."""
    own = {n: c for n, c in html5.items() if n[0].islower() == initial_lower}
    return F.from_json(F.lit(json.dumps(own)), "map<string,string>")


def _named(name: Column) -> Column:
    """The characters of a name, null for one that there is not."""
    return F.when(name.rlike("^[a-z]"), F.try_element_at(_names(True), name)).otherwise(F.try_element_at(_names(False), name))


def _numbered(n: Column) -> Column:
    """The character of a number; null is one too large. Numbers 128 to 159 mean what Windows-1252 has there."""
    utf = lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")
    windows = bytes(range(128, 160)).decode("cp1252", "replace").replace(_UNKNOWN, "\0")
    at = F.substring(F.lit(windows), (n - 127).cast("int"), F.lit(1))
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(n.isNull() | (n == 0) | (n > _LAST) | n.between(0xD800, 0xDFFF), _UNKNOWN)
        .when(n.between(128, 159), F.when(at == "\0", utf(n)).otherwise(at))
        .when(control, "")
        .otherwise(utf(n))
    )


def _resolved(piece: Column, complete: bool) -> Column:
    """What follows an ampersand, with the reference that it begins with, if any, as its character."""
    end = ";" if complete else ""
    digits, hexes = F.regexp_extract(piece, f"^#0*([0-9]+){end}", 1), F.regexp_extract(piece, f"^#[xX]0*([0-9a-fA-F]+){end}", 1)
    number = F.when(hexes != "", F.when(F.length(hexes) <= 8, F.conv(hexes, 16, 10).cast("long"))).otherwise(F.when(F.length(digits) <= 10, F.nullif(digits, F.lit("")).cast("long")))
    name, short = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0), F.lit("") if complete else F.regexp_extract(piece, _SHORT_NAME, 1)
    plain = F
    for common, char in _COMMON.items():
        plain = plain.when(F.startswith(piece, F.lit(common)), F.concat(F.lit(char), F.substring(piece, len(common) + 1, 1 << 30)))
    return (
        plain.when((digits != "") | (hexes != ""), F.concat(_numbered(number), F.regexp_replace(piece, "^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")))
        .when((name != "") & _named(name).isNotNull(), F.concat(_named(name), F.substring(piece, F.length(name) + 1, F.length(piece))))
        .when(short != "", F.concat(F.coalesce(F.try_element_at(_names(True), short), F.try_element_at(_names(False), short)), F.substring(piece, F.length(short) + 1, F.length(piece))))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def unescaped(text: Column, complete: bool = False) -> Column:
    """Characters for all character references, named (with or without semicolon, as HTML has it), decimal and hexadecimal. Null stays null. complete: only for those that end in a semicolon, so what cutting a text left of a reference stays as it is."""
    for common, char in _COMMON.items():
        if char != "&":  # these leave no ampersand behind, so they can go first, in the whole text
            text = F.replace(text, F.lit("&" + common), F.lit(char))
    each = F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(_resolved(p, complete))), "")
    return F.when(~F.contains(text, F.lit("&")), text).when(text.rlike("&(?!amp;)[#A-Za-z]"), each).otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))
