"""Scalar functions: coercion, logistic, predicates of pins, names, monograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import Name, col


def number(c: Name, kind: str) -> Column:
    """A field as a number: booleans 0 or 1, numeric text its number, empty text 0, other text 1, null 0."""
    x = col(c)
    if kind == "boolean":
        return F.coalesce(x.cast("double"), F.lit(0.0))
    if kind == "string":
        return F.when(x.isNull() | (F.trim(x) == ""), 0.0).otherwise(F.coalesce(x.try_cast("double"), F.lit(1.0)))
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def sigmoid(x: Name) -> Column:
    """1 / (1 + exp(-x)), clamped beyond 40 either side."""
    x = col(x)
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def logit(p: Name) -> Column:
    p = col(p)
    return F.when(p <= 0, -40.0).when(p >= 1, 40.0).otherwise(F.log(p / (1.0 - p)))


def half_up(x: Name) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(col(x) + 0.5)


#: Pin operators and how they compare; numbers only meet numbers in the ordered ones.
PIN_OPS = ("eq", "ne", "neq", "gt", "gte", "lt", "lte", "in", "exists", "withinCyclesOfAsOf")


def pin(op: str, actual: Name, expected=None, numeric: bool = True) -> Column:
    """Whether a pin holds; never null. numeric: whether the field is a number, without which ordered operators are false."""
    a, false = col(actual), F.lit(False)
    if op == "exists":
        return a.isNotNull() if expected is None or expected else a.isNull()
    if op == "in":
        return F.coalesce(a.isin(list(expected)), false)
    if op == "eq":
        return a.isNull() if expected is None else F.coalesce(a == F.lit(expected), false)
    if op in ("ne", "neq"):
        return ~pin("eq", a, expected)
    if op not in PIN_OPS:
        raise ValueError(f"unknown pin operator {op!r}; known: {', '.join(PIN_OPS)}")
    if not numeric or isinstance(expected, bool) or not isinstance(expected, int | float):
        return false
    ordered = {"gt": a > expected, "gte": a >= expected, "lt": a < expected, "lte": a <= expected, "withinCyclesOfAsOf": F.abs(a) <= expected}
    return F.coalesce(ordered[op], false)


def clean_name(c: Name) -> Column:
    """Trimmed, lower case, without trailing dots."""
    return F.regexp_replace(F.lower(F.trim(col(c))), r"\.+$", "")


def gender_of(name: Name, female: list[str], male: list[str]) -> Column:
    """By given name: the female list first, then the male; else Unknown."""
    n = F.lower(F.trim(col(name)))
    return F.when(n.isin([x.lower() for x in female]), "Female").when(n.isin([x.lower() for x in male]), "Male").otherwise("Unknown")


#: The words that don't count for a monogram's initials, and its letters where no word does.
STOP_WORDS = ("inc", "llc", "co", "corp", "ltd", "and", "&", "the", "of", "for")
NO_INITIALS = "MC"
PALETTE = ("#1b4965", "#5fa8d3", "#62b6cb", "#cae9ff", "#386641", "#6a994e", "#a7c957", "#bc4749")


def initials(name: Name) -> Column:
    """The first letters of the first three words that count; of two if there are two; a lone word's first two letters. Commas and dots are left out."""
    bare = F.trim(F.regexp_replace(F.coalesce(col(name).cast("string"), F.lit("")), "[,.]", ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(list(STOP_WORDS)))
    several = F.concat_ws("", F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1)))
    found = F.when(F.size(words) >= 2, several).when(F.size(words) == 1, F.substring(F.element_at(words, 1), 1, 2))
    return F.upper(F.coalesce(found, F.lit(NO_INITIALS)))


def image_uri(svg: Column) -> Column:
    """A drawing as a base64 data URI, in one line."""
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.translate(F.base64(F.encode(svg, "UTF-8")), "\r\n", ""))


def monogram(name: Name) -> Column:
    """A small SVG with the name's initials, its colour and shape by hash, as a base64 data URI."""
    from .rng import fnv

    h = fnv(F.coalesce(col(name).cast("string"), F.lit("")))
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (h % len(PALETTE) + 1).cast("int"))
    shape = F.element_at(F.array(F.lit('<circle cx="32" cy="32" r="32"'), F.lit('<rect width="64" height="64"'), F.lit('<rect width="64" height="64" rx="12"')), (F.shiftright(h, 8) % 3 + 1).cast("int"))
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 64 64">'), shape, F.lit(' fill="'), colour, F.lit('"/><text x="32" y="40" text-anchor="middle" font-size="24" fill="#fff">'), initials(name), F.lit("</text></svg>"))
    return image_uri(svg)


#: Rows and columns of a glyph's left half with its middle; the right half mirrors the left.
GLYPH_ROWS, GLYPH_HALF = 5, 3


def glyph(seed: Name, ground: str | None = None) -> Column:
    """A drawing of a seed's own that needs no service, as a base64 data URI: five rows of squares, mirrored, in a colour, on a pale ground.

    All comes from the seed's MD5: a digit says whether a square is filled (15
    digits), six are the colour, three the ground where none is given. Equal
    seeds, up to case and blanks around them, have equal drawings; of 100,000
    seeds two are drawn alike once in some 400,000 sets. A null seed counts as empty.
    """
    digits = F.md5(F.lower(F.trim(F.coalesce(col(seed).cast("string"), F.lit("")))))
    squares = []
    for k in range(GLYPH_ROWS * GLYPH_HALF):
        row, x = divmod(k, GLYPH_HALF)
        mirrored = "" if x == GLYPH_HALF - 1 else f"M{2 * GLYPH_HALF - 2 - x} {row}h1v1h-1z"
        squares.append(F.when(F.substring(digits, k + 1, 1) >= "8", F.lit(f"M{x} {row}h1v1h-1z{mirrored}")).otherwise(F.lit("")))
    colour = F.substring(digits, 16, 6)
    # A ground's digits are c to f: pale enough for any colour to stand out.
    pale = F.concat(*[F.translate(F.substring(digits, 22 + i, 1), "0123456789ab", "cdefcdefcdef") for i in range(3)])
    back = F.lit(ground.lstrip("#")) if ground else pale
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="-1 -1 7 7"><path d="M-1-1h7v7h-7z" fill="#'), back, F.lit('"/><path d="'), *squares, F.lit('" fill="#'), colour, F.lit('"/></svg>'))
    return image_uri(svg)


def avatar_url(seed: Name, style: str, base: str, trait: Name | None = None, traits: dict[str, dict] | None = None, default: str | None = None, background: str | None = None) -> Column:
    """The address at which a service draws an avatar for the seed.

    traits: a trait's value (Gender, say) -> options of the drawing, which go
    into the address sorted by name, lists joined by commas; for a value that
    isn't there those of default.
    """
    from urllib.parse import quote

    query = lambda o: "".join(f"&{quote(str(k))}={quote(','.join(map(str, v)) if isinstance(v, list | tuple) else str(v).lower() if isinstance(v, bool) else str(v), safe='')}" for k, v in sorted(o.items()))
    rest = F.lit(query((traits or {}).get(default, {})) if default else "")
    options = None
    for value, o in (traits or {}).items() if trait is not None else ():
        hit = F.lower(col(trait).cast("string")) == value.lower()
        options = F.when(hit, F.lit(query(o))) if options is None else options.when(hit, F.lit(query(o)))
    tail = rest if options is None else options.otherwise(rest)
    return F.concat(F.lit(f"{base.rstrip('/')}/{style}/svg?seed="), F.url_encode(col(seed).cast("string")), tail, F.lit(f"&backgroundColor={background.lstrip('#')}" if background else ""))
