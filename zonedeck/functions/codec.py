"""Record bytes to typed columns and back, as native column expressions.

Bytes are read as ISO-8859-1, which maps every byte to one character, so that
``translate`` can rewrite all 256 code points in one pass.  Digits are never
parsed through a string form that accepts exponents or points: every character
that is not a digit becomes ``x`` first, so a damaged field casts to NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonedeck.layout import Field, Layout, place

EBCDIC = "cp037"

#: The blanks that Python's ``str.strip`` removes, as far as cp037 can hold them.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"

# Byte 0 is the same character in both alphabets and stays out of the text map, because
# ``translate`` reads a NUL on its right side as "delete".  On the left side NUL is a plain key.
_LATIN = bytes(range(1, 256)).decode("latin-1")
_TEXT = bytes(range(1, 256)).decode(EBCDIC)
_ALL = bytes(range(256)).decode("latin-1")


def _byte_map(rule) -> str:
    """One output character per byte 0..255, by rule."""
    return "".join(rule(b) for b in range(256))


_ZONED_DIGIT = _byte_map(lambda b: str(b & 15) if 0xF0 <= b <= 0xF9 else "x")
_LOW_DIGIT = _byte_map(lambda b: str(b & 15) if b & 15 <= 9 else "x")
_ZONE_SIGN = _byte_map(lambda b: {0xC: "+", 0xF: "+", 0xD: "-"}.get(b >> 4, "x"))


def _chars(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def number_type(digits: int, scale: int) -> str:
    if scale:
        return f"decimal({digits},{scale})"
    return "int" if digits <= 9 else "bigint" if digits <= 18 else f"decimal({digits},0)"


def _to_number(signed_digits: Column, digits: int, scale: int) -> Column:
    """Text of sign and digits to a number with ``scale`` implied decimals; junk or overflow gives NULL."""
    if digits <= 18:
        whole = signed_digits.try_cast("bigint")
        if not scale:
            return whole.try_cast(number_type(digits, 0))
        point = F.lit("0." + "0" * (scale - 1) + "1").cast(f"decimal({scale},{scale})")
        return (whole.try_cast(f"decimal({digits},0)") * point).cast(f"decimal({digits},{scale})")
    if not scale:
        return signed_digits.try_cast(f"decimal({digits},0)")
    keep = F.length(signed_digits) - scale
    dotted = F.concat(F.substring(signed_digits, F.lit(1), keep), F.lit("."),
                      F.substring(signed_digits, keep + 1, F.lit(scale)))
    return dotted.try_cast(f"decimal({digits},{scale})")


def decode_text(raw: Column, strip: str = "both") -> Column:
    text = F.translate(_chars(raw), _LATIN, _TEXT)
    if strip == "both":
        return F.btrim(text, F.lit(BLANKS))
    if strip == "right":
        return F.rtrim(text, F.lit(BLANKS))
    return text


def decode_zoned(raw: Column, item: Field) -> Column:
    chars = _chars(raw)
    if item.signed and item.sign != "overpunch":
        text = F.translate(chars, _LATIN, _TEXT)
        lead = item.sign == "leading"
        sign = F.substring(text, 1 if lead else item.digits + 1, 1)
        body = F.substring(chars, 2 if lead else 1, item.digits)
        sign = F.when(sign.isin("+", "-"), sign).otherwise(F.lit("x"))
        return _to_number(F.concat(sign, F.translate(body, _ALL, _ZONED_DIGIT)), item.digits, item.scale)
    if not item.signed:
        return _to_number(F.translate(chars, _ALL, _ZONED_DIGIT), item.digits, item.scale)
    sign = F.translate(F.substring(chars, item.digits, 1), _ALL, _ZONE_SIGN)
    return _to_number(F.concat(sign, F.translate(chars, _ALL, _LOW_DIGIT)), item.digits, item.scale)


def decode_packed(raw: Column, item: Field) -> Column:
    """All nibbles but the last are digits; a pad digit that is not zero is an overflow and rejects."""
    nibbles = F.hex(raw)
    last = item.item_width * 2
    sign = F.translate(F.substring(nibbles, last, 1), "CFDABE0123456789", "++-xxxxxxxxxxxxx")
    digits = F.translate(F.substring(nibbles, 1, last - 1), "ABCDEF", "xxxxxx")
    number = _to_number(F.concat(sign, digits), item.digits, item.scale)
    if item.digits % 2:
        return number
    return F.when(F.substring(nibbles, 1, 1) == "0", number)


def decode_binary(raw: Column, item: Field) -> Column:
    nibbles, bits = F.hex(raw), item.item_width * 8
    if bits == 64:
        value = F.conv(nibbles, 16, -10 if item.signed else 10)
        if item.signed:
            value = value.try_cast("bigint")
        else:
            value = value.try_cast("decimal(20,0)")
    else:
        value = F.conv(nibbles, 16, 10).try_cast("bigint")
        if item.signed:
            value = F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)
        if bits == 16 or item.signed:
            value = value.cast("int")
    if item.scale:
        point = F.lit("0." + "0" * (item.scale - 1) + "1").cast(f"decimal({item.scale},{item.scale})")
        return (value.cast("decimal(20,0)") * point).try_cast(f"decimal({max(item.digits, 20)},{item.scale})")
    return value


def decode_item(raw: Column, item: Field, strip: str = "both") -> Column:
    if item.kind == "text":
        return decode_text(raw, strip)
    return {"zoned": decode_zoned, "packed": decode_packed, "binary": decode_binary}[item.kind](raw, item)


def _slice(rec: Column, at, width: int) -> Column:
    """``width`` bytes from zero-based ``at``, which is a number or a column."""
    if isinstance(at, int):
        return F.substring(rec, at + 1, width)
    return F.substring(rec, at + 1, F.lit(width))


def _raise(item: Field, raw: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"bad {item.name}: "), F.hex(raw)))


def _decode_at(rec: Column, item: Field, at, strip: str, checked: bool, counts: dict[str, Column] | None = None) -> Column:
    if item.kind == "group":
        known, parts = dict(counts or {}), []
        for child, start in place(item.children):
            known[child.name] = _decode_any(rec, child, at + start, strip, checked, known)
            parts.append(known[child.name].alias(child.name))
        return F.struct(*parts)
    raw = _slice(rec, at, item.item_width)
    value = decode_item(raw, item, strip)
    return F.coalesce(value, _raise(item, raw)) if checked and item.kind != "text" else value


def _decode_any(rec: Column, item: Field, at, strip: str, checked: bool,
                counts: dict[str, Column] | None = None) -> Column:
    if not item.occurs:
        return _decode_at(rec, item, at, strip, checked, counts)
    def cells(count: Column) -> Column:
        """The first ``count`` entries; entries beyond are never looked at."""
        places = F.slice(F.sequence(F.lit(0), F.lit(item.occurs - 1)), F.lit(1), count)
        return F.transform(places, lambda i: _decode_at(rec, item, i * item.item_width + at, strip, checked, counts))

    if not item.depending_on or not counts or item.depending_on not in counts:
        return cells(F.lit(item.occurs))
    wanted = counts[item.depending_on]
    used = cells(F.when(wanted.between(0, item.occurs), wanted).cast("int"))
    return F.coalesce(used, _raise(item, rec)) if checked else used


def decode_columns(rec: Column, layout: Layout, strip: str = "both", checked: bool = False) -> dict[str, Column]:
    """Field name to decoded column, overlays included.

    With ``checked`` each number raises when its own bytes are damaged, inside the expression that
    decodes it: a column nobody reads is still pruned.  Otherwise damage gives NULL.
    """
    columns: dict[str, Column] = {}
    for item, at in layout.placed():
        columns[item.name] = _decode_any(rec, item, at, strip, checked and not item.redefines, _with_inner(layout, columns))
    return columns


def _with_inner(layout: Layout, columns: dict[str, Column]) -> dict[str, Column]:
    """The columns known so far and the items inside their groups, where a count may stand."""
    known = dict(columns)

    def visit(item: Field, column: Column) -> None:
        if item.kind == "group" and not item.occurs:
            for child in item.children:
                known.setdefault(child.name, column.getField(child.name))
                visit(child, known[child.name])

    for item in layout.fields:
        if item.name in columns:
            visit(item, columns[item.name])
    return known


def condition_columns(layout: Layout, columns: dict[str, Column]) -> dict[str, Column]:
    """Named booleans (level 88) over already decoded columns, items inside groups included.

    An item that repeats has a condition for each occurrence, not for the record, so it is left out.
    """
    flags: dict[str, Column] = {}

    def literal(value, item: Field) -> Column:
        if item.kind == "text":
            # Decoded texts have no blanks at the ends.
            return F.lit(str(value).strip(BLANKS))
        return F.lit(str(value)).try_cast("decimal(38,10)")

    def visit(item: Field, column: Column) -> None:
        for name, values in item.conditions:
            shown = F.btrim(column, F.lit(BLANKS)) if item.kind == "text" else column
            tests = [shown.between(literal(v[0], item), literal(v[1], item)) if isinstance(v, tuple)
                     else shown == literal(v, item) for v in values]
            flags[name] = reduce(lambda a, b: a | b, tests)
        if item.kind == "group" and not item.occurs:
            for child in item.children:
                visit(child, column.getField(child.name))

    for item in layout.fields:
        if not item.occurs:
            visit(item, columns[item.name])
    return flags


def _bad(value: Column, item: Field) -> Column | None:
    """True where a decoded value shows damaged bytes; text can never be damaged."""
    if item.occurs:
        inner = lambda cell: _bad(cell, Field(**{**item.__dict__, "occurs": 0}))
        if inner(value) is None:
            return None
        return value.isNull() | F.exists(value, inner)
    if item.kind == "text":
        return None
    if item.kind == "group":
        tests = [t for t in (_bad(value.getField(c.name), c) for c in item.children) if t is not None]
        return reduce(lambda a, b: a | b, tests) if tests else None
    return value.isNull()


def reject_reason(rec: Column, layout: Layout, columns: dict[str, Column]) -> Column:
    """Name of the first thing wrong with a record, NULL for a good one."""
    reason = F.when(F.length(rec) != layout.width, F.lit("length"))
    for item in layout.fields:
        test = None if item.redefines else _bad(columns[item.name], item)
        if test is not None:
            reason = reason.when(test, F.lit(item.name))
    return reason


# ---------------------------------------------------------------- encoding

def _unscaled(value: Column, item: Field, rounding: str) -> Column:
    """Whole number of smallest units, NULL when it does not fit the picture."""
    from zonedeck.functions.money import rounded

    # Two decimals more than the picture has are enough to round by, unless the value is finer still.
    finer = F.when(value.try_cast("decimal(38,18)").isNotNull(), rounded(value.try_cast("decimal(38,18)"), item.scale, rounding))
    wide = F.coalesce(finer.try_cast(f"decimal(38,{item.scale})"),
                      rounded(value.try_cast("decimal(38,10)"), item.scale, rounding).try_cast(f"decimal(38,{item.scale})"))
    units = (wide * F.lit(10 ** item.scale).cast("decimal(18,0)")).try_cast("decimal(38,0)")
    limit = F.lit(str(10 ** item.digits)).cast("decimal(38,0)")
    low = -limit if item.signed else F.lit(-1).cast("decimal(38,0)")
    return F.when((units < limit) & (units > low), units)


def encode_item(value: Column, item: Field, rounding: str = "half_up") -> Column:
    """Bytes of one value; NULL when the value does not fit."""
    if item.kind == "text":
        fits = F.length(value) <= item.length
        inside = ~value.rlike("[^\\x00-\\xff]")
        padded = F.rpad(F.when(fits & inside, value), item.length, " ")
        return F.encode(F.translate(padded, _TEXT, _LATIN), "ISO-8859-1")
    units = _unscaled(value, item, rounding)
    digits = F.lpad(F.abs(units).cast("string"), item.digits, "0")
    minus = units < 0
    if item.kind == "packed":
        padded = F.lpad(F.abs(units).cast("string"), item.item_width * 2 - 1, "0")
        sign = F.when(minus, "D").otherwise("C") if item.signed else F.lit("F")
        return F.unhex(F.concat(padded, sign))
    if item.kind == "binary":
        width = item.item_width * 2
        return F.unhex(F.substring(F.lpad(F.hex(units.cast("bigint")), 16, "0"), 17 - width, width))
    zoned = F.regexp_replace(digits, "(\\d)", "F$1")
    if not item.signed:
        return F.unhex(zoned)
    if item.sign != "overpunch":
        mark = F.when(minus, "60").otherwise("4E")
        return F.unhex(F.concat(mark, zoned) if item.sign == "leading" else F.concat(zoned, mark))
    zone = F.when(minus, "D").otherwise("C")
    return F.unhex(F.concat(F.substring(zoned, 1, item.digits * 2 - 2), zone, F.substring(digits, item.digits, 1)))


def _encode_at(value: Column, item: Field, rounding: str, known: dict[str, Column]) -> Column:
    if item.kind != "group":
        return encode_item(value, item, rounding)
    known = {**known, **{c.name: value.getField(c.name) for c in item.children}}
    return F.concat(*[
        _encode_any(value.getField(c.name), c, rounding, known) for c in item.children if not c.redefines
    ])


def _encode_any(value: Column, item: Field, rounding: str, known: dict[str, Column]) -> Column:
    """A list must be full, or as long as its count says; entries that are not used are blanks."""
    if not item.occurs:
        return _encode_at(value, item, rounding, known)
    cells = F.transform(value, lambda cell: F.hex(_encode_at(cell, item, rounding, known)))
    long_enough, digits = F.size(value) == item.occurs, F.array_join(cells, "")
    if item.depending_on in known:
        long_enough = long_enough | ((F.size(value) == known[item.depending_on]) & (F.size(value) < item.occurs))
        digits = F.rpad(digits, item.occurs * item.item_width * 2, "40")
    return F.when(long_enough & ~F.exists(cells, lambda c: c.isNull()), F.unhex(digits))


def encode_record(layout: Layout, columns: dict[str, Column], rounding: str = "half_up") -> Column:
    """The whole record; NULL when any value does not fit its field."""
    known = _with_inner(layout, columns)
    return F.concat(*[
        _encode_any(columns[f.name], f, rounding, known) for f in layout.fields if not f.redefines
    ])
