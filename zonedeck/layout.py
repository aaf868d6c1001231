"""Record layouts: the fixed, external schema of a binary extract."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal


@dataclass(frozen=True)
class Field:
    """One item of a record.

    ``kind`` is ``text``, ``zoned``, ``packed``, ``binary`` or ``group``.
    ``length`` is the character count of a text item; numbers give ``digits``
    (integer plus decimal digits) and ``scale``.  ``sign`` says where a zoned
    sign sits: ``overpunch``, ``leading`` or ``trailing`` (the last two take a
    byte of their own).
    """

    name: str
    kind: str
    length: int = 0
    digits: int = 0
    scale: int = 0
    signed: bool = False
    sign: str = "overpunch"
    occurs: int = 0
    depending_on: str | None = None
    redefines: str | None = None
    children: tuple["Field", ...] = ()
    #: Condition names with their values: a text or number, or a pair (low, high) for a range.
    conditions: tuple[tuple[str, tuple], ...] = ()

    @property
    def item_width(self) -> int:
        """Bytes of one occurrence."""
        if self.kind == "group":
            return sum(c.width for c in self.children if not c.redefines)
        if self.kind == "text":
            return self.length
        if self.kind == "zoned":
            return self.digits + (1 if self.signed and self.sign != "overpunch" else 0)
        if self.kind == "packed":
            return self.digits // 2 + 1
        if self.kind == "binary":
            return 2 if self.digits <= 4 else 4 if self.digits <= 9 else 8
        raise ValueError(f"unknown field kind {self.kind!r}")

    @property
    def width(self) -> int:
        return self.item_width * max(1, self.occurs)


@dataclass(frozen=True)
class Layout:
    name: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @property
    def width(self) -> int:
        return sum(f.width for f in self.fields if not f.redefines)

    def placed(self) -> Iterator[tuple[Field, int]]:
        return place(self.fields)

    @staticmethod
    def from_copybook(text: str) -> "Layout":
        return _read_copybook(text)


def place(fields: tuple[Field, ...], base: int = 0) -> Iterator[tuple[Field, int]]:
    """Each field with its zero-based byte offset; an overlay starts where its target does."""
    at, seen = base, {}
    for item in fields:
        start = seen[item.redefines] if item.redefines else at
        if not item.redefines:
            at += item.width
        seen[item.name] = start
        yield item, start


_STATEMENT = re.compile(r"^\s*(\d\d)\s+([\w-]+)(.*?)\.\s*$", re.M | re.S)
_PICTURE = re.compile(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", re.I)


def _count(symbols: str, picture: str) -> int:
    """How many positions the given picture symbols take; ``X(9)`` takes nine and holds no 9."""
    found = re.findall(r"([A-Z9])(?:\((\d+)\))?", picture)
    return sum(int(n) if n else 1 for symbol, n in found if symbol in symbols)


def _item(name: str, clauses: str) -> Field:
    occurs = re.search(r"\bOCCURS\s+(?:\d+\s+TO\s+)?(\d+)", clauses, re.I)
    depending = re.search(r"\bDEPENDING\s+(?:ON\s+)?([\w-]+)", clauses, re.I)
    overlay = re.search(r"\bREDEFINES\s+([\w-]+)", clauses, re.I)
    shape = {
        "occurs": int(occurs.group(1)) if occurs else 0,
        "depending_on": column_name(depending.group(1)) if depending else None,
        "redefines": column_name(overlay.group(1)) if overlay else None,
    }
    found = _PICTURE.search(clauses)
    if not found:
        return Field(name, "group", **shape)
    picture = found.group(1).upper()
    if not _count("9", picture) or _count("XA", picture):
        return Field(name, "text", length=_count("XA9", picture), **shape)
    whole, _, part = picture.partition("V")
    scale = _count("9", part)
    number = {"digits": _count("9", whole) + scale, "scale": scale, "signed": picture.startswith("S")}
    if re.search(r"\b(COMP-3|PACKED-DECIMAL)\b", clauses, re.I):
        kind = "packed"
    elif re.search(r"\b(COMP|COMP-4|BINARY)\b", clauses, re.I):
        kind = "binary"
    else:
        kind = "zoned"
    placed = re.search(r"\b(LEADING|TRAILING)\s+SEPARATE", clauses, re.I)
    return Field(name, kind, sign=placed.group(1).lower() if placed else "overpunch", **number, **shape)


def column_name(cobol_name: str) -> str:
    return cobol_name.lower().replace("-", "_")


def _read_copybook(text: str) -> Layout:
    items = [(int(level), column_name(name), clauses) for level, name, clauses in _STATEMENT.findall(text)]
    if any(level in (66, 77) for level, _, _ in items):
        raise ValueError("levels 66 and 77 are not part of a record layout")
    if [level for level, _, _ in items].count(1) > 1:
        raise ValueError("one copybook describes one 01 record")
    name = "record"
    if items and items[0][0] == 1 and not _PICTURE.search(items[0][2]):
        name, items = items[0][1], items[1:]
    # Each FILLER gets a name of its own.
    fillers = 0
    for i, (level, item, clauses) in enumerate(items):
        if item == "filler":
            fillers += 1
            items[i] = (level, item if fillers == 1 else f"filler_{fillers}", clauses)
    fields, _ = _nest(items, 0, 0)
    return Layout(name, tuple(fields))


_LITERAL = r"'(?:[^']|'')*'|\"[^\"]*\"|[-+]?(?:\d+\.?\d*|\.\d+)|\b(?:ZEROE?S?|SPACES?)\b"


def _values(clauses: str) -> tuple:
    """Values of a condition name; ``low THRU high`` gives a pair."""
    def value(text: str):
        if text[0] == "'":
            return text[1:-1].replace("''", "'")
        if text[0] == '"':
            return text[1:-1]
        if text.upper().startswith("SPACE"):
            return " "
        return Decimal(0) if text.upper().startswith("ZERO") else Decimal(text)

    found = re.finditer(rf"({_LITERAL})(?:\s+THR(?:U|OUGH)\s+({_LITERAL}))?", re.sub(
        r"^\s*VALUES?\s+(?:IS\s+|ARE\s+)?", "", clauses, flags=re.I), re.I)
    return tuple((value(m[1]), value(m[2])) if m[2] else value(m[1]) for m in found)


def _nest(items, at: int, above: int) -> tuple[list[Field], int]:
    """Fields from ``at`` on whose level is deeper than ``above``; 88 entries join the item before them."""
    found: list[Field] = []
    while at < len(items) and items[at][0] > above:
        level, name, clauses = items[at]
        item, at = _item(name, clauses), at + 1
        conditions = []
        while at < len(items) and items[at][0] == 88:
            conditions.append((items[at][1], _values(items[at][2])))
            at += 1
        children, at = _nest(items, at, level)
        found.append(replace(item, children=tuple(children), conditions=tuple(conditions)))
    return found, at
