"""Numbers and unit expressions in free text.

A unit expression is parsed with a small grammar::

    expression := ["x1000"] factor {("/" | " per " | "*" | "·") factor}, read from left to right
    factor     := "1" | [prefix] atom [exponent]
    exponent   := "2" | "3" | "²" | "³" | "-1" | "^n"

Every atom carries a dimension, an exponent vector over (mass, length, time,
turn, temperature), a scale to SI and an offset, so ``N/mm2`` and ``MPa`` meet
without being listed as equal.  A parsed unit is then snapped to the entry of
the caller's unit table that has its dimension and scale, so that the table's
own factor and offset are what is applied.
"""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import Decimal
from typing import NamedTuple

Dim = tuple[int, int, int, int, int]
MASS, LENGTH, TIME, TURN, TEMP = ((1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1))
FORCE, POWER, PRESSURE, VOLUME = (1, 1, -2, 0, 0), (1, 2, -3, 0, 0), (1, -1, -2, 0, 0), (0, 3, 0, 0, 0)


class Unit(NamedTuple):
    dim: Dim
    scale: float
    offset: float = 0.0


# Physical atoms and the ways they are written in English, German, French and Spanish.
_ATOMS: list[tuple[str, Unit]] = [
    ("kg kgs kilogram kilograms kilogramm kilogramme kilogrammes kilo kilos kilogramo kilogramos", Unit(MASS, 1.0)),
    ("g gram grams gramm", Unit(MASS, 1e-3)),
    ("t to ton tons tonne tonnes tonnen metricton metrictons tonelada toneladas", Unit(MASS, 1000.0)),
    ("lb lbs pound pounds libra libras livre livres", Unit(MASS, 0.45359237)),
    ("n newton newtons", Unit(FORCE, 1.0)),
    ("lbf", Unit(FORCE, 4.4482216152605)),
    ("w watt watts vatio vatios", Unit(POWER, 1.0)),
    ("kilowatt kilowatts kilovatio kilovatios", Unit(POWER, 1000.0)),
    ("hp horsepower bhp", Unit(POWER, 745.699872)),
    ("ps ch cv", Unit(POWER, 735.49875)),
    ("m meter meters metre metres mètre mètres metro metros", Unit(LENGTH, 1.0)),
    ("millimetre millimetres millimeter millimeters millimètre millimètres milímetro milímetros", Unit(LENGTH, 1e-3)),
    ("centimetre centimetres centimeter centimeters zentimeter centimètre centimètres centímetro centímetros", Unit(LENGTH, 1e-2)),
    ("in inch inches zoll pouce pouces pulgada pulgadas \" ″ ”", Unit(LENGTH, 0.0254)),
    ("ft foot feet fuß fuss pied pieds pie pies ' ′ ’", Unit(LENGTH, 0.3048)),
    ("rpm upm", Unit((0, 0, -1, 1, 0), 1 / 60)),
    ("rps", Unit((0, 0, -1, 1, 0), 1.0)),
    ("rev u tr turn turns umdr umdrehungen tour tours vuelta vueltas", Unit(TURN, 1.0)),
    ("min minute minutes minuten minuto", Unit(TIME, 60.0)),
    ("s sec second seconds sek", Unit(TIME, 1.0)),
    ("h hr hrs hour hours std stunden heures horas", Unit(TIME, 3600.0)),
    ("pa pascal", Unit(PRESSURE, 1.0)),
    ("kilopascal kilopascals", Unit(PRESSURE, 1e3)),
    ("megapascal megapascals", Unit(PRESSURE, 1e6)),
    ("bar bars", Unit(PRESSURE, 1e5)),
    ("psi", Unit(PRESSURE, 6894.757293)),
    ("l liter liters litre litres ltr litro litros", Unit(VOLUME, 1e-3)),
    ("gal gallon gallons usgal usgallon usgallons galus gallone gallonen galón galones", Unit(VOLUME, 3.785411784e-3)),
    ("cbm cubicmetre cubicmetres cubicmeter cubicmeters kubikmeter", Unit(VOLUME, 1.0)),
    ("k kelvin", Unit(TEMP, 1.0)),
    ("°c c degc gradc degreescelsius degreecelsius celsius gradcelsius centigrade degréscelsius gradoscelsius", Unit(TEMP, 1.0, 273.15)),
    ("°f f degf gradf degreesfahrenheit degreefahrenheit fahrenheit gradfahrenheit", Unit(TEMP, 5 / 9, 459.67 * 5 / 9)),
]
ATOMS = {name: unit for names, unit in _ATOMS for name in names.split()}
_PREFIX = {"k": 1e3, "m": 1e-3, "c": 1e-2, "d": 1e-1}
_PREFIXABLE = {"m", "n", "w", "pa", "l", "g", "u", "rpm", "rev", "tr"}


def _atom(text: str, raw: str) -> Unit | None:
    if text in ATOMS:
        return ATOMS[text]
    head, tail = text[:1], text[1:]
    if head in _PREFIX and tail in _PREFIXABLE:
        scale = 1e6 if raw[:1] == "M" and tail in ("pa", "n", "w") or head == "m" and tail == "pa" else _PREFIX[head]
        return ATOMS[tail]._replace(scale=ATOMS[tail].scale * scale)
    return None


def _factor(raw: str) -> Unit | None:
    if raw == "1":
        return Unit((0, 0, 0, 0, 0), 1.0)
    m = re.fullmatch(r"(.*?)(?:\^?(-?[123])|([²³]))?", raw)
    body, power = m[1], int(m[2]) if m[2] else {"²": 2, "³": 3}.get(m[3], 1)
    unit = _atom(body.lower(), body)
    if unit is None:
        return None
    return unit if power == 1 else Unit(tuple(x * power for x in unit.dim), unit.scale**power)


_NOTE = " \t\n\r\u00a0*†¹#"


def without_notes(text: str) -> str:
    """Without remarks in brackets and marks of notes at the end."""
    s = text.rstrip(_NOTE)
    while s.endswith(")") and "(" in s:
        s = s[: s.rindex("(")].rstrip(_NOTE)
    return s


def parse_unit(text: str | None) -> Unit | None:
    """The unit a text states, or None if it states none."""
    if not text:
        return None
    s = unicodedata.normalize("NFC", text.replace("&nbsp;", " ")).strip().strip(":;,")
    times = 1.0
    if m := re.match(r"[x×*]\s*(\d+)\s+", s):
        times, s = float(m[1]), s[m.end():]
    s = re.sub(r"\s+per\s+", "/", s, flags=re.I)
    parts = re.split(r"(?<=.)([/·*])", re.sub(r"[\s.()\[\]]+", "", s))
    out = Unit((0, 0, 0, 0, 0), 1.0)
    for k in range(0, len(parts), 2):
        unit = _factor(parts[k])
        if unit is None:
            return None
        sign = -1 if k and parts[k - 1] == "/" else 1
        out = unit if not k else Unit(tuple(a + sign * b for a, b in zip(out.dim, unit.dim)), out.scale * unit.scale**sign)
    if out.dim == (0, 0, -1, 0, 0):  # 1/min and min-1 count turns
        out = out._replace(dim=(0, 0, -1, 1, 0))
    if any(out.dim):
        return out._replace(scale=out.scale * times)
    return None


class UnitTable:
    """The caller's units (name, quantity, factor, offset), found by dimension and scale."""

    def __init__(self, rows: list[tuple[str, str, float, float]]):
        self.by_quantity: dict[str, list[tuple[Unit, float, float]]] = {}
        self.memo: dict[str, Unit | None] = {}
        self.found: dict[tuple[str, str], tuple[Decimal, Decimal] | None] = {}
        for name, quantity, factor, offset in rows:
            unit = parse_unit(name)
            if unit and factor is not None:
                self.by_quantity.setdefault(quantity, []).append((unit, float(factor), float(offset or 0.0)))

    def parsed(self, text: str) -> Unit | None:
        if text not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[text] = parse_unit(text) or parse_unit(without_notes(text))
        return self.memo[text]

    def find(self, text: str | None, quantity: str) -> tuple[Decimal, Decimal] | None:
        """(factor, offset) to the base unit of ``quantity``; None where the text has no such unit."""
        if not text:
            return None
        if (text, quantity) not in self.found:
            if len(self.found) > 50_000:
                self.found.clear()
            self.found[text, quantity] = self._find(text, quantity)
        return self.found[text, quantity]

    def _find(self, text: str, quantity: str) -> tuple[Decimal, Decimal] | None:
        unit = self.parsed(text)
        entries = self.by_quantity.get(quantity)
        if unit is None or not entries or entries[0][0].dim != unit.dim:
            return None
        for known, factor, offset in entries:
            if math.isclose(known.scale, unit.scale, rel_tol=1e-4) and math.isclose(known.offset, unit.offset, abs_tol=1e-2):
                return Decimal(repr(factor)), Decimal(repr(offset))
        base = next((u for u, f, o in entries if f == 1.0 and o == 0.0), None)
        return (Decimal(repr(unit.scale / base.scale)), Decimal(0)) if base and not unit.offset else None


#: A number with grouping by comma, point, apostrophe or any space.
NUMBER = r"\d{1,3}(?:[,.'’][0-9]{3}|[\s][0-9]{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?"
_NUM = re.compile(NUMBER)
_HEAD = re.compile(r"^(?:ca|approx|aprox|env|environ|about|around|etwa|circa|up to|max|bis|bis zu|hasta|jusqu'à|≤|<=|<|~|≈|±)?\.?\s*", re.I)
_RANGE = re.compile(r"\s*(?:-|–|—|…|\.\.\.?|to|bis|à|a|hasta)\s*", re.I)
_BOTH = re.compile(r"\s*([^\d\s(][^\d(]*?)\s*(?:-|–|—|…|\bto\b|\bbis\b|\bà\b|\bhasta\b)\s*(\d.*)$", re.I)
# inches beside feet have two digits at most: three after an apostrophe are a group of thousands
_FEET = re.compile(r"(\d+)\s*(?:ft\.?|feet|foot|['′’])\s*(\d{1,2}(?:[.,]\d+)?)?\s*(?:in\.?|inches|inch|[\"″”]|'')?\s*", re.I)
_PLAIN = re.compile(r"(\d+)(?:([.,])(\d+))?\s?([^\d\s/][^\d]*)?")  # most values: a number, and a unit without digits
_FRACTION = re.compile(r"(\d+)[\s-]+(\d+)/(\d+)\s*(.*)", re.S)


def to_number(text: str) -> Decimal:
    """A matched NUMBER; one separator before three last digits groups thousands."""
    s = re.sub(r"[\s'’]", "", text)
    seps = [c for c in s if c in ",."]
    if not seps:
        return Decimal(s)
    last = max(s.rfind(","), s.rfind("."))
    whole = re.sub(r"[,.]", "", s[:last])
    if len(set(seps)) == 1 and (len(seps) > 1 or len(s) - last - 1 == 3):
        return Decimal(whole + s[last + 1:])
    return Decimal(whole + "." + s[last + 1:])


def _split_digits(text: str) -> list[tuple[Decimal, str]]:
    """Readings of a text as number and unit: ``169501/min`` is 16950 in 1/min."""
    out = []
    m = _NUM.match(text)
    if not m:
        return out
    out.append((to_number(m[0]), text[m.end():]))
    # the numeral of 1/min and 1/s may have run into the number
    if m2 := re.match(r"(.*?)(\s*)1\s*/\s*(min|s)\b", text):
        if (n := _NUM.fullmatch(m2[1].strip())):
            out.insert(0, (to_number(n[0]), "1/" + m2[3]))
    return out


def read_quantity(value: str | None, units: UnitTable, quantity: str, fallbacks: tuple[str | None, ...]) -> Decimal | None:
    """The base value of a text; a unit in the text goes before those of ``fallbacks``. A range counts with its upper end."""
    if not value:
        return None
    if m := _PLAIN.fullmatch(value):
        whole, sep, part, rest = m.groups()
        number = Decimal(whole if not sep else whole + part if len(part) == 3 else f"{whole}.{part}")
        return _first(number, (rest,) if rest and units.parsed(rest) is not None else fallbacks, units, quantity)
    s = unicodedata.normalize("NFC", value.replace("&nbsp;", " "))
    s = re.sub(r"[\s​]+", " ", s).strip()
    prev = None
    while prev != s:
        prev, s = s, _HEAD.sub("", s, count=1)
    if not s or not re.match(r"[-−]?\d", s):
        return None
    if quantity == "length":
        if m := _FEET.fullmatch(s):
            return _apply(Decimal(m[1]) * 12 + (Decimal(m[2].replace(",", ".")) if m[2] else 0), "in", units, quantity)
        if m := _FRACTION.fullmatch(s):
            number = int(m[1]) + Decimal(m[2]) / Decimal(m[3]) if int(m[3]) else None
            return _first(number, (m[4], *fallbacks), units, quantity) if number is not None else None
    sign = -1 if s[0] in "-−" else 1
    s = s.lstrip("-−")
    for number, rest in _split_digits(s):
        if (m := _RANGE.match(rest)) and m[0].strip() and _NUM.match(rest[m.end():]):
            best = _split_digits(rest[m.end():])
            for upper, unit in best:
                got = _first(upper, (unit, *fallbacks) if not unit.strip() else (unit,), units, quantity)
                if got is not None:
                    return got
            continue
        if (m := _BOTH.match(rest)) and units.parsed(m[1]) is not None and (upper := read_quantity(m[2], units, quantity, (m[1],))) is not None:
            return upper
        stated = units.parsed(rest) is not None
        got = _first(sign * number, (rest,) if stated else fallbacks, units, quantity)
        if got is not None:
            return got
    return None


def _first(number: Decimal, texts: tuple[str | None, ...], units: UnitTable, quantity: str) -> Decimal | None:
    for text in texts:
        got = _apply(number, text, units, quantity)
        if got is not None:
            return got
    return None


def _apply(number: Decimal, text: str | None, units: UnitTable, quantity: str) -> Decimal | None:
    """The number in the base unit, by the table's factor and offset as they are written."""
    found = units.find(text, quantity)
    return None if found is None else number * found[0] + found[1]


def half_up(x: Decimal) -> int:
    """Rounded half up to a whole number, without a binary step."""
    return math.floor(x + Decimal("0.5"))
