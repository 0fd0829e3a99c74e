"""Labels and values of attribute rows: which attribute a label means and what a value states."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from typing import NamedTuple

from .quantities import NUMBER, UnitTable, read_quantity, to_number

# Texts that state nothing, by language.
STATES_NOTHING = frozenset("- -- – — ? ?? ??? . / n/a na n.a. none null nil unknown tbc tba tbd k.a. ka unbekannt inconnu nc n.c. desconocido".split()) | {
    "on request", "upon request", "see photos", "see pictures", "see text", "see description", "not known", "not available",
    "keine angabe", "nicht bekannt", "auf anfrage", "siehe fotos", "siehe text", "siehe bilder",
    "sur demande", "non communiqué", "voir photos", "voir texte", "a petición", "bajo pedido", "ver fotos", "ver texto", "sin datos",
}
TRUE = frozenset("yes y ja j oui o sí si s true t 1 x ✓ ✔ ☑ with mit avec con vorhanden present présent presente available wahr vrai verdadero on".split())
FALSE = frozenset("no n nein non false f 0 ✗ ✘ ☒ without ohne sans sin absent fehlt ausente falsch faux falso off".split()) | {"nicht vorhanden", "not available", "not present"}
_NUMERALS = [
    "one two three four five six seven eight nine ten eleven twelve",
    "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf",
    "un deux trois quatre cinq six sept huit neuf dix onze douze",
    "uno dos tres cuatro cinco seis siete ocho nueve diez once doce",
]
NUMERALS = {word: k + 1 for line in _NUMERALS for k, word in enumerate(line.split())}
_NUM = re.compile(NUMBER)


class Attribute(NamedTuple):
    name: str
    data_type: str
    quantity: str | None


def key(text: str) -> str:
    """A label without case, spacing and punctuation."""
    s = unicodedata.normalize("NFC", re.sub(r"&[a-z]+;|&#\d+;", " ", text)).casefold()
    return "".join(c for c in s if c.isalnum())


class Labels:
    """Resolves a written label to (attribute, unit named in the label)."""

    def __init__(self, rows: list[tuple[str, str, str | None, str | None]], units: UnitTable):
        self.known: dict[str, Attribute] = {}
        self.units, self.memo = units, {}
        for name, data_type, quantity, labels in rows:
            for label in (labels or "").split(";"):
                if label.strip():
                    self.known.setdefault(key(label), Attribute(name, data_type, quantity))

    def find(self, label: str | None) -> tuple[Attribute, str | None] | None:
        if label is None:
            return None
        if label not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[label] = self._find(label)
        return self.memo[label]

    def _find(self, label: str) -> tuple[Attribute, str | None] | None:
        s = re.sub(r"&[a-z]+;|&#\d+;", " ", label).strip()
        if hit := self.known.get(key(s)):
            return hit, None
        # the last part may name a unit: "Weight (kg)", "Weight, kg", "Weight / kg", "Weight in kg", "weight_kg"
        for m in re.finditer(r"[\s,/(\[_:-]+(?:in\s+)?(?=\S)", s):
            head, tail = s[: m.start()], s[m.end():].strip(" )]:_")
            hit = self.known.get(key(head))
            if hit and hit.quantity and self.units.find(tail, hit.quantity):
                return hit, tail
        return None


def squeeze(text: str) -> str:
    return " ".join(text.split())


def states_nothing(text: str | None) -> bool:
    return text is None or not text.strip() or squeeze(text).casefold() in STATES_NOTHING


def read_value(attr: Attribute, value: str | None, spec_unit: str | None, label_unit: str | None, units: UnitTable) -> str | Decimal | None:
    """What a row states for its attribute, or None where it states nothing readable."""
    if attr.data_type == "decimal" and attr.quantity and value and value[0].isdigit():  # nothing that states nothing begins with a digit
        return read_quantity(value, units, attr.quantity, (spec_unit, label_unit))
    if states_nothing(value):
        return None
    s = squeeze(value.replace("&nbsp;", " "))
    if attr.data_type == "text":
        return s
    low = s.casefold().strip(" .!:")
    if attr.data_type == "boolean":
        return "true" if low in TRUE else "false" if low in FALSE else None
    if attr.data_type == "int":
        if low in NUMERALS:
            return str(NUMERALS[low])
        if "year" in attr.name:
            m = re.search(r"(?<!\d)(1[89]\d\d|20\d\d|21\d\d)(?!\d)", s)
            return m[1] if m else None
        m = _NUM.search(s)
        if not m:
            word = re.match(r"[^\W\d_]+", low)
            return str(NUMERALS[word[0]]) if word and word[0] in NUMERALS else None
        number = to_number(m[0])
        return str(int(number)) if number == int(number) else None
    if attr.data_type == "decimal" and attr.quantity:
        return read_quantity(value, units, attr.quantity, (spec_unit, label_unit))
    return None
