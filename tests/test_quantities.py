import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyforge.functions.attributes import Attribute, Labels, read_value
from tallyforge.functions.quantities import UnitTable, half_up, parse_unit, read_quantity, to_number
from tallyforge.operators.units import parse_currency, stated_currency

UNITS = UnitTable([
    ("kg", "mass", 1.0, 0.0), ("t", "mass", 1000.0, 0.0), ("lb", "mass", 0.453592, 0.0), ("W", "power", 1.0, 0.0), ("kW", "power", 1000.0, 0.0), ("hp", "power", 745.699872, 0.0),
    ("mm", "length", 1.0, 0.0), ("in", "length", 25.4, 0.0), ("ft", "length", 304.8, 0.0), ("rpm", "rotation", 1.0, 0.0), ("rev/s", "rotation", 60.0, 0.0), ("krpm", "rotation", 1000.0, 0.0),
    ("kPa", "pressure", 1.0, 0.0), ("MPa", "pressure", 1000.0, 0.0), ("psi", "pressure", 6.894757, 0.0), ("l", "volume", 1.0, 0.0), ("m3", "volume", 1000.0, 0.0),
    ("°C", "temperature", 1.0, 0.0), ("°F", "temperature", 0.555556, -17.777778), ("K", "temperature", 1.0, -273.15),
])


@pytest.mark.parametrize(("value", "quantity", "units", "expected"), [
    ("1,250 kg", "mass", (), 1250), ("1.250 kg (net)", "mass", (), 1250), ("12,5", "mass", ("t",), 12500), ("2 566 kg *", "mass", (), 2566), ("2'249 kg", "mass", (), 2249),
    ("5-51.5", "power", ("hp",), 38404), ("169501/min", "rotation", (), 16950), ("13.3 x1000 rpm", "rotation", (), 13300), ("15300 min-1", "rotation", (), 15300), ("102 1/s", "rotation", (), 6120),
    ("2 ft 11 in", "length", (), 889), ("79 1/2\"", "length", (), 2019), ("10.66 N/mm2", "pressure", (), 10660), ("3289 lbf/in2", "pressure", (), 22677),
    ("364 °F", "temperature", (), 184), ("553K", "temperature", (), 280), ("1.15 m3", "volume", ("l",), 1150), ("7", "mass", ("bar", "t"), 7000), ("up to 13.362", "mass", ("KG",), 13362), ("3 kg - 5 kg", "mass", (), 5), ("3 to 34.3 t", "mass", (), 34300), ("1.58 to", "mass", ("kg",), 1580),
])
def test_quantities(value, quantity, units, expected):
    assert half_up(read_quantity(value, UNITS, quantity, units)) == expected


@pytest.mark.parametrize("value", [None, "", "n/a", "12 bar", "see text", "kg", "1/0", "-"])
def test_nothing_to_read(value):
    assert read_quantity(value, UNITS, "mass", (None, "")) is None


def test_dimensions_meet_without_being_listed_as_equal():
    assert parse_unit("N/mm2").dim == parse_unit("psi").dim == parse_unit("MPa").dim
    assert parse_unit("1/min").dim == parse_unit("U/min").dim
    assert parse_unit("kg/kg") is None


@given(st.integers(0, 10**9))
def test_grouping_round_trip(n):
    for sep in (",", ".", " ", "'", " "):
        assert to_number(f"{n:,}".replace(",", sep)) == n


def test_labels_and_values():
    labels = Labels([("weight", "decimal", "mass", "Weight;Gewicht"), ("axis_count", "int", None, "Number of axes"), ("ce_marked", "boolean", None, "CE mark")], UNITS)
    assert labels.find("  GEWICHT&nbsp;")[0].name == "weight"
    assert labels.find("weight_kg") == (Attribute("weight", "decimal", "mass"), "kg")
    assert labels.find("Weight / lb")[1] == "lb"
    assert labels.find("Weighty") is None and labels.find(None) is None and labels.find("") is None
    axis, mark = labels.find("number-of-axes")[0], labels.find("CE-mark:")[0]
    assert read_value(axis, "three", None, None, UNITS) == "3"
    assert read_value(axis, "5-axis", None, None, UNITS) == "5"
    assert read_value(axis, "tbc", None, None, UNITS) is None
    assert read_value(mark, "✗", None, None, UNITS) == "false" and read_value(mark, "maybe", None, None, UNITS) is None
    assert read_value(Attribute("year_built", "int", None), "05/1994", None, None, UNITS) == "1994"


@pytest.mark.parametrize(("text", "expected"), [("kGBP", ("GBP", 1000.0)), ("T€", ("EUR", 1000.0)), ("USD '000", ("USD", 1000.0)), ("EUR x1000", ("EUR", 1000.0)), ("tys. PLN", ("PLN", 1000.0)), ("pence", ("GBP", 0.01)), ("ct", ("EUR", 0.01)), ("Fr.", ("CHF", 1.0)), (" eur", ("EUR", 1.0)), ("doubloons", None), (None, None)])
def test_currencies(text, expected):
    assert parse_currency(text) == expected


def test_currency_beside_the_amount():
    assert stated_currency(23325.0, "Title\nAsking price 23,325 GBP ex works.") == ("GBP", 1.0)
    assert stated_currency(26539.0, "Prix demandé EUR 26 539 hors taxes.") == ("EUR", 1.0)
    assert stated_currency(100.0, "Similar offers: X 1 - 100 USD") is None
    assert stated_currency(5.0, None) is None


@pytest.mark.parametrize(("text", "dim", "scale"), [
    ("N·m", (1, 2, -2, 0, 0), 1.0), ("N*m", (1, 2, -2, 0, 0), 1.0), ("N/m", (1, 0, -2, 0, 0), 1.0), ("kg·m/s²", (1, 1, -2, 0, 0), 1.0), ("kg per h", (1, 0, -1, 0, 0), 1 / 3600), ("l per min", (0, 3, -1, 0, 0), 1e-3 / 60),
    ("kN·mm", (1, 2, -2, 0, 0), 1.0), ("kg·m·m/s/s", (1, 2, -2, 0, 0), 1.0), ("kilogrammes per cubicmetre", (1, -3, 0, 0, 0), 1.0),
])
def test_products_and_quotients_of_units(text, dim, scale):
    unit = parse_unit(text)
    assert unit.dim == dim and unit.scale == pytest.approx(scale)


def test_units_of_any_length():
    assert parse_unit("kilogrammes per cubicmetre * cubicmetre per kilogrammes * kilogrammes").dim == (1, 0, 0, 0, 0)
    assert parse_unit("x" * 100_000) is None and UNITS.parsed("kg " + "*" * 50_000 + "x") is None
    assert UNITS.parsed("kg (net) " + "*" * 50_000) == parse_unit("kg")


@pytest.mark.parametrize(("value", "quantity", "units", "expected"), [
    ("2'590", "length", (None, "mm"), 2590), ("2'590", "length", (None, None), None), ("2' 5", "length", (), 737), ("2'5\"", "length", (), 737), ("6'", "length", (), 1829),
    ("1,000,000,000 kg", "mass", (), 1_000_000_000), ("999999999999.5 kg", "mass", (), 1_000_000_000_000), ("600000000 W", "power", (), 600_000_000), ("0.5 kg", "mass", (), 1), ("0.49 kg", "mass", (), 0),
])
def test_whole_amounts_are_exact(value, quantity, units, expected):
    got = read_quantity(value, UNITS, quantity, units)
    assert (None if got is None else half_up(got)) == expected
