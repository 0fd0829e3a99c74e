"""Entries within reach, and values without one."""

from tallyforge.llm import canonical
from tallyforge.llm.queries import QUERIES


def test_every_entry_within_reach(spark, data):
    d = data.put("machines", [{"id": 1, "brand": "Norviksno"}, {"id": 2, "brand": "Norviksno"}, {"id": 3, "brand": "Other"}, {"id": 4, "brand": " "}, {"id": 5, "machine_type": "beam sawe"}, {"id": None, "brand": "Other"}, {"id": 6, "brand": "other"}], "field string, value string, ref_id string").rest()
    assert sorted(tuple(r) for r in QUERIES["p2_within"](spark, d).collect()) == [("brand", "Norviksno", 1, 1), ("type", "beam sawe", 1, 1)]
    assert sorted(tuple(r) for r in QUERIES["p2_unmatched"](spark, d).collect()) == [("brand", "Other", 1), ("brand", "other", 1)]


def test_all_of_several_entries_come_back():
    m = canonical.Matcher([(1, "Graver", None), (2, "Gravel", "Gravex"), (3, "Other", None)], "brand")
    assert m.reached("Gravez") == {1: 1, 2: 1} and m.match("Gravez") == 1 and m.reached("n/a") == {}
