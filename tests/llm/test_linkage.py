from tallyforge.llm import boilerplate, linkage, product_code
from tallyforge.llm.queries import QUERIES


def test_classes_keep_listings_without_a_site(spark, data):
    rows = [{"id": k, "website_id": site, "model": "QX 4410"} for k, site in enumerate([1, 1, 2, None, None])] + [{"id": 9, "website_id": None, "model": "AB 999"}]
    d = data.put("machines", rows).rest()
    assert sorted(tuple(r) for r in QUERIES["p6_found"](spark, d).collect()) == [(0, 2), (1, 2)]
    assert {r.id: r.n_links for r in QUERIES["p6_classes"](spark, d).collect()} == {0: 1, 1: 1, 2: 2, 3: 0, 4: 0, 9: 0}


def test_titles_below_the_second_main_line():
    text = "Built in 2001, commissioned a few months later in Norbury.\nThe spindle was overhauled in 2015 by the maker.\nNorvikson QX 4410 Panel Saw\nTooling also fits the Norvikson QA 1001."
    main = [s for _, s, bad in boilerplate.classify([text])[0] if not bad]
    assert len(main) == 4
    assert linkage.stated_codes([None, None], [None, None], [text, text.replace(main[2], "Panel Saw")]) == [("QX", "4410", ""), None]
    assert product_code.title_code(main) == "QX4410" and product_code.title_code([main[0], main[1], main[3]]) == ""


def test_evidence_decides_beyond_the_code(spark, data):
    """A mistyped code, one code of two makers, and two spellings of a maker outside the list beside a bigger one."""
    text = "Panel Saw\nWeight: {} kg\nDrive: {} kW"
    machines = []
    for k in range(240):  # products whose listings agree, two sites each
        for site in (1, 2):
            machines.append({"id": 10 * k + site, "website_id": site, "brand": ["Norvikson", "Haller & Sons", "Müllerbach"][k % 3], "model": f"QX {10_000 + 137 * k}", "machine_type": ["Panel Saw", "Turret Punch"][k % 2], "description": text.format(1000 + 61 * (k * 7 % 240), 5 + k * 11 % 240)})
    one = {"brand": "Norvikson", "machine_type": "Panel Saw", "description": text.format(4321, 77)}
    machines += [{"id": 9001, "website_id": 1, "model": "QX 88881", **one}, {"id": 9002, "website_id": 2, "model": "QX 88881", **one}, {"id": 9003, "website_id": 3, "model": "QX 88871", **one}]
    machines += [{"id": 9004, "website_id": 3, "brand": "Norvikson", "machine_type": "Panel Saw", "model": "QX 88891", "description": text.format(1500, 9)}]  # a neighbour of the code, another machine
    machines += [{"id": 9011, "website_id": 1, "brand": "Norvikson", "model": "AB 500", "machine_type": "Panel Saw", "description": text.format(900, 4)}, {"id": 9012, "website_id": 2, "brand": "Haller & Sons", "model": "AB 500", "machine_type": "Turret Punch", "description": text.format(2900, 44)}]
    machines += [{"id": 9020 + k, "website_id": k, "brand": "Bergstadler", "model": "CD 700", "machine_type": "Panel Saw"} for k in range(4)]
    machines += [{"id": 9031, "website_id": 5, "brand": "Fjordqvist", "model": "CD 700", "machine_type": "Turret Punch"}, {"id": 9032, "website_id": 6, "brand": "Fjordqvits", "model": "CD 700", "machine_type": "Turret Punch"}]
    d = data.put("machines", machines).rest()
    got = {tuple(r) for r in QUERIES["p6_found"](spark, d).collect()}
    assert {(10 * k + 1, 10 * k + 2) for k in range(240)} <= got
    beyond = {p for p in got if p[1] > 9000}
    assert {(9001, 9002), (9001, 9003), (9002, 9003)} <= beyond  # code equality would lose the mistyped one
    assert not {p for p in beyond if 9004 in p} and (9011, 9012) not in beyond  # and would join two makers
    assert (9031, 9032) in beyond and not {p for p in beyond if p[0] in range(9020, 9024) and p[1] in (9031, 9032)}


def test_weights_come_from_counts():
    u = linkage.chance([((0, 0, 0, 0), 900), ((2, 0, 0, 0), 20), ((0, 2, 1, 1), 30)])
    assert u[0][2] < 0.03 and abs(u[2][0] + u[2][2] - 1) < 1e-9
    weights, prior = linkage.expectation_maximisation([("code", (2, 2, 2, 2), 500), ("code", (0, 0, 0, 0), 20), ("near", (1, 0, 0, 0), 300), ("near", (1, 2, 2, 2), 3)], u)
    assert all(w[2] > 0 > w[0] and w[1] == 0 for w in weights) and prior["code"] > 0 > prior["near"]


def test_every_two_signatures_of_a_block_are_compared(spark, data):
    """Two rare spellings, and two rare neighbouring codes, beside a frequent one that is like neither; no maker beside two makers of the list."""
    text = "Panel Saw\nWeight: {} kg\nDrive: {} kW"
    machines = []
    for k in range(240):
        for site in (1, 2):
            machines.append({"id": 10 * k + site, "website_id": site, "brand": ["Norvikson", "Haller & Sons", "Müllerbach"][k % 3], "model": f"QX {10_000 + 137 * k}", "machine_type": ["Panel Saw", "Turret Punch"][k % 2], "description": text.format(1000 + 61 * (k * 7 % 240), 5 + k * 11 % 240)})
    machines += [{"id": 9000 + k, "website_id": k, "brand": "Bergstadler", "model": "CD 700", "machine_type": "Panel Saw"} for k in range(4)]
    # begin and end unlike, three edits apart
    machines += [{"id": 9011, "website_id": 5, "brand": "Fjordqvist", "model": "CD 700", "machine_type": "Turret Punch"}, {"id": 9012, "website_id": 6, "brand": "Jfordqvisz", "model": "CD 700", "machine_type": "Turret Punch"}]
    # 77711, 77712 and 77713 share a key and the most frequent of them is another machine
    machines += [{"id": 9020 + k, "website_id": k, "brand": "Norvikson", "model": "QX 77711", "machine_type": "Turret Punch", "description": text.format(90, 1)} for k in range(4)]
    one = {"brand": "Norvikson", "machine_type": "Panel Saw", "description": text.format(4321, 77)}
    machines += [{"id": 9031, "website_id": 1, "model": "QX 77712", **one}, {"id": 9032, "website_id": 2, "model": "QX 77713", **one}]
    same = {"model": "AB 500", "machine_type": "Panel Saw", "description": text.format(640, 31)}
    machines += [{"id": 9041, "website_id": 1, "brand": "Norvikson", **same}, {"id": 9042, "website_id": 2, **same}, {"id": 9043, "website_id": 3, "brand": "Haller & Sons", **same}, {"id": 9044, "website_id": 4, "brand": "Norvikson", **same}]
    d = data.put("machines", machines).rest()
    beyond = {p for p in (tuple(r) for r in QUERIES["p6_found"](spark, d).collect()) if p[1] > 9000}
    assert (9011, 9012) in beyond and (9031, 9032) in beyond
    assert not {p for p in beyond if (p[0] < 9010) != (p[1] < 9010) or (p[0] < 9030) != (p[1] < 9030)}
    assert {p for p in beyond if p[0] > 9040} == {(9041, 9042), (9041, 9044), (9042, 9044)}
