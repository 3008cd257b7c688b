"""Reports on hand-made tables."""

import pytest

from landfold.operators import reports


def test_rooms_of_a_building_with_and_without_a_text(spark):
    asks = spark.createDataFrame([(1, "b", "LIFT"), (2, "b", " "), (3, "c", "lift"), (4, "b", None)], "ask_id bigint, building string, text string")
    index = spark.createDataFrame([("r1", "b", "Lift lobby", None), ("r2", "b", "101", "lift"), ("r3", "b", "102", "office"), ("r4", "x", "Lift", "lift")], "room_id string, building string, name string, type string")
    drawn = spark.createDataFrame([("r1", "b", "Lift lobby", True), ("r3", "b", "102", False), ("r5", "b", "103", None)], "room_id string, building string, name string, interactive boolean")
    got = sorted((r.ask_id, r.room_id, r.from_index) for r in reports.search_rooms(asks, index, drawn).collect())
    assert got == [(1, "r1", True), (1, "r2", True), (2, "r1", False), (2, "r5", False), (4, "r1", False), (4, "r5", False)]


def test_services_that_stand_for_themselves(spark):
    cols = "entity_id string, type string, parent_id string"
    services = spark.createDataFrame([("a", "facility", "p"), ("b", "facility", "p"), ("c", "facility", None), ("d", "facility", "p")], cols)
    entities = spark.createDataFrame([("a", "facility", "p"), ("b", "space", "q"), ("c", "facility", None)], cols)
    uses = {"has-domain": spark.createDataFrame([("a",), ("a",), ("z",)], "entity_id string"), "has-relation": spark.createDataFrame([("c",)], "entity_id string")}
    got = sorted((r.entity_id, r.rule, r.n) for r in reports.negative_bindings(services, entities, uses).collect())
    assert got == [("a", "has-domain", 2), ("b", "wrong-parent", 1), ("b", "wrong-type", 1), ("c", "has-relation", 1), ("d", "unknown", 1)]


def test_works_are_bound_nowhere(spark):
    works = spark.createDataFrame([("w1",), ("w2",)], "id string")
    docs = spark.createDataFrame([("f", '{"x":[{"ownerId" : "w1"},{"y":{"entityId":"w1"}}],"note":"w2"}'), ("g", '{"ownerId":"other"}'), ("h", None)], "name string, doc string")
    got = reports.construction_bindings(works, docs, ["ownerId", "entityId"], {"rep": spark.createDataFrame([("w2",), ("o",)], "id string")})
    assert sorted((r.id, r.place, r.n) for r in got.collect()) == [("w1", "f", 2), ("w2", "rep", 1)]


def test_gaps_of_an_inventory(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id bigint")
    got = {r["class"]: r for r in reports.inventory_report(ids(1, 2, 3, 4), [("a", ids(1, 2)), ("b", ids(2, 3))], ids(1, 3), ids(1, 2, 9), most=1).collect()}
    assert {k: (r.entries, r.picked, r.gap, r.unregistered, r.first_missing, r.shown) for k, r in got.items()} == {
        "a": (2, 1, 1, 0, 2, 1), "b": (1, 1, 0, 1, None, 0), "unclassified": (1, 0, 1, 1, 4, 1), "registry-only": (1, 0, 1, 0, 9, 1)}


def test_positions_through_a_fit(spark):
    controls = spark.createDataFrame([(1, x, y, 2 * x + 5, 3 * y - 1) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (4.0, 4.0))] + [(2, 1.0, 1.0, 1.0, 1.0)], "sheet bigint, x double, y double, e double, n double")
    pois = spark.createDataFrame([(1, 1, 1.0, 2.0), (2, 1, 2.0, 2.0), (3, 2, 1.0, 1.0), (4, 9, None, None)], "id bigint, sheet bigint, x double, y double")
    outlines = spark.createDataFrame([(2, 9.0, 9.0)], "id bigint, e double, n double")
    got = {r.id: r for r in reports.consolidate_pois(pois, controls, outlines, 0.5).collect()}
    assert (got[1].source, got[1].e, got[1].n, got[1].caution) == ("map-estimate", pytest.approx(7.0), pytest.approx(5.0), None)
    assert (got[2].source, got[2].e, got[2].apart) == ("official-outline", 9.0, pytest.approx(4.0)) and got[3].source == got[4].source == "unresolved"


def test_names_per_locale(spark):
    entities = spark.createDataFrame([("e1", "图书馆", ["Library"]), ("e2", "Hall", []), ("e3", "图书馆", []), ("e4", " ", [])], "entity_id string, name string, aliases array<string>")
    messages = spark.createDataFrame([("en", "k"), ("zh-Hant", "k"), ("zh-Hans", "k"), ("en", "only")], "locale string, key string")
    got = {(r.rule, r.locale, r.key) for r in reports.locale_report(entities, messages).collect()}
    assert {("han-in-english", "en", "e3"), ("no-han", "zh-Hans", "e2"), ("empty-name", "en", "e4"), ("search-misses", "en", "e4"), ("shared-name", "zh-Hans", "图书馆"), ("key-missing", "zh-Hans", "only"), ("key-missing", "zh-Hant", "only")} <= got
    assert not any(rule == "key-missing" and key == "k" for rule, _, key in got) and ("han-in-english", "en", "e1") not in got
