"""Zone operators over odd rows: nulls, repeats, ties, empty tables."""

from tallyspark.operators import profiles as P
from tallyspark.operators import worklists as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_zone_gaps_name_each_break(spark):
    links = spark.createDataFrame([("c1", "r", "a"), ("c1", "r", "a"), ("c2", "r", "a"), ("c1", "r", "b"), ("c1", "r", "c"), ("c1", "r", "d"), ("c1", "r", None)], "contest string, region string, zone string")
    panel = spark.createDataFrame([("a", 1.0), ("a", None), ("new b", 2.0), ("c", None), (None, 3.0)], "zone string, v double")
    aliases = spark.createDataFrame([("b", "new b"), ("d", "nowhere")], "source string, target string")
    found = W.zone_gaps(links, panel, aliases, "region", "zone", "contest", ["v"])
    assert {(r.zone, r.contests, r.reason, r.repair) for r in found.collect()} == {
        ("a", 2, "covered", "none"), ("b", 1, "alias_missing", "read as new b"), ("c", 1, "value_missing", "enter the values"),
        ("d", 1, "zone_not_in_panel", "add the zone or an alias of it"), (None, 1, "zone_not_in_panel", "add the zone or an alias of it"),
    }
    assert W.zone_gaps(links.limit(0), panel, aliases, "region", "zone", "contest", ["v"]).isEmpty()


def test_zone_areas_take_the_first_table_with_an_area(spark):
    kind = "region string, zone string, area string"
    first = spark.createDataFrame([("r", "a", "-1"), ("r", "b", "7"), ("r", "B", "5"), ("r", "c", "x"), ("r", "d", None)], kind)
    second = spark.createDataFrame([("r", "a", "3"), ("r", "b", "9"), ("q", "b", "1")], kind)
    moves = spark.createDataFrame([("R", "A", "new")], "region_key string, zone_key string, new_region string")
    assert rows(P.zone_areas([first, second], "region", "zone", "area", moves)) == [("NEW", "A", "new", "a", 3.0, 1), ("Q", "B", "q", "b", 1.0, 1), ("R", "B", "r", "B", 5.0, 0)]


def test_zone_composition_keeps_rows_of_whole_zones(spark):
    raw = spark.createDataFrame(
        [("1", "5", "000", "Total", 10.0, 4.0), ("1", "5", "7", "Total", 1.0, 1.0), ("1", "5", None, "Rural", 2.0, 1.0), ("1", "000", "", "Total", 99.0, 1.0), ("1", "6", "", " Total ", None, 1.0), ("1", "8", "0.0", "Total", 0.0, None), ("1", "9", "", "Total", 3.0, 3.0)],
        "s string, z string, t string, kind string, total double, g double",
    )
    names = spark.createDataFrame([("01", "005", "r", "five"), ("1", "6", "r", "six"), ("1", "8", "r", "eight"), ("1", "9", "r", " ")], "s string, z string, region string, zone string")
    found = P.zone_composition(raw, names, "s", "z", ["t"], "kind", "total", ["g"], "region", "zone")
    assert rows(found) == [("R", "EIGHT", "r", "eight", 0.0, None, None), ("R", "FIVE", "r", "five", 10.0, 4.0, 40.0)]


def test_code_crosswalk_methods(spark):
    codes = spark.createDataFrame([("r", k, 10.0) for k in (1, 2, 3, 4, 5)], "region string, code int, x double")
    names = spark.createDataFrame([("r", 10, "Alpha"), ("r", 20, "North Beta"), ("r", 30, "Gamma")], "region string, zone_code int, name string")
    known = spark.createDataFrame([("r", "ALPHA", 40.0), ("r", "Beta", None), ("r", "Delta", 11.0), ("r", None, 1.0)], "region string, name string, x double")
    matched = spark.createDataFrame([("r", 4, "Delta", 1.0)], "region string, code int, name string, cost double")
    found = {r.code: (r.name, r.method, r.cost, r.confidence) for r in W.code_crosswalk(codes, names, known, "region", ["x"], matched).collect()}
    assert found == {1: ("ALPHA", "rank_known", 30.0, "medium"), 2: ("Beta", "rank_contained", None, "medium"), 3: ("Gamma", "rank", None, "medium"), 4: ("Delta", "feature", 1.0, "high"), 5: (None, "unmapped", None, "low")}
    assert W.code_crosswalk(codes.limit(0), names, known, "region", ["x"]).isEmpty()


def test_profile_sections_of_unknown_facts(spark):
    kind = "contest string, region string, flipped boolean, prev_winner string, curr_winner string, margin double, swing_a double, swing_b double, turnout_prev double, turnout_curr double, turnout_change double, urban double, coverage double, quality string, zones_missing string"
    found = P.profile_sections(spark.createDataFrame([("c", *[None] * 14), ("k", "r", False, "x", "x", 2.5, 0.2, -3.5, 1.0, 7.0, None, 50.0, 0.5, "high", "z")], kind))
    none, some = [tuple(r) for r in found.orderBy("contest").collect()]
    assert none == ("c", "No winner is known.", "No change is known.", "No area data.", "No zone is linked.", "Nothing stands out.", "low", None, "")
    assert some[1:7] == ("r: held by x.", "a holds its share. b loses 4 points. Turnout rises.", "Mostly urban.", "Zones cover 50 percent. Without data: z.", "The margin is 3 points. Turnout moves.", "high")
