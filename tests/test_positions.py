"""Position tables in their long form, and tables by their file's ending."""

import pytest

from twinfold.operators import positions
from twinfold.sources import records

ROWS = [  # history, layer, position, query, role, effect, token_text
    ("h1", 0, 4, "x", "old", 3.0, "a"), ("h1", 0, 4, "x", "old", 5.0, "a"), ("h1", 0, 4, "z", "new", 1.0, "b"),
    ("h1", 0, 5, "x", "old", 2.0, "c"), ("h1", 0, 5, "z", "old", 2.0, None),
    ("h1", 0, 6, "x", "other_position", 9.0, "d"), ("h2", 0, 4, "x", "old", 8.0, "e"), ("h2", 0, 4, "z", "other_position", 2.0, "b"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "history string, layer int, position int, query string, role string, effect double, token_text string")


def test_positions_are_paired_before_roles_are_split(rows):
    wide = positions.paired_positions(rows, ["history", "layer"], ("x", "z"))
    got = {(r.history, r.position): (r.effect_x, r.effect_z, r.difference, r.roles_x, r.roles_z) for r in wide.collect()}
    assert got == {("h1", 4): (4.0, 1.0, 3.0, ["old"], ["new"]), ("h1", 5): (2.0, 2.0, 0.0, ["old"], ["old"]), ("h1", 6): (9.0, None, None, ["other_position"], []), ("h2", 4): (8.0, 2.0, 6.0, ["old"], ["other_position"])}
    assert {(r.position, r["mean"], r.n) for r in positions.position_summary(wide, ["layer"]).collect()} == {(4, 4.5, 2), (5, 0.0, 1), (6, None, 0)}
    split = positions.split_roles(wide, ["history", "layer"], ("x", "z"))
    assert sorted((r.history, r.position, r.role) for r in split.collect()) == [("h1", 4, "new"), ("h1", 4, "old"), ("h1", 5, "old"), ("h2", 4, "old")]
    # h1's two old positions count as one history
    assert {(r.role, r["mean"], r["median"], r.n) for r in positions.by_role(split, "history", ["layer"]).collect()} == {("new", 3.0, 3.0, 1), ("old", 3.75, 3.75, 2)}
    assert {tuple(r) for r in positions.role_places(split, "history").collect()} == {("new", 1, 4, 4, 1), ("old", 2, 4, 5, 2)}


def test_legend(rows):
    got = {r.position: tuple(r)[1:] for r in positions.legend(rows, ("x", "z"), {"old": "assignment"}).collect()}
    assert got == {
        4: ("a | e", "b", "old", "new | other_position", "new | old", "assignment | rendered_text_unclassified"),
        5: ("c", None, "old", "old", "old", "assignment"),
        6: ("d", None, "other_position", None, "other_position", "rendered_text_unclassified"),
    }
    assert positions.legend(rows.limit(0), ("x", "z"), {}).count() == 0


def test_tables_by_ending(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b,\"c\"", None)], "id string, v double")
    path = str(tmp_path / "t.csv")
    records.write_csv(df, path)
    for read in (records.read_csv, records.read_by_suffix):
        assert sorted(map(tuple, read(spark, path, "id string, v double").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="exist"):
        records.write_csv(df, path)
    with pytest.raises(Exception):  # other columns than the schema's
        records.read_csv(spark, path, "v double, id string").collect()
    lines = str(tmp_path / "t.jsonl")
    records.write_jsonl(df, lines)
    assert records.read_by_suffix(spark, lines, "id string, v double").count() == 2


def test_update_control_by_hand(spark):
    from twinfold.operators import contrasts

    rows, base = [], {"superseded": 3.0, "other_updated": 2.0, "other_static": 0.5}
    for c, size in base.items():
        for ho in (0, 1):
            for co in (0, 1):
                for ev in "xz":
                    for qv in "xz":
                        rows.append(("h", c, ho, co, ev, qv, size * (2 if ho == co else 1) if ev == qv else 0.25))
    rows.append(("gap", "superseded", 0, 0, "x", "x", 1.0))
    got = {(r.h, r.order): r for r in contrasts.update_control(spark.createDataFrame(rows, "h string, c string, ho int, co int, ev string, qv string, e double"), "h", "c", "ho", "co", "ev", "qv", "e").collect()}
    for order, times in (("all", 1.5), ("aligned", 2.0), ("reversed", 1.0)):
        r = got["h", order]
        assert [r[f"R_{c}"] for c in base] == pytest.approx([v * times - 0.25 for v in base.values()])
        assert (r.superseded_minus_other_updated, r.other_updated_minus_other_static, r.superseded_minus_other_static) == pytest.approx((times, 1.5 * times, 2.5 * times))
    assert set(got) == {("h", "all"), ("h", "aligned"), ("h", "reversed"), ("gap", "all"), ("gap", "aligned")} and got["gap", "all"].R_superseded is None
