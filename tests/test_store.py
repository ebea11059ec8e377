"""Commits of the store: two writers, removals, themes and analyses together."""

import pytest

from tessera import store


def analysis(spark, *rows):
    return spark.createDataFrame([(i, f"https://e.com/{i}", None, None, t, None, 1.0, "{}", None) for i, t in rows], store.ANALYSES)


def themes(spark, *rows):
    return spark.createDataFrame([(i, n, b, False, None) for i, n, b in rows], store.THEMES)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = store.Store(spark, str(tmp_path / "s")), store.Store(spark, str(tmp_path / "s"))
    base = one.version()
    assert base == two.version() == -1
    assert one.save(analysis(spark, ("a", "t")), base) == 0
    with pytest.raises(store.Conflict):
        two.save(analysis(spark, ("b", "t")), base)
    assert ids(two.read("analyses")) == ["a"] and len(list((tmp_path / "s/data").iterdir())) == 2  # the refused parts are gone
    assert two.save(analysis(spark, ("b", "t")), two.version()) == 1
    assert ids(one.read("analyses")) == ["a", "b"] and ids(one.read("analyses", 0)) == ["a"]
    (tmp_path / "s/manifests/v2.json").write_text("{}")  # taken between the look and the write
    with pytest.raises(store.Conflict):
        one._create("manifests/v2.json", "{}")


def test_removal_hides_earlier_rows_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.save(analysis(spark, ("a", "t1"), ("b", "t1"), ("c", "t1")))
    s.delete(spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert ids(s.read("analyses")) == ["b", "c"]
    s.save(analysis(spark, ("a", "t2"), ("b", "t2")))
    assert {r.id: r.theme_id for r in s.read("analyses").collect()} == {"a": "t2", "b": "t2", "c": "t1"}
    s.write("analyses", analysis(spark, ("z", "t")))
    assert ids(s.read("analyses")) == ["z"]


def test_themes_and_analyses_change_together(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.commit(-1, {"themes": themes(spark, ("t1", "Dark", False), ("t2", "dark", False), ("t3", "Plain", True), ("t4", "Own", False)), "analyses": analysis(spark, ("a", "t1"), ("b", "t2"), ("c", "t3"), ("d", "t4"))})
    assert s.merge_themes() == 1
    assert ids(s.read("themes")) == ["t2", "t3", "t4"] and {r.id: r.theme_id for r in s.read("analyses").collect()} == {"a": "t2", "b": "t2", "c": "t3", "d": "t4"}
    assert {r.id: r.theme_id for r in s.read("analyses", 0).collect()}["a"] == "t1"  # one version tells one state
    s.update_themes(spark.createDataFrame([("t2", "Night", None), ("t3", "No", True), ("t4", None, True)], "id string, name string, archived boolean"))
    assert {(r.id, r.name, r.archived) for r in s.read("themes").collect()} == {("t2", "Night", False), ("t3", "Plain", False), ("t4", "Own", True)}
    assert [(r.id, r.analyses) for r in s.themes().collect()] == [("t3", 1), ("t2", 2)] and len(s.themes(archived=True).collect()) == 3
    s.delete_themes(spark.createDataFrame([("t2",), ("t3",)], "id string"))
    assert ids(s.read("themes")) == ["t3", "t4"] and {r.id: r.theme_id for r in s.read("analyses").collect()} == {"a": None, "b": None, "c": "t3", "d": "t4"}
