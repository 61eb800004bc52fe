"""Forests grown from summed cells equal those grown from rows."""

from hearsay.operators import trees as T


def test_cells_and_rows_grow_the_same_forest(spark, monkeypatch):
    rows = [(i, f"g{i % 2}", float(i * 7 % 3), float(i * 5 % 11), float(i * 3 % 4) if i % 9 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, g string, y double, a double, b double")
    levels = []
    found = T._cells_at_nodes
    monkeypatch.setattr(T, "_cells_at_nodes", lambda *a: levels.append(1) or found(*a))

    def grown():
        forest = T.grow_forest(df, ["a", "b"], "y", ["g"], "id", trees=3, depth=2, classes=[0.0, 1.0, 2.0], subset=1)
        return sorted(map(str, forest.groups.collect()))

    by_cells = grown()
    assert len(levels) == 2
    monkeypatch.setattr(T, "MEETING", 10_000)
    assert grown() == by_cells and len(levels) == 2
