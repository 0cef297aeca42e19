from graphloom.operators import fixes


def test_fix_plan(spark):
    rows = [("1", "unused-export", "a.ts#x", "high"), ("2", "unused-file", "a.ts", "low"), ("3", "cycle", "c.ts -> d.ts", "high"), ("4", "odd", "b.ts", "high"), ("5", "unused-file", "z.ts", "high"), ("6", "unused-file", None, None)]
    found = spark.createDataFrame(rows, "id string, code string, subject string, confidence string")
    got = {r["finding_id"]: r for r in fixes.fix_actions(fixes.named(found, ["a.ts", "c.ts", "4"])).collect()}
    assert sorted(got) == ["1", "2", "3", "4"]
    assert (got["1"]["id"], got["1"]["action"], got["1"]["risk"]) == ("fix-1", "delete-export", "low")
    assert [tuple(s) for s in got["1"]["steps"]] == [("Remove the unused export from `a.ts#x`.", "a.ts", "edit")]
    assert [s["change"] for s in got["3"]["steps"]] == [None, "refactor"]
    assert got["4"]["action"] is None and got["4"]["steps"] == []
    assert fixes.named(found, []).count() == 0
