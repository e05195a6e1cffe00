"""Submission bodies as VARIANT: the accepted items of the text reader, and rejects with the
types they were sent in."""

import json

from cinelytics.operators import ratings as rt

BODIES = [
    '[{"movieid":1,"rating":3},{"movieid":"7","rating":"5"}]', "[]", "not json", None, "", '{"movieid":1}', '[{"movieid":1,"rating":',
    '[{"movieid":0,"rating":3},{"movieid":"0","rating":3},{"movieid":"","rating":3},{"movieid":null,"rating":3},{"rating":3}]',
    '[{"movieid":5,"rating":0},{"movieid":5,"rating":6},{"movieid":5,"rating":"x"},{"movieid":5},{"movieid":5,"rating":null}]',
    '[{"movieid":5,"rating":4.7},{"movieid":"12abc","rating":1},{"movieid":"abc","rating":1}]',
    '[{"movieid":{"id":3},"rating":3},{"movieid":[4],"rating":{"stars":4}},5,"x",null]',
    '  [{"movieid":8,"rating":2,"note":{"deep":[1,{"a":null}]}}]',
]


def test_accepted_items_are_those_of_the_text_reader(spark):
    subs = spark.createDataFrame(list(enumerate(BODIES)), "submission_id int, selecteddata string")
    items = rt.validate_json_items(rt.variant_items(subs))
    got = sorted(map(tuple, items.where("accepted").select("submission_id", "pos", "movieid", "rating").collect()))
    assert got == sorted(map(tuple, rt.valid_submissions(subs).select("submission_id", "pos", "movieid", "rating").collect())) and len(got) > 4
    status = {r[0]: r[1] for r in items.select("submission_id", "parse_status").collect()}
    assert status == {r[0]: r[1] for r in rt.parse_json_ratings(subs).select("submission_id", "parse_status").collect()}


def test_rejects_keep_types_and_nested_values(spark):
    subs = spark.createDataFrame(list(enumerate(BODIES)), "submission_id int, selecteddata string")
    rejects = rt.rejected_items(subs).selectExpr("submission_id", "pos", "to_json(item) AS item", "movieid_type", "rating_type", "reason").collect()
    by = {(r["submission_id"], r["pos"]): r for r in rejects}
    for (i, pos), r in by.items():
        assert json.loads(r["item"]) == json.loads(BODIES[i])[pos]
    assert [by[7, p]["movieid_type"] for p in (0, 2, 3, 4)] == ["number", "string", "null", "missing"]
    assert all(by[7, p]["reason"] == "movieid" for p in (0, 2, 3, 4)) and (7, 1) not in by
    assert [by[8, p]["rating_type"] for p in range(5)] == ["number", "number", "string", "missing", "null"]
    assert all(by[8, p]["reason"] == "rating" for p in range(5))
    assert (by[10, 0]["movieid_type"], by[10, 1]["movieid_type"], by[10, 1]["rating_type"]) == ("object", "array", "object")
    assert [by[10, p]["movieid_type"] for p in (2, 3, 4)] == ["missing"] * 3
    assert (11, 0) not in by and (9, 2) in by
