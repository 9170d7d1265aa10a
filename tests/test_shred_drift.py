import json

from ledgerloom.operators import drift, shred


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def children(spark, texts):
    df = spark.createDataFrame([(str(n), t, "x") for n, t in enumerate(texts)], "id string, raw string, node string")
    return [r[1:4] for r in rows(shred.child_objects(shred.shred(df, "t", "id", "raw")))]


def test_child_rows_with_positions_and_lone_objects(spark):
    one = {"a": [{"b": [{"c": 1}, None, {"c": 2}]}, None, {"b": {"c": 3}}]}
    got = children(spark, [json.dumps(one)])
    assert got == [("0", "a", "1"), ("0", "a", "3"), ("0", "a.b", "1.1"), ("0", "a.b", "1.3"), ("0", "a.b", "3.1")]


def test_unusable_texts_and_wrapped_payloads(spark):
    good = {"a": [{"x": 1}]}
    texts = [None, "", "  ", "{", '{"a": [{}', "NaN", "3", '"text"', "[]", json.dumps(json.dumps(good)), json.dumps([{"k": 1}])]
    assert children(spark, texts) == [("10", "", "1"), ("9", "a", "1")]


def test_deep_nesting_and_long_text(spark):
    deep = "[" * 400 + "{}" + "]" * 400
    got = children(spark, ['{"a": ' + deep + "}", json.dumps({"a": [{"t": "y" * 300_000}]})])
    assert ("0", "a", ".".join(["1"] * 400)) in got
    assert ("1", "a", "1") in got


def test_empty_table_and_entity_table(spark):
    empty = spark.createDataFrame([], "id string, raw string")
    assert shred.child_objects(shred.shred(empty, "t", "id", "raw")).count() == 0
    df = spark.createDataFrame([("1", json.dumps({"p": [{"n": {"id": 5}, "w": True}, {"w": None}]}))], "id string, raw string")
    got = shred.entity_table(shred.shred(df, "t", "id", "raw"), "p", {"pid": "n.id", "w": "w"}).select("pid", "w")
    assert sorted(got.collect(), key=str) == sorted([("5", "true"), (None, None)], key=str)


BATCH = "stream_name string, file_name string, file_seq int, received_at timestamp, line_no int, record_json string"


def batches(spark, files):
    data = [("s", f"f{n}", n, None, k, json.dumps(r) if isinstance(r, dict) else r) for n, f in enumerate(files) for k, r in enumerate(f)]
    return spark.createDataFrame(data, BATCH)


def test_changes_between_files(spark):
    first = [{"filing_id": k, "ein": f"00{k}", "amt": 1000 + k, "gone": "x", "kept": None} for k in range(6)]
    second = [{"filing_id": k, "EIN": k, "AmtTotal": f"${1000 + k:,}.00" if k else "$9.00", "added": k, "kept": None} for k in range(6)]
    got = rows(drift.changes(batches(spark, [first, [*second, second[0], "no json", "[]", None]])).select("file_name", "change_kind", "old_name", "new_name"))
    assert got == [
        ("f1", "added", "", "added"),
        ("f1", "removed", "gone", ""),
        ("f1", "renamed", "amt", "AmtTotal"),
        ("f1", "renamed", "ein", "EIN"),
        ("f1", "retyped", "AmtTotal", "AmtTotal"),
        ("f1", "retyped", "EIN", "EIN"),
    ]


def test_typed_table_and_failed_casts(spark):
    first = [{"filing_id": k, "tax_year": 2020 + k, "ein": f"00{k}"} for k in range(3)]
    second = [{"filing_id": k, "year_of_return": [2020 + k] if k else "abc", "ein": f"00{k}"} for k in range(3)]
    b = batches(spark, [first, second])
    got = {(r.file_name, r.filing_id): (r.tax_year, r.ein) for r in drift.consistent(b).collect()}
    assert got[("f1", 2)] == (2022, "000000002") and got[("f1", 0)][0] is None
    bad = drift.failed_casts(b).collect()
    assert [(r.key, r.n, r.example) for r in bad] == [("year_of_return", 1, "abc")]


def test_no_files(spark):
    assert drift.changes(spark.createDataFrame([], BATCH)).count() == 0
