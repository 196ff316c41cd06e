"""Cases that once lost rows or failed."""

from pyspark.sql import functions as F

from sitetable.functions.text import in_share
from sitetable.operators import pages as P
from sitetable.operators import tables, training


def _records(spark):
    rows = spark.range(5).select(
        F.lit("sft").alias("data_type"), F.concat(F.lit("t"), "id").alias("trajectory_id"),
        F.parse_json(F.lit('{"a":1}')).alias("input_payload"), F.parse_json(F.lit('{"b":2}')).alias("output_payload"),
        F.lit("train").alias("split"))
    return training.create_records(rows)


def test_same_export_twice_writes_the_same_lines(spark, tmp_path):
    records = _records(spark)
    records = spark.createDataFrame(records.collect(), records.schema)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    for _ in range(2):
        counts = training.export_records(records, out, ledger, export_id="one").collect()
        assert [r["n_records"] for r in counts] == [5]
        assert training.load_exported(spark, out).count() == 5
        assert training.read_ledger(spark, ledger).count() == 5
    assert training.export_records(records, out, ledger, export_id="two").collect() == []


def test_split_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, "train"), ("a", None), (None, None), ("b", "val"), ("c", "train")], "id string, split string")
    for method in ("ordinal", "hash"):
        train, val = training.split_train_val(rows, 0.4, method)
        assert sorted(map(str, train.union(val).collect())) == sorted(map(str, rows.collect()))
    assert rows.filter(in_share("id", 0.5)).count() + rows.filter(~in_share("id", 0.5)).count() == 5


def test_repeated_headers_keep_their_cells(pages_of):
    html = "<table><tr><th>P</th><th>P</th><th>P_2</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
    fields = P.table_rows(pages_of(html)).first()["fields"]
    assert fields["P"] == "1" and fields["P_2"] == "2" and sorted(fields.values()) == ["1", "2", "3"]


def test_upsert_with_dotted_names(spark):
    target = spark.createDataFrame([(1, 2.0, "x")], "`a.id` int, `unit.price` double, note string")
    updates = spark.createDataFrame([(1, 3.0, 1), (1, 4.0, 2), (2, 5.0, 1)], "`a.id` int, `unit.price` double, `o.n` int")
    rows = tables.upsert(target, updates, ["a.id"], ["unit.price"], order=["o.n"]).orderBy("`a.id`").collect()
    assert [tuple(r) for r in rows] == [(1, 4.0, "x"), (2, 5.0, None)]
