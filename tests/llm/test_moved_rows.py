"""Rows that no join can concern stay where they are."""
import pytest
from pyspark.sql import functions as F

from sitetable.llm import secret_owners, weighted_minhash
from sitetable.llm.common import Scratch, marked


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast, as those of a large corpus are."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def places(docs, skip):
    """The partitions that hold the rows of each 50 ids, those of ``skip`` aside."""
    found = {}
    for r in docs.select("doc_id", F.spark_partition_id().alias("at")).collect():
        if r["doc_id"] not in skip:
            found.setdefault(r["doc_id"] // 50, set()).add(r["at"])
    return [found[i] for i in range(8)]


def sliced(spark, special):
    """400 documents in 8 partitions of 50; the last of each has the text ``special``, all others one of their own."""
    own = "concat_ws(' ', transform(sequence(1, 30), x -> concat('w', id * 31 + x)))"
    return spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", f"IF(id % 50 = 49, {special}, {own}) AS text", "'a' AS source")


def test_marks_miss_no_key(spark):
    rows = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, NULL, id) AS own")
    keys = rows.filter("id % 7 = 0")
    told = {r["id"]: r["_marked"] for r in marked(rows, [F.col("id"), F.col("own")], keys, Scratch(spark, "marks"), "few").collect()}
    assert len(told) == 20_000 and all(told[i] for i in range(0, 20_000, 7))
    assert sum(told.values()) < 1.3 * 20_000 / 7
    none = marked(rows, [F.col("id"), F.col("own")], keys.limit(0), Scratch(spark, "marks"), "none")
    assert none.filter("_marked").count() == 0 and none.count() == 20_000


def test_documents_without_a_copy_are_not_moved(large):
    docs = sliced(large, "'the same ten words stand in each of these few texts'")
    copies = set(range(49, 400, 50))
    again = docs.union(docs.filter("doc_id = 60"))  # a row that comes twice stays once
    for table in (docs, again):
        assert sorted(r["doc_id"] for r in weighted_minhash.unique(table).collect()) == sorted(set(range(400)) - copies | {49})
    assert places(weighted_minhash.unique(docs), copies) == [{i} for i in range(8)]


def test_documents_without_a_secret_are_not_moved(large):
    secret = "concat('password = Zx9Qw7Er5Ty3Ui1Op', id, ' end')"
    docs = sliced(large, secret).withColumn("text", F.expr("IF(doc_id = 3, NULL, text)"))
    found, before = secret_owners.mask(docs), {r["doc_id"]: r["text"] for r in docs.collect()}
    holders = set(range(49, 400, 50))
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    assert len(got) == 400 and got[3] is None
    assert all(got[i] == before[i] for i in set(range(400)) - holders) and all(got[i].endswith("[SECRET] end") for i in holders)
    assert places(found, holders) == [{i} for i in range(8)]
