import random

from pyspark.sql import functions as F

from sitetable.operators import metrics as M
from sitetable.operators import tables as K
from sitetable.operators.chunks import changes, running_total
from sitetable.schemas import TABLES, conform


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_changes_equal_one_ordered_pass_for_any_chunk(spark):
    rng = random.Random(3)
    # one key holds most rows; values repeat, some are null, so are some keys
    rows = [(None if rng.random() < .05 else "hot" if rng.random() < .7 else f"k{rng.randrange(4)}", i,
             rng.choice(["a", "b", None])) for i in range(400)]
    expected, state = [], {}
    for key, i, value in rows:
        first = key not in state
        previous, n = state.get(key, (None, 0))
        changed = not first and previous != value
        state[key] = (value, n + changed)
        expected.append((i, previous, changed, n + changed))
    df = spark.createDataFrame(rows, "k string, i int, v string")
    for width in (1, 7, 1000):
        got = changes(df, ["k"], ["i"], "v", F.floor(F.col("i") / width)).orderBy("i")
        assert [tuple(r) for r in got.select("i", "previous", "changed", "change_no").collect()] == expected


def test_running_total(spark):
    df = spark.range(1, 200).select(((F.col("id") * 37) % 199).alias("k"), F.col("id").alias("n"))
    got = rows_of(running_total(df, ["k"], "n", "upto", slices=5), "k", "upto")
    total, expected = 0, []
    for k, n in sorted((r["k"], r["n"]) for r in df.collect()):
        total += n
        expected.append((k, total))
    assert got == expected


def test_upsert_keeps_identity_and_is_stable(spark):
    target = spark.createDataFrame([("1", "s", "ann", "old", "password"), ("2", "s", "bob", "old", "password")],
                                   "id string, site_id string, username string, secret string, kind string")
    updates = spark.createDataFrame([("9", "s", "ann", "new1", "token", 1), ("8", "s", "ann", "new2", "token", 2),
                                     ("7", "s", "cy", "new", "token", 1)],
                                    "id string, site_id string, username string, secret string, kind string, n int")
    once = K.upsert(target, updates, ["site_id", "username"], ["secret", "kind"], ["n"])
    assert rows_of(once, "id", "username", "secret", "kind") == [
        ("1", "ann", "new2", "token"), ("2", "bob", "old", "password"), ("7", "cy", "new", "token")]
    twice = K.upsert(once, updates, ["site_id", "username"], ["secret", "kind"], ["n"])
    assert rows_of(once, *once.columns) == rows_of(twice, *once.columns)


def test_upsert_with_null_update_values(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    updates = spark.createDataFrame([(1, None), (None, "n")], "k int, v string")
    assert sorted(K.upsert(target, updates, ["k"], ["v"]).collect(), key=str) == sorted(
        [(1, None), (None, "n")], key=str)


def test_get_or_create_keeps_the_existing_row(spark):
    sites = spark.createDataFrame([("1", "https://a", "kept")], "id string, origin string, name string")
    new = spark.createDataFrame([("2", "https://a", "x"), ("3", "https://b", "y"), ("4", "https://b", "z")], sites.schema)
    assert rows_of(K.get_or_create(sites, new, ["origin"], ["id"]), "id", "origin", "name") == [
        ("1", "https://a", "kept"), ("3", "https://b", "y")]


def site_tables(spark):
    return {
        "sites": spark.createDataFrame([("s1", "o1"), ("s2", "o2")], "id string, origin string"),
        "pages": spark.createDataFrame([("p1", "s1", "u", "list"), ("p2", "s2", "u", "list")],
                                       "id string, site_id string, url string, page_type string"),
        "elements": spark.createDataFrame([("e1", "p1"), ("e2", "p2")], "id string, page_id string"),
        "trajectories": spark.createDataFrame([("t1", "p1", "success"), ("t2", "p2", "failed")],
                                              "id string, page_id string, status string"),
        "action_steps": spark.createDataFrame([("a1", "t1", 0, "click"), ("a2", "t2", 0, "click")],
                                              "id string, trajectory_id string, step_index int, action_type string"),
        "annotation_tasks": spark.createDataFrame([("n1", "p1", "t1", "x"), ("n2", "p2", None, "x"), ("n3", None, None, "x")],
                                                  "id string, page_id string, trajectory_id string, annotation_type string"),
        "training_records": spark.createDataFrame([("r1", "t1", "sft"), ("r2", "t2", "sft")],
                                                  "id string, trajectory_id string, data_type string"),
    }


def test_delete_cascade(spark):
    tables = site_tables(spark)
    left = K.delete_cascade(tables, "sites", spark.createDataFrame([("s1",)], "id string"))
    ids = {name: [r["id"] for r in df.orderBy("id").collect()] for name, df in left.items()}
    assert ids == {"sites": ["s2"], "pages": ["p2"], "elements": ["e2"], "trajectories": ["t2"],
                   "action_steps": ["a2"], "annotation_tasks": ["n1", "n2", "n3"], "training_records": ["r1", "r2"]}
    links = {r["id"]: (r["page_id"], r["trajectory_id"]) for r in left["annotation_tasks"].collect()}
    assert links == {"n1": (None, None), "n2": ("p2", None), "n3": (None, None)}
    assert {r["id"]: r["trajectory_id"] for r in left["training_records"].collect()} == {"r1": None, "r2": "t2"}


def test_violations(spark):
    tables = site_tables(spark)
    del tables["training_records"]
    assert K.violations(tables).count() == 0
    tables["sites"] = tables["sites"].filter("id = 's1'").unionByName(
        spark.createDataFrame([("s1", "o1"), ("s3", None)], "id string, origin string"))
    tables["pages"] = tables["pages"].withColumn("page_type", F.lit("odd"))
    found = {(r["table_name"], r["rule"], r["column_name"], r["key"], r["n_rows"])
             for r in K.violations(tables).collect()}
    assert found == {("sites", "required", "origin", None, 1), ("sites", "unique", "id", "s1", 2),
                     ("sites", "unique", "origin", "o1", 2), ("pages", "domain", "page_type", "odd", 2),
                     ("pages", "reference", "site_id", "s2", 1)}


def test_conform_fills_defaults(spark):
    row = conform(spark.createDataFrame([("r", "sft")], "id string, data_type string"), "training_records").first()
    assert row["split"] == "train" and row["exported"] is False and row["reward"] is None
    for name, spec in TABLES.items():
        assert set(spec.required) <= set(spec.schema.names), name


def test_spearman_with_ties(spark):
    rng = random.Random(5)
    data = [(rng.randrange(6) / 2, rng.randrange(9)) for _ in range(150)] + [(None, 1), (1.0, None)]

    def ranks(values):
        order = sorted(values)
        return [(order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in values]
    known = [(x, y) for x, y in data if x is not None and y is not None]
    rx, ry = ranks([x for x, _ in known]), ranks([y for _, y in known])
    n, mx, my = len(known), sum(rx) / len(rx), sum(ry) / len(ry)
    cov = sum((a - mx) * (b - my) for a, b in zip(rx, ry, strict=True))
    rho = cov / (sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry)) ** .5
    got = M.spearman(spark.createDataFrame(data, "x double, y int"), "x", "y").first()
    assert got["n_rows"] == n and abs(got["rho"] - rho) < 1e-9
    assert M.spearman(spark.createDataFrame([(1.0, 2)] * 3, "x double, y int"), "x", "y").first()["rho"] is None


def test_fidelity_counts_copies_and_nulls(spark):
    source = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, v string")
    target = spark.createDataFrame([(1, "a"), (2, ""), (3, "c"), (4, "d")], "k int, v string")
    got = M.fidelity(source, target).first()
    assert (got["n_source"], got["n_target"], got["n_matched"]) == (4, 4, 2)


def test_role_scores(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "predicted string, actual string")
    got = {r["role"]: (r["precision"], r["recall"], round(r["f1"], 4)) for r in M.role_scores(pairs).collect()}
    assert got == {"a": (0.5, 1.0, 0.6667), "b": (1.0, 1 / 3, 0.5), "c": (0.0, 0.0, 0.0)}


def test_most_similar(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])],
                                    "id int, embedding array<float>")
    rows = M.most_similar(vectors, [2.0, 0.0], 2).collect()
    assert [r["id"] for r in rows] == [1, 2] and abs(rows[1]["similarity"] - 0.6) < 1e-6
