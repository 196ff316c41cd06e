import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitetable.functions import pii

PY = {name: re.compile(p) for name, p in pii.PATTERNS.items()}


def brute_redact(text, placeholder="[REDACTED]"):
    for pattern in PY.values():
        text = pattern.sub(lambda _: placeholder, text)
    return text


def brute_find(text):
    return {n: p.findall(text) for n, p in PY.items() if p.findall(text)}


SAMPLES = [
    "write to jo.doe+x@mail.example.com now", "call +1-800-555-1234 or 0171 555 0000", "id 11010519491231002X ok",
    "card 4111 1111 1111 1111 and 4737097684299439 éeau", "host 10.0.0.1, 999.999.999.999", "on 2024-03-05 at noon",
    "nothing personal", "", "élan@x.com", "a@b.c|d", "1234567890123456789012345", "(555) 123-4567)8", "x" * 50,
    "٠١٢٣٤٥٦٧٨٩٠١", "tel 1234567890", "$1 \\ 12345678901",
]


def run(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_redaction_matches_python(spark):
    assert run(spark, pii.redact("t"), SAMPLES) == [brute_redact(t) for t in SAMPLES]


def test_find_matches_python(spark):
    assert run(spark, pii.find_pii("t"), SAMPLES) == [brute_find(t) for t in SAMPLES]


def test_contains_matches_python(spark):
    assert run(spark, pii.contains_pii("t"), SAMPLES) == [bool(brute_find(t)) for t in SAMPLES]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789 -()+.@abcXx|é\n", max_size=60), min_size=40, max_size=80))
def test_redaction_of_random_texts(spark, texts):
    assert run(spark, pii.redact("t"), texts) == [brute_redact(t) for t in texts]


def test_placeholder_is_literal(spark):
    assert run(spark, pii.redact("t", placeholder="$0\\1"), SAMPLES) == [brute_redact(t, "$0\\1") for t in SAMPLES]


def test_redaction_is_idempotent_and_null_safe(spark):
    df = spark.createDataFrame([(t,) for t in SAMPLES] + [(None,)], "t string").select(pii.redact("t").alias("t"))
    twice = df.select((F.col("t").eqNullSafe(pii.redact("t"))).alias("same"), pii.contains_pii("t").alias("left"))
    assert all(r["same"] for r in twice.collect())
    assert spark.range(1).select(pii.contains_pii(F.lit(None).cast("string"))).first()[0] is False


def test_strict_mode_spares_dates_and_takes_whole_cards(spark):
    texts = ["due 2024-03-05 ok", "card 4111 1111 1111 1111 end"]
    assert run(spark, pii.redact("t", mode="strict"), texts) == ["due 2024-03-05 ok", "card [REDACTED]end"]


def brute_record(value):
    if isinstance(value, dict):
        return {k: pii.PLACEHOLDER if k.lower() in pii.FIELD_NAMES else brute_item(v) for k, v in value.items()}
    return value


def brute_item(v):
    if isinstance(v, str):
        return brute_redact(v)
    if isinstance(v, dict):
        return brute_record(v)
    if isinstance(v, list):
        return [brute_record(x) if isinstance(x, dict) else brute_redact(x) if isinstance(x, str) else x for x in v]
    return v


def test_records(spark):
    data = {"Password": 12, "note": "mail a.b@c.de", "n": 5, "user": {"EMAIL": "x", "tel": "0171 5550000 1"},
            "list": ["a.b@c.de", "ok"], "deep": [["a.b@c.de"]], "people": [{"phone": "1", "bio": "a.b@c.de"}]}
    schema = ("Password int, note string, n int, user struct<EMAIL:string,tel:string>, list array<string>, "
              "deep array<array<string>>, people array<struct<phone:string,bio:string>>")
    row = spark.createDataFrame([(12, data["note"], 5, ("x", data["user"]["tel"]), data["list"], data["deep"],
                                  [("1", "a.b@c.de")])], schema)
    assert pii.redact_record(row).first().asDict(recursive=True) == brute_record(data)


def test_json_of_mixed_shapes(spark):
    import json
    texts = ['{"a":"x.y@z.de","n":1}', '{"a":5,"n":2.5,"token":true}', '{"a":["x.y@z.de"],"list":[{"email":"e","o":"x.y@z.de"}]}',
             '["x.y@z.de"]', "call x.y@z.de", None, '{}', '{"n":null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["t"] for r in pii.redact_json(df, "t").orderBy("i").collect()]
    box = pii.PLACEHOLDER
    assert [json.loads(t) if t and t[0] in "{[" else t for t in got] == [
        {"a": box, "n": 1}, {"a": 5, "n": 2.5, "token": box}, {"a": [box], "list": [{"email": box, "o": box}]},
        [box], f"call {box}", None, {}, {"n": None}]
    variants = pii.redact_json(df.filter("i < 4").withColumn("t", F.parse_json("t")), "t").orderBy("i")
    assert [json.loads(r[0]) for r in variants.select(F.to_json("t")).collect()] == [json.loads(t) for t in got[:4]]


def test_maps_and_json(spark):
    df = spark.sql("""SELECT map('token', 't', 'note', 'a.b@c.de') AS m, map('phone', 1, 'n', 2) AS counts,
                      '{"email":"x","k":{"v":"a.b@c.de","n":1}}' AS j""")
    out = pii.redact_json(pii.redact_record(df, ["m", "counts"]), "j").first()
    assert out["m"] == {"token": pii.PLACEHOLDER, "note": pii.PLACEHOLDER}
    assert out["counts"] == {"phone": pii.PLACEHOLDER, "n": "2"}
    import json
    assert json.loads(out["j"]) == {"email": pii.PLACEHOLDER, "k": {"v": pii.PLACEHOLDER, "n": 1}}


def test_named_secrets_go_in_any_shape(spark):
    texts = ['{"password":"hunter2","user":{"token":"abc"}}', '{"user":"bob"}', '[{"api_key":1},"x",[{"token":"kept"}]]',
             '{"list":[{"password":{"a":"deep9"}},"b",3]}', '{"user":{"password":["p1","p2"]}}', 'no json "token"', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    out = {r["i"]: r["body"] for r in pii.redact_json(rows, "body").collect()}
    variants = rows.filter("i <> 5").select("i", F.parse_json("body").alias("body"))
    whole = {r["i"]: r["j"] for r in pii.redact_record(variants).select("i", F.to_json("body").alias("j")).collect()}
    for found in (out, whole):
        joined = "\n".join(x for x in found.values() if x)
        for secret in ("hunter2", "abc", "deep9", "p1", "p2"):
            assert secret not in joined, (secret, joined)
        assert "bob" in found[1] and found[6] is None
    assert out[5] == 'no json "token"'
