"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Base spans are the matches of three fixed patterns. Besides, every long run of token characters that mixes
letters and digits is a candidate. All candidates' hashes are counted over the corpus by distinct repositories and
owners: a value that ``examples`` or more owners hold is a widely copied example, and so is one that is in ``copies``
or more repositories (documents) per owner; one with fewer of both looks live, a candidate only with enough different
characters. The scan adds the live-looking candidates to the spans and tells for every span whether it is live, and how many owners
and repositories its value has. In a corpus with few owners only the repositories mark an example.

Cases: a null text is empty and has no spans; a null owner counts as one owner, a null id as one repository; rows
that repeat an id and text get the same answer each; rows that repeat an id with other texts are told apart by the
text; an empty table gives an empty result; a span's positions are code points, however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, marked, salted_join

# fixed values: the base patterns and least lengths
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a whole run of at least 18: AKIA[A-Z0-9]+ without the shorter ones
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# a further candidate: a long run, of those with a letter and a digit
LONG = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
EXAMPLES, COPIES = 3, 20
LEAST_DISTINCT = 8


RUN = 256  # values that are added up in one go; a growing array is copied at every value
CHUNK = 4096  # code points; a long text's parts are found by way of its chunks


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, combine) -> Column:
    """The values of an array combined (added up, or the greatest) up to each; near linear in the array's length.

    Runs of RUN values first, then what is before each run.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(None).cast("int").alias("last"), none.alias("out"))

    def step(state, x):
        now = F.when(state["last"].isNull(), x).otherwise(combine(state["last"], x))
        return F.struct(now.alias("last"), F.concat(state["out"], F.array(now)).alias("out"))

    def whole(array):
        return F.aggregate(array, start, step, lambda st: st["out"])

    def runs_of(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(held) / RUN).cast("int") - 1, F.lit(0))),
                           lambda i: whole(F.slice(held, i * RUN + 1, F.lit(RUN))))

    def shifted(runs: Column) -> Column:
        before = whole(F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), lambda r: F.element_at(r, -1)))
        return F.flatten(F.concat(F.slice(runs, 1, 1), F.zip_with(
            F.slice(runs, F.lit(2), F.size(runs) - 1), before, lambda r, b: F.transform(r, lambda v: combine(b, v)))))

    return F.when(F.size(values) > 0, _with(values, lambda held: _with(runs_of(held), shifted))).otherwise(none)


def _added(values: Column) -> Column:
    return _running(values, lambda a, b: a + b)


def _found(text: Column, pattern: str, hint: str | None = None, value_group: int = 0) -> Column:
    """Matches with their code point spans: the pieces between the matches tell where each begins."""
    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = _added(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
        values = hits if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        return F.transform(F.arrays_zip(hits.alias("hit"), ends.alias("end"), values.alias("value")), lambda m: F.struct(
            (m["end"] - F.length(m["hit"])).alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    spans = _with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(text.rlike(hint or pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _apart(runs: str, assigned: str) -> Column:
    """The runs that share no code point with an assigned span: both are sorted and disjoint among themselves.

    In the order of starts a run meets an assigned span after it only if that is the next of all, and one before
    it only if the assigned spans before it reach beyond its start.
    """
    def marked(name: str, own: int) -> Column:
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(own).alias("own"), m["end"].alias("end"), m["value"].alias("value")))

    def free(both: Column) -> Column:
        reach = _running(F.transform(both, lambda m: F.when(m["own"] == 0, m["end"]).otherwise(0)), F.greatest)
        following = F.slice(both, F.lit(2), F.size(both))
        trio = F.arrays_zip(both.alias("m"), reach.alias("reach"), following.alias("next"))
        left = F.filter(trio, lambda p: (p["m"]["own"] == 1) & (p["reach"] <= p["m"]["start"]) & F.coalesce(
            (p["next"]["own"] == 1) | (p["next"]["start"] >= p["m"]["end"]), F.lit(True)))
        return F.transform(left, lambda p: F.struct(p["m"]["start"].alias("start"), p["m"]["end"].alias("end"), p["m"]["value"].alias("value")))

    kept = _with(F.array_sort(F.concat(marked(assigned, 0), marked(runs, 1))), free)
    return F.when(F.size(runs) == 0, F.col(runs)).when(F.size(assigned) == 0, F.col(runs)).otherwise(kept)


def base_spans(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and ``cands``: all base spans and further candidates as (start, kind number, end, value).

    Each step is linear in the text, or nearly. An access key or hex value lies wholly in a run of token characters, so whether
    a run has one is told by the run itself; only assigned values are compared by place.
    """
    body = F.coalesce(text, F.lit(""))
    step = docs.select(*keep, body.alias("_text"))
    step = step.withColumns({
        "_assign": F.filter(_found(F.col("_text"), ASSIGN, ASSIGN_HINT, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST),
        "_access": _found(F.col("_text"), ACCESS), "_hex": _found(F.col("_text"), HEX),
        "_long": F.filter(_found(F.col("_text"), LONG), lambda m: m["value"].rlike("[A-Za-z]") & m["value"].rlike("[0-9]")
                          & ~m["value"].rlike(HEX) & ~m["value"].rlike(ACCESS)),
    })

    def tagged(name, kind):
        return F.transform(name, lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    step = step.withColumn("_own", _apart("_long", "_assign"))
    return step.select(*[c for c in step.columns if not c.startswith("_")], F.array_sort(F.concat(
        tagged("_assign", 0), tagged("_access", 1), tagged("_hex", 2), tagged("_own", 3))).alias("cands"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def row_key(row_id: Column, text: Column) -> Column:
    """A row by id and text, never null."""
    return F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))


def ownership(scanned: DataFrame, examples: int = EXAMPLES, least_distinct: int = LEAST_DISTINCT, copies: int = COPIES) -> DataFrame:
    """(row_id, owner, cands) -> (hash, owners, repositories, rare: no example, live: rare and of varied characters).

    Distinct pairs first, then counts: the rows of a value copied everywhere are merged before they move.
    """
    each = scanned.select("row_id", "owner", F.explode("cands").alias("c")).select(
        "row_id", "owner", F.xxhash64("c.value").alias("hash"),
        F.size(F.array_distinct(F.split("c.value", ""))).alias("distinct"))
    owners = each.groupBy("hash", F.struct("owner").alias("o")).agg(F.max("distinct").alias("distinct")) \
        .groupBy("hash").agg(F.count("*").alias("owners"), F.max("distinct").alias("distinct"))
    repos = each.select("hash", F.struct("row_id").alias("r")).distinct().groupBy("hash").agg(
        F.count("*").alias("repositories"))
    rare = (F.col("owners") < examples) & (F.col("repositories") < copies * F.col("owners"))
    live = rare & (F.col("distinct") >= least_distinct)
    return owners.join(repos, "hash").select("hash", "owners", "repositories", rare.alias("rare"), live.alias("live"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         **options) -> DataFrame:
    """Per row: id, key, counts by kind, hash of the base spans, all spans, the repositories of each span's value in
    their order, and ``found`` with live, owners and repositories."""
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = base_spans(docs, col(text_col), [
        col(id_col).alias("row_id"), col(owner_col).alias("owner"), row_key(col(id_col), col(text_col)).alias("key")])
    scanned = scratch.store(scanned, "scanned", result=True)
    some = scanned.filter(F.size("cands") > 0)
    known = scratch.store(ownership(some, **options), "ownership")
    each = some.select("key", F.explode("cands").alias("c")).withColumn("hash", F.xxhash64("c.value"))
    told = salted_join(each, known, "hash", F.xxhash64("key"))
    # base spans need no variety
    told = told.withColumn("live", F.when(F.col("c.kind") < 3, F.col("rare")).otherwise(F.col("live")))
    told = told.filter((F.col("c.kind") < 3) | F.col("live")).groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct(
            F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.end").alias("end"),
            "live", "owners", "repositories"))).alias("spans"))
    told = scratch.store(told, "told", result=True)
    scratch.clear()
    empty = F.array().cast(told.schema["spans"].dataType)
    rest = scanned.filter(F.size("cands") == 0).select("row_id", "key", empty.alias("spans"))
    hits = some.select("row_id", "key").join(told, "key", "left").select(
        "row_id", "key", F.coalesce("spans", empty).alias("spans"))
    out = rest.unionByName(hits)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def n_of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return out.select(
        F.col("row_id").alias(id_col), "key", *map(n_of, range(4)), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.array_join(F.transform("spans", lambda s: s["repositories"].cast("string")), ",").alias("repositories"),
        F.col("spans").alias("found"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         placeholder: str = "[SECRET]", **options) -> DataFrame:
    """All documents, the live-looking spans of their texts replaced; widely copied examples stay readable."""
    names = docs.columns
    told = scan(docs, id_col, text_col, owner_col, **options).filter("n_live > 0").select(
        "key", F.filter("found", lambda s: s["live"]).alias("found")).dropDuplicates(["key"])
    scratch = Scratch(docs.sparkSession, "secrets-mask")
    told = scratch.store(told, "told", result=True)
    packed = docs.select(F.struct(*[col(c) for c in names]).alias("row"))
    packed = packed.withColumn("key", row_key(F.col("row")[id_col], F.col("row")[text_col]))
    # texts without anything to mask need not move
    packed = marked(packed, [F.col("key")], told.select("key"), scratch, "told", result=True)
    clean = packed.filter("NOT _marked").select(*[F.col("row")[c].alias(c) for c in names])
    joined = packed.filter("_marked").join(told, "key", "left")
    body = F.col("row")[text_col]

    # what is before each span: the reach of all spans before it; overlapping spans are masked as one
    joined = joined.withColumns({
        "reach": _running(F.transform("found", lambda s: s["end"]), F.greatest),
        "chunks": F.when(F.col("found").isNotNull(), F.transform(
            F.sequence(F.lit(0), F.floor(F.length(body) / CHUNK).cast("int")), lambda i: F.substring(body, i * CHUNK + 1, F.lit(CHUNK))))})

    def part(begin: Column, end: Column) -> Column:
        """The text from one place to another, from its chunks."""
        pieces = F.transform(F.sequence(F.floor(begin / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")), lambda c: F.substring(
            F.get("chunks", c), F.greatest(begin - c * CHUNK, F.lit(0)) + 1,
            F.least(end - c * CHUNK, F.lit(CHUNK)) - F.greatest(begin - c * CHUNK, F.lit(0))))
        return F.when(end > begin, F.array_join(pieces, "")).otherwise("")

    def before_and_mark(s: Column, i: Column) -> Column:
        at = F.coalesce(F.get("reach", i - 1), F.lit(0))
        return F.concat(part(at, s["start"]), F.when(s["start"] >= at, placeholder).otherwise(""))

    masked = F.concat(F.array_join(F.transform("found", before_and_mark), ""), part(F.element_at("reach", -1), F.length(body)))
    new = F.when(F.col("found").isNull(), body).otherwise(masked)
    return clean.union(joined.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in names]))
