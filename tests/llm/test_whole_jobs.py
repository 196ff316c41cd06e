"""Cases in which an operator once did less than its whole job."""

import numpy as np
from pyspark.sql import functions as F

from sitetable.llm import host_trust, kmeans_tree, risk_rules, secret_owners, weighted_minhash


def roots_of(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(i) for i in range(n)]


# --- nearest neighbours ---

def test_an_id_repeated_over_a_third_of_the_rows_leaves_room_for_others(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).round(3)
    ids = np.arange(900)
    ids[600:] = 5000
    x[600:800] = x[0] + 0.01  # nearer to the first query than any other row, and 100 rows of the id elsewhere
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    # all leaves are visited
    got = kmeans_tree.search(df, F.col("vec_id") % 100 == 0, vector_col="v", sample=600, probes=60, recall=1.0).toPandas()
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = {}
        for i, v in zip(ids.tolist(), d.tolist(), strict=True):
            if i != q:
                best[i] = min(v, best.get(i, np.inf))
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and mine.vec_id.is_unique
        assert np.allclose(mine.score, [best[i] for i in mine.vec_id])
        if q == 0:
            assert mine.vec_id.iloc[0] == 5000
        want = sorted(best, key=lambda i: (best[i], i))[:10]
        assert len(set(want) & set(mine.vec_id)) >= 9
    rows, distances = next((r, d) for _, r, d in kmeans_tree.nearest(x[:1], ids[:1], ids, x, 10))
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    want = sorted({int(i): float(d[ids == i].min()) for i in set(ids.tolist()) - {0}}.items(), key=lambda p: (p[1], p[0]))[:10]
    assert ids[rows].tolist() == [i for i, _ in want] and np.allclose(distances, [v for _, v in want])


# --- near-duplicates ---

def test_links_inside_a_family_of_unlike_texts(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(400)]
    spots = lambda n: rng.choice(np.arange(6, 390, 6), n, replace=False).tolist()

    def text(i, changed):
        return " ".join(f"c{changed[j]}x{j}" if j in changed else w for j, w in enumerate(base))

    members = [{j: i for j in spots(6)} for i in range(900)]
    # pairs that share three of six changes, and chains of which each two neighbours do
    for i in range(0, 80, 2):
        kept = list(members[i])[:3]
        members[i + 1] = {j: i for j in kept} | {j: i + 1 for j in spots(8) if j not in kept and j not in members[i]}
        members[i + 1] = dict(list(members[i + 1].items())[:6])
    for start in range(100, 160, 6):
        for i in range(start + 1, start + 6):
            kept = list(members[i - 1])[3:]
            members[i] = {j: members[i - 1][j] for j in kept} | {j: i for j in [x for x in spots(12) if x not in members[i - 1]][:3]}
    texts = [text(i, m) for i, m in enumerate(members)]
    make, known = weighted_minhash.Shingles(), {}
    sets = [[known.setdefault(h, len(known)) for h in make(t)[0].tolist()] for t in texts]
    has = np.zeros((len(sets), len(known)), np.float32)
    for i, s in enumerate(sets):
        has[i, s] = 1
    both = has @ has.T
    alike = both / (has.sum(1)[:, None] + has.sum(1)[None, :] - both)
    links = np.argwhere(np.triu(alike >= 0.8, 1)).tolist()
    want = roots_of(len(texts), links)
    assert 60 < len(links) < 300 and 0.7 < np.median(alike) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


# --- quality rules ---

def test_cutoffs_are_admitted_on_ordinary_label_counts(spark):
    # as many labels as the table of 10,000 documents has, no stratum above 1,200 good ones
    langs = ["en"] * 6 + ["de", "es", None, "pt"]
    def text(i):  # noqa: E306
        # the first 300 are junk; three good ones have symbols too
        return " ".join(("a#%d" if i < 300 or i in (500, 1500, 2500) else "word") + str(j) for j in range((60, 250)[i // 10 % 2]))
    docs = spark.createDataFrame([(i, text(i), langs[i % 10]) for i in range(3600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(3600)], "doc_id long, quality int")
    told = {r["doc_id"]: r["kept"] for r in risk_rules.judge(docs, labels).collect()}
    assert not any(told[i] for i in range(300))
    assert sum(not told[i] for i in range(300, 3600)) == 3
    # a rate that the labels do not support is not admitted: one good document in 30 like the junk
    worse = labels.selectExpr("doc_id", "int(doc_id >= 190) AS quality")
    assert all(r["kept"] for r in risk_rules.judge(docs, worse).collect())


# --- URL rules and link graph ---

def test_verdicts_do_not_depend_on_unlinked_seeds(spark):
    link = '<a href="http://{}/p">'
    graph = [(i, "http://bad.com/de/1", None) for i in range(3)] + [(10, "http://a.net/", link.format("bad.com")), (11, "http://b.net/", link.format("a.net"))]
    # a cycle of two that distrust walks into, and a host behind it
    graph += [(12, "http://c.net/", link.format("b.net") + link.format("d.net")), (13, "http://d.net/", link.format("c.net")), (14, "http://e.net/", link.format("d.net"))]
    # trust that wins over distrust: t.net links to bad.com and is linked by allowed pages
    graph += [(20 + i, f"http://good{i}.org/", link.format("t.net")) for i in range(9)] + [(30, "http://t.net/", link.format("bad.com"))]
    alone = spark.createDataFrame(graph, "page_id long, url string, html string")
    crowd = spark.range(1_000_000).selectExpr("id + 1000 AS page_id", "'http://lone.org/' AS url", "CAST(NULL AS string) AS html")

    def told(pages):
        return {r["page_id"]: r["verdict"] for r in host_trust.judge_pages(pages).filter("page_id < 1000").collect()}

    want = told(alone)
    assert [want[i] for i in (10, 11, 12, 13, 14, 30)] == ["block"] * 5 + ["allow"]
    assert told(alone.unionByName(crowd)) == want


# --- secrets ---

def test_a_value_copied_through_one_source_is_an_example(spark):
    copied, own = "Zx9Qw7Er5Ty3Ui1Op0As", "Lk8Jh6Gf4Ds2Aq1Wz3Xc"
    rows = [(i, f"see {copied} here", "hot") for i in range(1000)] + [(2000, f"mine {own} and token={copied}", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = {r["doc_id"]: r for r in secret_owners.scan(docs).collect()}
    assert told[3]["spans"] == "" and told[3]["repositories"] == ""
    assert told[2000]["n_owned"] == 1 and told[2000]["n_assign"] == 1 and told[2000]["n_live"] == 1
    assert told[2000]["repositories"] == "1,1001"
    texts = {r["doc_id"]: r["text"] for r in secret_owners.mask(docs).collect()}
    assert texts[2000] == f"mine [SECRET] and token={copied}" and texts[3] == f"see {copied} here"


def test_an_assigned_secret_of_few_characters_is_live(spark):
    text = "token=4815162342481516 and 1a1a1a1a1a1a1a1a1a1a1a1ay"
    docs = spark.createDataFrame([(1, text, "a"), (2, "none", "b")], "doc_id long, text string, source string")
    told = {r["doc_id"]: r for r in secret_owners.scan(docs).collect()}
    assert told[1]["n_assign"] == 1 and told[1]["n_owned"] == 0 and "[SECRET]" in {r["doc_id"]: r["text"] for r in secret_owners.mask(docs).collect()}[1]
