import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.functions import html as H, text as T, vectors as V
from linkloom.operators import graph, matching, resolve
from linkloom.settings import Settings


@pytest.mark.parametrize("word, want", [("coatings", "coat"), ("detailing", "detail"), ("taxes", "tax"), ("policies", "polic"), ("this", "thi"), ("gas", "gas"), ("being", "being"), ("series", "ser"), ("is", "is")])
def test_stem(word, want):
    assert H.stem(word) == want


@pytest.mark.parametrize(
    "anchor, passage, title, body, want",
    [
        ("Ceramic", "Ceramic coatings are durable.", "Ceramic Coatings Guide", "", "Ceramic coatings"),
        ("quietly", "He quietly chose a car rental in Singapore last year.", "Car Rental in Singapore", "", "car rental in Singapore"),
        ("Document", "Document the scene before you leave.", "After a Crash", "document scene document scene", "Document the scene"),
        ("loan terms", "Compare loan terms before borrowing.", "Best Loans", "", "loan"),
        ("loan", "Pay your loan. Loan rates vary.", "Loan Rates", "", "loan. Loan rates"),
        ("x", "nothing relevant here", "Loan Rates", "", "x"),
    ],
)
def test_refine_anchor(anchor, passage, title, body, want):
    assert H.refine_anchor(anchor, passage, title, body) == want


def test_ground_anchor():
    assert H.ground_anchor("Car  loans", "Cheap car loans here") == "car loans"
    assert H.ground_anchor("car loan", "Cheap car loans here") == ""
    assert H.ground_anchor("a", "a b") == ""


def test_replace_and_unwrap():
    page = "<h2>Car loans</h2><p>Compare car loans today.</p>"
    out = H.replace_anchor(page, "Compare car loans today.", "car loans", "/x")
    assert out == '<h2>Car loans</h2><p>Compare <a href="/x" data-inserted="1"><strong>car loans</strong></a> today.</p>'
    assert H.unwrap_link(out, "/x") == page
    far = H.replace_anchor('<p>See <a href="/y">rates</a> car loans now and later compare car loans again.</p>', None, "car loans", "/x")
    assert "later compare <a" in far
    assert H.replace_anchor("<h2>Car loans</h2>", None, "car loans", "/x") is None
    later = '<p>Car loans now, <a href="/y">see</a></p><p>Car loans now, they say.</p>'
    assert H.replace_anchor(later, "car loans now,", "Car loans", "/x").endswith("<p><a href=\"/x\" data-inserted=\"1\"><strong>Car loans</strong></a> now, they say.</p>")
    assert H.replace_anchor('<p>x <img alt="car loans"> car loans</p>', None, "car loans", "/a?b&c", bold=False, mark="rel=own") == '<p>x <img alt="car loans"> <a href="/a?b&amp;c" rel=own>car loans</a></p>'
    assert H.unwrap_link('<a href="/x">Car  loans</a> <a href="/x" data-inserted="1">b</a>', "/x", "car loans") == '<a href="/x">Car  loans</a> b'
    assert H.unwrap_link('<a href="/x">Car  loans</a>', "/x", "car loans") == "Car  loans" and H.unwrap_link('<a href="/x">c</a>', "/x") is None


@pytest.mark.parametrize("text, sizes", [("x" * 24, []), ("x" * 25, [25]), ("x" * 500, [500]), ("x" * 600, [600]), (" ".join(["y" * 199 + "."] * 5), [401, 401, 200])])
def test_passages(spark, text, sizes):
    assert [len(p) for p in H.split_passages(text)] == sizes
    got = spark.createDataFrame([(text,)], "t string").select(T.passages(F.col("t"))).first()[0]
    assert [len(p) for p in got] == sizes


def test_scalars(spark):
    row = spark.createDataFrame([(10, 1, "Best Car Loans in India")], "n long, df long, t string").select(
        F.round(T.idf(F.col("n"), F.col("df")), 6), F.round(T.floor(F.col("n")), 6), F.flatten(F.array(*[T.ngrams(T.phrase_tokens(F.col("t")), k) for k in range(2, 7)])),
        T.confidence(F.lit(70.0), F.lit(2), F.lit(3.0), F.lit(2.0)), T.confidence(F.lit(90.0), F.lit(3), F.lit(7.0), F.lit(2.0), F.lit(60)), V.score(F.lit(0.123456)), T.norm_path(F.lit("/Foo/Bar/")), T.norm_path(F.lit("/a%20b")),
    ).first()
    assert list(row) == [2.704748, 2.481605, ["car loans"], 62, 74, 56.17, "/foo/bar", "/a b"]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    got = {(r.s, r.t): r.sim for r in matching.match_outgoing(df, Settings(match_top_k=3), blocks=(4, 3)).collect()}
    c = v - v.mean(0)
    u = c / np.linalg.norm(c, axis=1, keepdims=True)
    want = {}
    for s in range(60):
        sims = sorted(((-round((u[s] @ u[t] + 1) * 50, 2), t) for t in range(60) if t != s))[:3]
        want |= {(s, t): -x for x, t in sims if -x >= 55}
    assert got == want


def test_caps_and_reciprocal(spark):
    o = spark.createDataFrame([(1, 1, 2, 60.0, "ready", 80), (2, 1, 3, 65.0, "ready", 80), (3, 1, 4, 90.0, "ready", 70)], "id long, s long, t long, sim double, status string, confidence int")
    out = spark.createDataFrame([(1, 1)], "s long, n_out int")
    assert {r.id: r.status for r in resolve.enforce_caps(o, out, Settings()).collect()} == {1: "capped", 2: "ready", 3: "capped"}
    o = spark.createDataFrame([(1, 1, 2, 60.0, "ready", 70), (2, 2, 1, 60.0, "ready", 70), (3, 1, 3, 60.0, "ready", 60)], o.schema)
    assert {r.id: (r.status, r.confidence) for r in resolve.resolve_reciprocal(o).collect()} == {1: ("ready", 70), 2: ("reciprocal", None), 3: ("ready", 60)}


def test_greedy_rounds_equal_the_fold(spark):
    from linkloom.session import Workspace

    rng = np.random.default_rng(3)
    for _ in range(3):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 8, (45, 2)) if a != b})
        n_out = {k: int(rng.integers(0, 2)) for k in range(8)}
        pdf = pd.DataFrame([(k, a, b, str(rng.choice(["ready", "ready", "ready", "pending", "verified"])), int(rng.integers(50, 60)), n_out[a], [True, False, None][int(rng.integers(0, 3))]) for k, (a, b) in enumerate(pairs)], columns=["id", "s", "t", "status", "confidence", "n_out", "ok"])
        want = {r.id: r.status for r in resolve.verify_component(pdf, 2, 3).itertuples()}
        opps = spark.createDataFrame(pdf[["id", "s", "t", "status", "confidence"]])
        verdicts = spark.createDataFrame([(int(r.id), r.ok) for r in pdf.itertuples()], "id long, ok boolean")
        out = spark.createDataFrame(list(n_out.items()), "s long, n_out int")
        got = resolve.verify_greedy(opps, verdicts, out, Settings(rerank_budget=3), Workspace(spark, "t"))
        assert {r.id: r.status for r in got.collect()} == want


def test_graph(spark):
    o = spark.createDataFrame([(1, 2, 61.26, "ready"), (2, 1, 61.24, "inserted"), (1, 9, 80.0, "ready")], "s long, t long, sim double, status string")
    e = graph.edges(o, spark.createDataFrame([(1,), (2,)], "id long"))
    assert [tuple(r) for r in e.collect()] == [(1, 2, 61.3, True)]
    assert {tuple(r) for r in graph.degrees(e).collect()} == {(1, 1), (2, 1)}


def test_settings():
    s = Settings(match_top_k=99, api_key="k").update(api_key=" ", link_word_gap=-3)
    assert (s.match_top_k, s.api_key, s.link_word_gap) == (50, "k", 0)
    assert "api_key" not in s.public() and s.public()["api_key_set"]
