from linkloom import registry

D = "/root/testdata/sf0.001"


def test_anchors_of_all_matches_in_their_best_passages(spark):
    best = {(r.s, r.t): r for r in registry.best_passage(spark, D).collect()}
    assert set(best) == {(r.s, r.t) for r in registry._opps(spark, D).select("s", "t").collect()}
    placed = {k for k, r in best.items() if r.status == "ready"}
    later = {k for k in placed if best[k].idx > 0}
    assert later and {(r.s, r.t) for r in registry.refine_anchor(spark, D).collect()} == placed
    anchors = {(r.s, r.t) for r in registry.best_anchor(spark, D).collect()}
    assert anchors <= placed and anchors & later
    assert registry.ground_anchor(spark, D).count() == registry._passages(spark, D).count()
