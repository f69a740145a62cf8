"""Resolution: reciprocal pairs, caps, verification under budgets, thresholds, state changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from linkloom.settings import Settings


def resolve_reciprocal(opps: DataFrame, status: str = "ready") -> DataFrame:
    """Of two kept rows that link both ways, the less confident (later id on a tie) becomes reciprocal."""
    kept = F.col("status") == status
    w = Window.partitionBy(F.least("s", "t"), F.greatest("s", "t"), kept).orderBy(F.desc(F.coalesce("confidence", F.lit(0))), "id")
    lost = kept & (F.row_number().over(w) > 1)
    return opps.withColumn("_lost", lost).withColumns({"status": F.when(F.col("_lost"), "reciprocal").otherwise(F.col("status")), "confidence": F.when(~F.col("_lost"), F.col("confidence"))}).drop("_lost")


def enforce_caps(opps: DataFrame, outgoing: DataFrame, s: Settings, status: str = "ready") -> DataFrame:
    """Rows of a source beyond its free places become capped; outgoing: s, n_out."""
    kept = F.col("status") == status
    w = Window.partitionBy("s", kept).orderBy(F.desc_nulls_last("confidence"), F.desc("sim"), "id")
    free = F.greatest(F.lit(0), F.lit(s.max_outgoing_links) - F.coalesce("n_out", F.lit(0)))
    ranked = opps.join(outgoing, "s", "left").withColumn("_r", F.when(kept, F.row_number().over(w)))
    return ranked.withColumn("status", F.when(F.col("_r") > free, "capped").otherwise(F.col("status"))).select(*opps.columns)


def finalize(opps: DataFrame, outgoing: DataFrame, s: Settings, status: str = "ready") -> DataFrame:
    """Reciprocal pairs, then caps, then the rows sure enough to be inserted."""
    rows = resolve_reciprocal(opps, status) if s.avoid_reciprocal else opps
    rows = enforce_caps(rows, outgoing, s, status)
    sure = (F.col("status") == status) & (F.col("confidence") >= s.auto_min_confidence) & F.lit(s.auto_insert)
    return rows.withColumn("status", F.when(sure, "inserted").otherwise(F.col("status")))


def verdict_ok(s: Settings):
    """Topic, product and jurisdiction fit (missing ones of the last two count as fitting), and the score."""
    yes = F.lit(True)
    return F.coalesce("topic_match", ~yes) & F.coalesce("product_match", yes) & F.coalesce("jurisdiction_match", yes) & (F.coalesce("pair_score", F.lit(0)) >= s.rerank_pair_min) & (F.coalesce("grounded", F.lit("")) != "")


def reapply_thresholds(opps: DataFrame, verdicts: DataFrame, s: Settings) -> DataFrame:
    """New statuses of all rows with a stored verdict, without new judgements; verdicts: id, ..., grounded."""
    v = verdicts.select("id", verdict_ok(s).alias("_ok"), "pair_score")
    joined = opps.join(v, "id", "left")
    status = F.when(F.col("_ok").isNull(), F.col("status")).when(F.col("_ok"), "verified").otherwise("rejected_relevance")
    return joined.withColumns({"status": status, "confidence": F.when(F.col("_ok"), F.col("pair_score").cast(opps.schema["confidence"].dataType)).otherwise(F.col("confidence"))}).select(*opps.columns)


def reapply_and_resolve(opps: DataFrame, verdicts: DataFrame, outgoing: DataFrame, s: Settings, protect_decided: bool = False) -> DataFrame:
    """`reapply_thresholds`, then reciprocal pairs and caps among the verified; decided rows are left alone if protected."""
    rows = reapply_thresholds(opps, verdicts, s)
    if protect_decided:
        old = opps.select("id", F.col("status").alias("_s"), F.col("confidence").alias("_c"))
        keep = F.col("_s").isin("inserted", "rejected", "reciprocal")
        rows = rows.join(old, "id").withColumns({"status": F.when(keep, F.col("_s")).otherwise(F.col("status")), "confidence": F.when(keep, F.col("_c")).otherwise(F.col("confidence"))}).select(*opps.columns)
    rows = resolve_reciprocal(rows, "verified") if s.avoid_reciprocal else rows
    return enforce_caps(rows, outgoing, s, "verified")


def verify_component(pdf: pd.DataFrame, slots: int, budget: int) -> pd.DataFrame:
    """The sequential greedy pass over rows that can influence one another.

    Columns id, s, t, status, confidence, n_out, ok (the verdict; null if the
    judge failed). By confidence, then id: a source whose places or judgements
    are used up gets capped rows; a verified row blocks its reverse.
    """
    pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    status = pdf["status"].tolist()
    by_pair = {(a, b): k for k, (a, b) in enumerate(zip(pdf["s"], pdf["t"], strict=True))}
    kept: dict[int, int] = {}
    judged: dict[int, int] = {}
    for a, st in zip(pdf["s"], status, strict=True):
        kept[a] = kept.get(a, 0) + (st == "verified")
        judged[a] = judged.get(a, 0) + (st in ("verified", "rejected_relevance", "rewrite_suggested"))
    for k, row in enumerate(pdf.itertuples(index=False)):
        if status[k] != "ready":
            continue
        if kept[row.s] >= max(0, slots - int(row.n_out)) or judged[row.s] >= budget:
            status[k] = "capped"
        elif row.ok is not None and not pd.isna(row.ok):
            judged[row.s] += 1
            if not row.ok:
                status[k] = "rejected_relevance"
                continue
            status[k] = "verified"
            kept[row.s] += 1
            back = by_pair.get((row.t, row.s))
            if back is not None and status[back] in ("pending", "ready", "rewrite_suggested"):
                status[back] = "reciprocal"
    return pdf.assign(status=status)[["id", "s", "t", "status", "confidence"]]


def _fold_source(slots: int, budget: int):
    """Decide a source's open rows in order, up to one whose reverse is open and comes before it."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        status, closed, new = pdf["status"].tolist(), pdf["closed"].tolist(), [False] * len(pdf)
        kept = status.count("verified")
        judged = sum(x in ("verified", "rejected_relevance", "rewrite_suggested") for x in status)
        for k, row in enumerate(pdf.itertuples(index=False)):
            if closed[k]:
                continue
            if row.r_open and (-row.r_confidence, row.r_id) < (-row.confidence, row.id):
                break
            closed[k] = True
            if kept >= max(0, slots - int(row.n_out)) or judged >= budget:
                status[k] = "capped"
            elif row.ok is not None and not pd.isna(row.ok):
                judged += 1
                kept += bool(row.ok)
                new[k] = bool(row.ok)
                status[k] = "verified" if row.ok else "rejected_relevance"
        return pdf.assign(status=status, closed=closed, new=new)[["id", "s", "t", "status", "confidence", "n_out", "ok", "closed", "new"]]

    return fold


def verify_greedy(opps: DataFrame, verdicts: DataFrame, outgoing: DataFrame, s: Settings, ws, most_rounds: int = 10_000) -> DataFrame:
    """Budgeted greedy verification; verdicts: id, ok. The same rows as `verify_component` over all, in parallel rounds.

    In a round every source goes on until a row whose reverse is open and comes
    before it; reverses of newly verified rows are then blocked. The first open
    row of all always has its turn, so every round gets on. A task holds one
    source's rows; the rest moves by joins on pairs.
    """
    schema = "id long, s long, t long, status string, confidence double, n_out int, ok boolean, closed boolean, new boolean"
    rows = opps.join(verdicts.select("id", "ok"), "id", "left").join(outgoing, "s", "left").fillna(0, ["n_out"])
    start = rows.select("id", "s", "t", "status", F.coalesce("confidence", F.lit(0)).cast("double").alias("confidence"), F.col("n_out").cast("int").alias("n_out"), "ok", (F.col("status") != "ready").alias("closed"))
    state = ws.cut(start)
    for _ in range(most_rounds):
        if not state.where(~F.col("closed")).head(1):
            return state.join(opps.select("id", F.col("confidence").alias("_c")), "id").select("id", "s", "t", "status", F.col("_c").cast("double").alias("confidence"))
        back = state.select(F.col("t").alias("s"), F.col("s").alias("t"), (~F.col("closed")).alias("r_open"), F.col("confidence").alias("r_confidence"), F.col("id").alias("r_id"))
        met = state.join(back, ["s", "t"], "left").fillna(False, ["r_open"])
        folded = ws.cut(met.groupBy("s").applyInPandas(_fold_source(s.max_outgoing_links, s.rerank_budget), schema))
        blocked = folded.where("new").select(F.col("t").alias("s"), F.col("s").alias("t"), F.lit(True).alias("_b"))
        hit = F.coalesce("_b", F.lit(False)) & F.col("status").isin("pending", "ready", "rewrite_suggested")
        after = folded.join(blocked, ["s", "t"], "left").withColumns({"closed": F.col("closed") | hit, "status": F.when(hit, "reciprocal").otherwise(F.col("status"))})
        old, state = state, ws.cut(after.select(*start.columns))
        ws.drop(old, folded)
    raise RuntimeError(f"verification did not settle in {most_rounds} rounds")


def reevaluate(opps: DataFrame) -> DataFrame:
    """Undecided and dropped rows back to pending, their results cleared."""
    again = F.col("status").isin("ready", "verified", "rewrite_suggested", "no_anchor", "low_relevance", "reciprocal", "capped", "rejected_relevance", "error")
    return opps.withColumns({"confidence": F.when(~again, F.col("confidence")), "status": F.when(again, "pending").otherwise(F.col("status"))})


def reject(opps: DataFrame, ids: DataFrame) -> DataFrame:
    """Any row (id) is rejected where a user says so."""
    marked = opps.join(ids.select("id").distinct().withColumn("_r", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("_r"), "rejected").otherwise(F.col("status"))).select(*opps.columns)


def drop_undecided(opps: DataFrame) -> DataFrame:
    """What stays before all matches are made anew."""
    return opps.where(~F.col("status").isin("pending", "ready", "no_anchor", "low_relevance", "rewrite_suggested"))


def on_trash(opps: DataFrame, ids: DataFrame) -> DataFrame:
    """Open rows that touch trashed posts (id) go; decided ones stay."""
    open_ = F.col("status").isin("pending", "ready", "inserting")
    hit = ids.select(F.col("id").alias("_p"), F.lit(True).alias("_hit")).distinct()
    met = opps
    for k, end in enumerate(("s", "t")):
        met = met.join(hit.toDF(f"_p{k}", f"_hit{k}"), F.col(end) == F.col(f"_p{k}"), "left")
    return met.where(~(open_ & (F.coalesce("_hit0", F.lit(False)) | F.coalesce("_hit1", F.lit(False))))).select(*opps.columns)


def on_delete(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (s, t, ...) that touch no deleted post (id)."""
    return edges.join(ids.select(F.col("id").alias("s")), "s", "left_anti").join(ids.select(F.col("id").alias("t")), "t", "left_anti").select(*edges.columns)
