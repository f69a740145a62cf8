"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source starts with the same rate (target words over source
words, 3 at most): whole copies are certain, the fractional part is an
inclusion probability. The cube method's flight moves these probabilities
along the null space of the balancing constraints (number of documents and
number of words), three undecided documents at a time, until two at most are
left in a block, apart from a reserve of its smallest documents; blocks then
meet in fewer blocks. The landing decides the larger half of what is open,
dropping the document constraint before the word constraint, spreads the words
it rounded away over the rest, and goes on with the rest, so that the last
rounding is that of a source's smallest documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from linkloom.session import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3.0
BLOCK = 512
#: Repeats of a row that one task writes out at once.
REPEATS = 4096
#: Each pass of the targets stops one source more at its ceiling, or ends.
MOST_PASSES = 1000
RESERVE = 8
TRIES = 16
_EPS = 1e-9


def word_count(text) -> F.Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key() -> F.Column:
    """A key of the column source; null is a source of its own and comes last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def _draw(*keys: int) -> float:
    """A uniform number in [0, 1) from integers, the same in every run."""
    x = 0x9E3779B97F4A7C15
    for k in keys:
        x = (x ^ (k & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def _null_vector(sizes: list[float], landing: bool) -> list[float]:
    """A direction that keeps the word total, and the document total while three are open."""
    if len(sizes) == 3:
        a, b, c = sizes
        u = [b - c, c - a, a - b]
        return u if any(u) else [1.0, -1.0, 0.0]
    if len(sizes) == 2 and landing:
        a, b = sizes
        return [b, -a] if a or b else [1.0, -1.0]
    return [1.0]


def flight(ids: list[int], sizes: list[int], probs: list[float], landing: bool, salt: int = 0) -> list[float]:
    """Move probabilities to 0 or 1; without `landing` two at most stay between.

    Expected values are kept at each step: of the two ends of the direction,
    one is drawn with the probability that leaves the mean where it was.
    """
    p = list(probs)
    open_: list[int] = []
    rest = iter(range(len(p)))
    while True:
        while len(open_) < 3 and (k := next(rest, None)) is not None:
            if _EPS < p[k] < 1 - _EPS:
                open_.append(k)
            else:
                p[k] = float(round(p[k]))
        if not open_ or (len(open_) < 3 and not landing):
            return p
        u = _null_vector([float(sizes[k]) for k in open_], landing)
        up = min((1 - p[k]) / d if d > 0 else -p[k] / d for k, d in zip(open_, u, strict=True) if d)
        down = min(p[k] / d if d > 0 else (p[k] - 1) / d for k, d in zip(open_, u, strict=True) if d)
        step = up if _draw(*(ids[k] for k in open_), len(open_) + 4 * salt) * (up + down) < down else -down
        for k, d in zip(open_, u, strict=True):
            x = p[k] + step * d
            p[k] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        open_ = [k for k in open_ if _EPS < p[k] < 1 - _EPS]


def _spread(debt: float, sizes: list[int], p: list[float]) -> list[float]:
    """Add the same amount to all probabilities, within 0 and 1, to gain `debt` words."""
    p = list(p)
    for _ in range(8):
        able = [k for k in range(len(p)) if sizes[k] and (p[k] < 1 if debt > 0 else p[k] > 0)]
        words = sum(sizes[k] for k in able)
        if not words or abs(debt) < 1e-6:
            break
        add = debt / words
        for k in able:
            new = min(1.0, max(0.0, p[k] + add))
            debt -= (new - p[k]) * sizes[k]
            p[k] = new
    return p


def land(ids: list[int], sizes: list[int], probs: list[float]) -> list[float]:
    """Decide all, from large to small (the order given), in halves of what is left.

    Of up to TRIES draws the first is taken whose rounding the rest can make
    good, else the one that leaves least; this only matters where a few
    documents hold most of a small source.
    """
    p, at = list(probs), 0
    while at < len(p):
        stop = at + (len(p) - at + 1) // 2
        room = [sum((1 - x) * s for x, s in zip(p[stop:], sizes[stop:], strict=True)), sum(x * s for x, s in zip(p[stop:], sizes[stop:], strict=True))]
        least = None
        for salt in range(TRIES):
            drawn = flight(ids[at:stop], sizes[at:stop], p[at:stop], True, salt)
            owed = sum((a - b) * s for a, b, s in zip(p[at:stop], drawn, sizes[at:stop], strict=True))
            beyond = max(0.0, owed - room[0], -owed - room[1])
            if least is None or beyond < least[0]:
                least = beyond, drawn, owed
            if beyond <= 1e-6:
                break
        _, part, debt = least
        p[at:stop] = part
        p[stop:] = _spread(debt, sizes[stop:], p[stop:])
        at = stop
    return p


def fly_block(ids: list[int], sizes: list[int], probs: list[float]) -> list[float]:
    """The flight over all but the smallest documents, which wait for the landing."""
    cut = max(0, len(probs) - RESERVE)
    return flight(ids[:cut], sizes[:cut], probs[:cut], False) + list(probs[cut:])


def _ranked_sources(sources: DataFrame, ws: Workspace) -> DataFrame:
    """Add each source's rank from 0 by code point without one task for all of them."""
    spread = ws.cut(sources.repartitionByRange("skey").sortWithinPartitions("skey").select("*", F.spark_partition_id().alias("_part")))
    counts = {r["_part"]: r["n"] for r in spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    if not before:
        return spread.select("skey", "source_size", "n_docs", F.lit(0).alias("rank"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    within = F.row_number().over(Window.partitionBy("_part").orderBy("skey")) - 1
    return spread.select("skey", "source_size", "n_docs", (within + offset[F.col("_part")]).alias("rank"))


def source_targets(sizes: DataFrame, ws: Workspace, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """skey, source_size, n_docs, target: weighted shares with a ceiling.

    Sources above their ceiling stop there and what they can't hold is shared
    again by weight, until none is above. Each pass is one aggregate.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = _ranked_sources(per, ws)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ws.cut(ranked.select("skey", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * MOST_REPEATS).alias("ceiling")))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    for _ in range(MOST_PASSES):
        full = F.col("ceiling") <= F.col("weight") * F.lit(level)
        held, free = table.agg(F.sum(F.when(full, F.col("ceiling")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - (held or 0.0)) / free if free else level
        if not free or abs(new - level) <= 1e-12 * max(1.0, new):
            level = new
            break
        level = new
    else:
        raise RuntimeError(f"targets did not settle in {MOST_PASSES} passes")
    return table.select("skey", "source_size", "n_docs", F.least("ceiling", F.col("weight") * F.lit(level)).alias("target"))


def _flyer(landing: bool):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], na_position="last", kind="stable")
        return pdf.assign(p=(land if landing else fly_block)(pdf["h"].tolist(), pdf["size"].tolist(), pdf["p"].tolist()))

    return fly


KEYS = ["doc_id", "skey", "size", "fp"]


def _key_columns() -> list[F.Column]:
    """KEYS of a row of documents; fp is a fingerprint of the text. Rows with one key are alike to the mix."""
    return [F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("skey"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("fp")]


def _numbered(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Rows with `nr`, from 0 for each key: counted first, then written out again, so that repeats never meet in one task."""
    counted = ws.cut(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("m")))
    once = counted.where("m = 1").select(*KEYS, F.lit(0).cast("long").alias("nr"))
    parts = counted.where("m > 1").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATS))))
    dealt = parts.repartition(F.xxhash64(*KEYS), "b")
    each = F.explode(F.sequence(F.col("b") * REPEATS, F.least(F.col("m"), (F.col("b") + 1) * REPEATS) - 1))
    return once.union(dealt.select(*KEYS, each.alias("nr")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, block: int = BLOCK, ws: Workspace | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, p0, skey, fp for each row of docs.

    docs: doc_id, text, source. Null and empty texts have size 0; a null source
    is a source of its own and comes last; a source without words has target 0
    and nothing is taken. Equal rows, null ids included, are separate rows with
    decisions of their own. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "mix")
    sizes = ws.cut(_numbered(docs.select(*_key_columns()), ws))
    targets = ws.cut(source_targets(sizes, ws, weights, share))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(MOST_REPEATS))).otherwise(0.0)
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    # Integer parts are certain; rates within rounding error of one aren't fractions.
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    rated = (
        sizes.join(targets, "skey")
        .withColumn("rate", rate)
        .withColumn("h", F.xxhash64(*KEYS, "nr"))
        .select("doc_id", "skey", "size", "fp", "source_size", "target", "h", "n_docs", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p0"))
    )
    n_blocks = F.ceil(F.col("n_docs") / block)
    schema = "doc_id long, skey string, size long, fp long, source_size long, target double, h long, n_docs long, whole int, p0 double, p double, blk long"
    state = rated.withColumns({"p": F.col("p0"), "blk": F.pmod(F.shiftright("h", 20), n_blocks)})
    blocks, meet = max(1, -(-largest // block)), max(2, block // (RESERVE + 2))
    done: list[DataFrame] = []
    while True:
        landing = blocks <= 1
        flown = ws.cut(state.groupBy("skey", "blk").applyInPandas(_flyer(landing), schema))
        fractional = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        if landing:
            done.append(flown)
            break
        done.append(flown.where(~fractional))
        # RESERVE + 2 at most are left of a block.
        blocks = -(-blocks // meet)
        state = flown.where(fractional).withColumn("blk", F.floor(F.col("blk") / meet))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("p0"), "skey", "fp")


def repeated(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """The rows of docs as often as the mix takes them: none to three times. All columns stay.

    Rows with one key take the decisions on them in any order; null keys count
    as equal. Texts move once, to meet the decision on their row, by the same
    join at every size.
    """
    ws = ws or Workspace(docs.sparkSession, "mix")
    most, keys = int(MOST_REPEATS), ["no_id", "id", "skey", "fp"]
    own = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id"), F.col("skey"), F.col("fp")]
    taken = mix(docs, ws=ws).where("copies > 0").select(*own, "copies")
    drawn = taken.groupBy(*keys).agg(*[F.count(F.when(F.col("copies") >= k, 1)).alias(f"n{k}") for k in range(1, most + 1)])
    rows = docs.select(F.struct("*").alias("row"), F.struct(*_key_columns()).alias("key"))
    rows = rows.select("row", F.col("key.doc_id").isNull().alias("no_id"), F.coalesce("key.doc_id", F.lit(0)).cast("long").alias("id"), "key.skey", "key.fp")
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    met = rows.join(drawn.hint("merge"), keys).withColumn("nr", nr)
    taken = met.withColumn("copies", sum((F.col("nr") <= F.col(f"n{k}")).cast("int") for k in range(1, most + 1))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
