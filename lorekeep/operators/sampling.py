"""Samples that a seed decides: windows of sessions without feedback, and audits of judged rows with what they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import rng
from lorekeep.shared import discard, written


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`name`: each row's place in its group from 0. Groups of any size: they are dealt by ranges, and places are counted by range."""
    dealt = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each group and range
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    same = [dealt[c].eqNullSafe(start[c]) for c in by] + [dealt["_part"] == start["_part"]]
    placed = dealt.withColumn("_r", F.row_number().over(own))
    same = [placed[c].eqNullSafe(start[c]) for c in by] + [placed["_part"] == start["_part"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return placed.join(start, on).select(*[placed[c] for c in rows.columns], (placed["_r"] - 1 + start["_start"]).cast("long").alias(name))


def negative_windows(turned: DataFrame, n: int, exclude: DataFrame | None = None, radius: int = 6, seed: str | Column = "0") -> DataFrame:
    """path, session_id, turn, uuid of up to n turns of each session, drawn by the seed and the session's name.

    Left out are a session's last turn, turns without an event that has an id, and those up to `radius` turns before a
    turn that has an event of `exclude` (uuid), itself included. uuid and session_id are those of a turn's first event
    that has them. The draw is a shuffle's first n steps over the turns that are left, by their numbers.
    """
    known = F.when(F.col("uuid").isNotNull() & F.col("session_id").isNotNull(), F.col("idx"))
    t = turned.groupBy("path", "turn").agg(F.min_by(F.struct("session_id", "uuid"), known).alias("anchor"), F.min(known).alias("place"))
    of = t.groupBy("path").agg(F.max("turn").alias("last"), F.min_by("anchor.session_id", "place").alias("session"))
    t = t.join(of, "path").where("turn < last and anchor is not null")
    if exclude is not None:
        hit = turned.join(exclude.select("uuid").where("uuid is not null").distinct(), "uuid", "left_semi").select("path", F.explode(F.sequence(F.col("turn") - radius, F.col("turn"))).alias("turn")).distinct()
        t = t.join(hit, ["path", "turn"], "left_anti")
    start = rng.seeded(F.concat(seed if isinstance(seed, Column) else F.lit(seed), F.lit(":"), F.col("session")))
    # a session is bounded by its file, so its turns are an array
    left = t.groupBy("path", "session").agg(F.array_sort(F.collect_list(F.struct("turn", "anchor"))).alias("left"))
    chosen = left.withColumn("at", rng.drawn(start, F.size("left"), F.lit(n)))
    picked = chosen.select("path", F.explode("at").alias("at"), "left").select("path", F.col("left")[F.col("at").cast("int")].alias("c"))
    return picked.select("path", "c.anchor.session_id", "c.turn", "c.anchor.uuid")


def around(turns: DataFrame, anchors: DataFrame, before: int, after: int, fold: bool = False) -> DataFrame:
    """Anchors (path, turn) with the turns around them: before, trigger, after (arrays of turn and prompt, in order).

    With `fold` there is no trigger: the anchor's turn is the last of those before, of which `before` stay.
    """
    near = anchors.select("path", "turn", F.explode(F.sequence(F.col("turn") - before, F.col("turn") + after)).alias("of")).distinct()
    met = near.join(turns.select("path", F.col("turn").alias("of"), "prompt"), ["path", "of"])
    item = F.struct(F.col("of").alias("turn"), "prompt")
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, item)))
    got = met.groupBy("path", "turn").agg(listed(F.col("of") < F.col("turn")).alias("b"), F.max(F.when(F.col("of") == F.col("turn"), item)).alias("trigger"), listed(F.col("of") > F.col("turn")).alias("after"))
    if not fold:
        return got.select("path", "turn", F.col("b").alias("before"), "trigger", "after")
    folded = F.concat("b", F.array_compact(F.array("trigger")))
    kept = F.slice(folded, F.greatest(F.size(folded) - before + 1, F.lit(1)), F.lit(max(before, 1))) if before else F.array().cast("array<struct<turn: bigint, prompt: string>>")
    return got.select("path", "turn", kept.alias("before"), "after")


def audit(rows: DataFrame, accepts: int, rejects: int, quotas: dict[str, int | None], remainder: str, share: float = 0.3, seed: str = "0") -> DataFrame:
    """key, kind, confidence, accepted, part of a drawn audit; part is `core` or `oversample`, of rows (key, kind, confidence, accepted).

    Each side gets, kind by kind in the quotas' order, as many rows as the quota says (None: all), and the remainder's
    kind what is then left of `accepts` or `rejects`. Of what a kind gets, a share (rounded half to even) are its least
    confident rows, ties by key, and the rest is drawn from the others, in the order of their keys. One generator goes
    through the accepted side, then the rejected one; a group that is taken whole draws nothing. Keys are unique.
    """
    if any(q is not None and q < 0 for q in quotas.values()):
        raise ValueError("a quota is negative")
    spark = rows.sparkSession
    base = rows.select("key", "kind", F.col("confidence").cast("double").alias("confidence"), "accepted").where("accepted is not null")
    sizes = {(r.accepted, r.kind): r.n for r in base.where(F.col("kind").isin(*quotas, remainder)).groupBy("accepted", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows a kind
    plan, used = [], 0
    for side, wanted in ((True, accepts), (False, rejects)):
        spent = 0
        for number, (kind, quota) in enumerate([*quotas.items(), (remainder, None)]):
            size = sizes.get((side, kind), 0)
            take = min(max(0, wanted - spent), size) if number == len(quotas) else size if quota is None else min(quota, size)
            spent += take
            over = 0 if take >= size else round(take * share)
            if take:
                plan.append((side, number, kind, take >= size, over, size - over, 0 if take >= size else take - over, used))
            used += 0 if take >= size else take - over
    groups = spark.createDataFrame(plan, "accepted boolean, number int, kind string, whole boolean, over int, pool long, core long, used long")
    each = base.join(F.broadcast(groups), ["accepted", "kind"])  # one row a side and kind
    whole = each.where("whole").select("key", "kind", "confidence", "accepted", F.lit("core").alias("part"))
    least = Window.partitionBy("accepted", "number").orderBy("confidence", "key")
    most = max((p[4] for p in plan), default=0)
    over = written(each.where("not whole").withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= most).where("_r <= over").select("key", "kind", "confidence", "accepted", "number"), "oversample")
    pool = each.where("not whole").join(over.select("accepted", "number", "key"), ["accepted", "number", "key"], "left_anti").select("key", "kind", "confidence", "accepted", "number")
    placed = ranked(pool, ["accepted", "number"], ["key"], "place")
    draws = groups.where("not whole").select("accepted", "number", F.explode(rng.drawn(rng.seeded(F.lit(seed)), F.col("pool"), F.col("core"), F.col("used"))).alias("place"))
    core = placed.join(F.broadcast(draws), ["accepted", "number", "place"]).select("key", "kind", "confidence", "accepted", F.lit("core").alias("part"))  # as many as are asked for
    out = written(whole.unionByName(core).unionByName(over.select("key", "kind", "confidence", "accepted", F.lit("oversample").alias("part"))), "audit")
    discard(over)
    return out


def exact_upper(hits: Column, n: Column, alpha: float = 0.05) -> Column:
    """The one-sided exact upper bound of a rate, by sixty halvings: where so few hits have the chance alpha. 1 if all are hits; null without rows."""

    def chance(p: Column) -> Column:
        """The logarithm of the chance of at most so many hits, by the recurrence of its terms, summed around the greatest."""
        q = F.log1p(-p)
        first = F.struct((n * q).alias("term"), (n * q).alias("top"), F.lit(1.0).alias("sum"))

        def add(s: Column, k: Column) -> Column:
            term = s.term + F.log((n - k) / (k + 1)) + F.log(p) - q
            return rng.let(term, lambda t: rng.let(F.greatest(s.top, t), lambda top: F.struct(t.alias("term"), top.alias("top"), (s["sum"] * F.exp(s.top - top) + F.exp(t - top)).alias("sum"))))

        places = F.when(hits > 0, F.sequence(F.lit(0).cast("long"), hits.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(places, first, add, lambda s: s.top + F.log(s["sum"]))

    def halve(s: Column, _: Column) -> Column:
        return rng.let((s.low + s.high) / 2, lambda mid: F.when(chance(mid) > F.log(F.lit(alpha)), F.struct(mid.alias("low"), s.high.alias("high"))).otherwise(F.struct(s.low.alias("low"), mid.alias("high"))))

    start = F.struct((hits / n).cast("double").alias("low"), F.lit(1.0).alias("high"))
    return F.when(n > 0, F.when(hits >= n, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: s.high)))


def audited_rates(judged: DataFrame, audited: DataFrame) -> DataFrame:
    """judged, accepted, precision, contamination, contamination_upper, recall_hat: what an audit tells of judged rows.

    `judged` has (key, accepted), `audited` (key, genuine) for the core of an audit. Precision is the share of genuine
    rows among audited accepts, contamination that among audited rejects; recall_hat weights both by how many rows were
    accepted and rejected. Without audited rows of a side its rate is null.
    """
    told = judged.select("key", "accepted").join(audited.select("key", F.col("genuine").cast("boolean").alias("genuine")), "key", "left")
    count = lambda test: F.count(F.when(test, 1))
    yes, seen = F.col("accepted"), F.col("genuine").isNotNull()
    c = told.agg(count(yes.isNotNull()).alias("judged"), count(yes).alias("accepted"), count(yes & seen).alias("a"), count(yes & F.col("genuine")).alias("ag"), count(~yes & seen).alias("r"), count(~yes & F.col("genuine")).alias("rg"))
    c = c.withColumn("precision", F.try_divide("ag", "a")).withColumn("contamination", F.try_divide("rg", "r")).withColumn("contamination_upper", exact_upper(F.col("rg"), F.col("r")))
    genuine = F.col("accepted") * F.col("precision") + (F.col("judged") - F.col("accepted")) * F.col("contamination")
    return c.select("judged", "accepted", "precision", "contamination", "contamination_upper", F.try_divide(F.col("accepted") * F.col("precision"), genuine).alias("recall_hat"))


def by_kind(rows: DataFrame) -> DataFrame:
    """kind, judged, accepted of rows (kind, accepted)."""
    return rows.groupBy("kind").agg(F.count("accepted").alias("judged"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))
