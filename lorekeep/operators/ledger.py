"""Ledgers as tables: keyed inserts and upserts, time-ordered matches, verdict metrics and audit samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that an insert would add: the first of each key by `order`, if the target lacks it. Null keys are never equal, so all come in."""
    whole = [F.col(k).isNotNull() for k in keys]
    known = whole[0] if len(whole) == 1 else whole[0] & whole[1] if len(whole) == 2 else F.forall(F.array(*whole), lambda x: x)
    row = F.struct(*[c for c in rows.columns if c not in keys])
    first = rows.where(known).groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)
    return first.join(target.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows.where(~known))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], replaces: Column | None = None) -> DataFrame:
    """The target with rows put in (one per key). Where both have a key, the new row wins if `replaces` holds (default: always).

    `replaces` names old columns o.x and new ones n.x.
    """
    both = target.select(*keys, F.struct(*target.columns).alias("o")).join(rows.select(*keys, F.struct(*target.columns).alias("n")), keys, "full")
    wins = F.col("o").isNull() | (F.col("n").isNotNull() & (F.coalesce(replaces, F.lit(False)) if replaces is not None else F.lit(True)))
    return both.select(F.when(wins, F.col("n")).otherwise(F.col("o")).alias("row")).select("row.*")


def record_verdicts(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdicts by (dedup_key, role, prompt_version): a full one replaces a summary, all other repeats are ignored."""
    return upsert(target, rows, ["dedup_key", "role", "prompt_version"], (F.col("o.fidelity") == "summary") & (F.col("n.fidelity") == "full"))


def nearest_before(left: DataFrame, right: DataFrame, keys: list[str], ts: str, row_id: str, within: float, either: bool = False) -> DataFrame:
    """Each left row with `match_id`, the right row of its keys that is nearest in time: at or before it (or on either side), within so many seconds.

    Of equal distances the greater id is taken. Time is cut into cells as long as the reach, so the join is an
    equality join on keys and two or three cells, and no key's rows meet in full.
    """
    cell = lambda c, by=0: (F.floor(F.unix_micros(c) / (within * 1e6)) + by).cast("long")
    steps = (-1, 0, 1) if either else (-1, 0)
    l = left.select(*keys, F.col(row_id).alias("_l"), F.col(ts).alias("_lt"), F.explode(F.array(*[cell(F.col(ts), s) for s in steps])).alias("_cell"))
    r = right.select(*keys, F.col(row_id).alias("_r"), F.col(ts).alias("_rt"), cell(F.col(ts)).alias("_cell"))
    gap = F.unix_micros("_lt") - F.unix_micros("_rt")
    met = l.join(r, [*keys, "_cell"]).withColumn("_gap", gap).where((F.abs("_gap") <= within * 1e6) & (F.lit(either) | (F.col("_gap") >= 0)))
    best = met.groupBy("_l").agg(F.max_by("_r", F.struct(-F.abs("_gap"), F.col("_r"))).alias("match_id"))
    return left.join(best, left[row_id] == best["_l"], "left").drop("_l")


def flips(first: DataFrame, second: DataFrame, key: str, side: str) -> DataFrame:
    """Keys that two passes judged differently."""
    return first.select(key, F.col(side).alias("before")).join(second.select(key, F.col(side).alias("after")), key).where("before != after")


def gate(expected: DataFrame, actual: DataFrame, key: str, side: str) -> DataFrame:
    """Each expected key with whether the actual side is there and the same."""
    told = expected.select(key, F.col(side).alias("expected")).join(actual.select(key, F.col(side).alias("actual")), key, "left")
    return told.withColumn("missing", F.col("actual").isNull()).withColumn("agrees", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def metrics(judged: DataFrame, predicted: str, truth: str) -> DataFrame:
    """n, precision, contamination (wrong among the accepted), recall."""
    cell = lambda p, t: F.count(F.when((F.col(predicted) == p) & (F.col(truth) == t), 1))
    counts = judged.agg(F.count(F.lit(1)).alias("n"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return counts.select("n", share("tp", "fp").alias("precision"), share("fp", "tp").alias("contamination"), share("tp", "fn").alias("recall"))


def upper_bound(failures: int, n: int, confidence: float = 0.95) -> float:
    """The one-sided exact upper bound of a rate: where so few failures are just as unlikely as 1 - confidence, by bisection."""
    if n == 0 or failures >= n:
        return 1.0

    def at_most(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(failures + 1)]
        top = max(logs)
        return top + math.log(math.fsum(math.exp(x - top) for x in logs))

    low, high = failures / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(mid) > math.log(1 - confidence) else (low, mid)
    return high


def audit_sample(rows: DataFrame, by: list[str], quota: int, key: str, doubt: str, doubtful: int, seed: str = "7") -> DataFrame:
    """Of each stratum the `doubtful` least confident rows, and `quota` others in an order that a hash of the seed and key gives; `why` says which."""
    doubted = Window.partitionBy(*by).orderBy(F.col(doubt), F.col(key))
    ranked = rows.withColumn("_d", F.row_number().over(doubted)).withColumn("why", F.when(F.col("_d") <= doubtful, "doubtful").otherwise("uniform"))
    drawn = Window.partitionBy(*by, "why").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    return ranked.withColumn("_r", F.row_number().over(drawn)).where((F.col("why") == "doubtful") | (F.col("_r") <= quota)).drop("_d", "_r")


def alike_keys(vectors: DataFrame, key: str, vector: str, limit: float) -> DataFrame:
    """Pairs of keys whose normalised mean vectors are more alike than the limit. There is one mean per key; their pairs are all compared.

    Meant for tables of some thousand keys: the means, not the vectors, are paired.
    """
    each = vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = each.withColumn("u", F.try_divide("m", F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))))  # null for a zero mean
    a, b = means.select("i", F.col(key).alias("a"), F.col("u").alias("x")), means.select("i", F.col(key).alias("b"), F.col("u").alias("y"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("similarity")).where(F.col("similarity") > limit)


#: A ledger of corrections: what an agent wrote, and who said otherwise.
CORRECTIONS = "id long, ts_ms long, session_id string, anchor_uuid string, repo string, incorrect_digest string, text string"


def same_schema(rows: DataFrame, wanted: str) -> DataFrame:
    """The rows if their columns are those of a schema, in name, type and order; else an error that names what differs."""
    from pyspark.sql.types import StructType

    have, want = [(f.name, f.dataType.simpleString()) for f in rows.schema], [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(wanted)]
    if have != want:
        raise ValueError(f"the ledger has {sorted({*have} - {*want})} where {sorted({*want} - {*have})} is wanted, or another order")
    return rows


def selected(ledger: DataFrame, session: str | None = None, repo: str | None = None, since: int | None = None, between: tuple[int, int] | None = None, anchor: tuple[str, str] | None = None, digest: str | None = None) -> DataFrame:
    """Rows of a ledger of corrections by its session, the name in its repository's JSON, times, anchor (session, uuid) and digest.

    `since` is strictly after, `between` includes both ends. Unknown values match nothing.
    """
    tests = [
        (session, lambda: F.col("session_id") == session), (repo, lambda: F.get_json_object("repo", "$.name") == repo), (since, lambda: F.col("ts_ms") > since), (between, lambda: F.col("ts_ms").between(*between)),
        (anchor, lambda: (F.col("session_id") == anchor[0]) & (F.col("anchor_uuid") == anchor[1])), (digest, lambda: F.col("incorrect_digest") == digest),
    ]
    for given, test in tests:
        if given is not None:
            ledger = ledger.where(test())
    return ledger


def paged(rows: DataFrame, limit: int, offset: int = 0, newest: bool = False) -> DataFrame:
    """Rows in the order of ts_ms and id, or the newest first, from an offset on."""
    order = [F.desc("ts_ms"), F.desc("id")] if newest else ["ts_ms", "id"]
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_decisions(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """Corrections with the decisions (decision_id, tool_digest, verdict) on the same tool call."""
    return ledger.join(decisions.select("decision_id", F.col("tool_digest").alias("incorrect_digest"), "verdict"), "incorrect_digest")


def record_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """The table of files (path, mtime) with newly seen ones put in; a path's new time replaces its old one."""
    return upsert(files.select("path", "mtime"), seen.groupBy("path").agg(F.max("mtime").alias("mtime")), ["path"])


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
