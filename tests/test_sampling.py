"""Draws against a plain generator, audits against a plain draw, bounds against sums of binomial terms."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import rng
from lorekeep.operators import sampling, session
from lorekeep.sources.sessions import events
from tests.test_sessions import agent, user
from tests.test_trees import lines

MASK = 2**64 - 1


class Plain:
    def __init__(self, material):
        self.state = int.from_bytes(hashlib.sha256(material.encode()).digest()[:8], "little")

    def number(self):
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    def draw(self, size, k):
        pool = list(range(size))
        for i in range(k):
            bound = size - i
            n = self.number()
            while n < (1 << 64) % bound:
                n = self.number()
            j = i + n % bound
            pool[i], pool[j] = pool[j], pool[i]
        return pool[:k]


def test_numbers_and_draws_of_a_hundred_seeds(spark):
    rows = [(f"{k}:s", 1 + 7 * k % 40, k % 9) for k in range(100)]
    frame = spark.createDataFrame(rows, "m string, size int, k int")
    start = rng.seeded(F.col("m"))
    for r in frame.select("*", start.cast("string").alias("seed"), rng.number(start, F.lit(3)).cast("string").alias("third"), rng.drawn(start, F.col("size"), F.col("k")).alias("d"), rng.drawn(start, F.col("size"), F.lit(2), F.lit(5)).alias("later")).collect():
        p = Plain(r.m)
        assert int(r.seed) == p.state
        assert r.d == Plain(r.m).draw(r.size, min(r["k"], r.size))
        assert [p.number() for _ in range(5)][2] == int(r.third)
        assert r.later == p.draw(r.size, min(2, r.size))


def test_windows_equal_a_plain_draw(spark):
    files, plain = {}, random.Random(3)
    for s in range(12):
        recs = []
        for k in range(plain.randrange(1, 25)):
            recs.append(user(k, f"prompt {k}", session_id=f"s{s}"))
            recs += [agent(k + 30, {"type": "text", "text": "x"}, session_id=f"s{s}")] * (k % 2)
        files[f"p{s}"] = recs
    turned = session.with_turns(events(lines(spark, files)))
    hit = {f"s{s}{plain.randrange(25)}" for s in range(12)}
    exclude = spark.createDataFrame([(h,) for h in hit] + [(None,), ("nobody",)], "uuid string")
    for seed in ("0", "11"):
        want = []
        for s in range(12):
            n = sum(r["type"] == "user" for r in files[f"p{s}"])
            bad = {k for k in range(n) if f"s{s}{k}" in hit}
            left = [k for k in range(n - 1) if not any(0 <= b - k <= 2 for b in bad)]
            want += [(f"p{s}", f"s{s}", k, f"s{s}{k}") for k in (left[i] for i in Plain(f"{seed}:s{s}").draw(len(left), min(4, len(left))))]
        got = sampling.negative_windows(turned, 4, exclude, radius=2, seed=seed)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    near = {(r.path, r.turn): r for r in sampling.around(session.turns(turned), got, before=2, after=1, fold=True).collect()}
    for path, _, turn, _ in want:
        r = near[path, turn]
        assert [b.turn for b in r.before] == [t for t in (turn - 1, turn) if t >= 0] and [a.turn for a in r.after] == [turn + 1] and r.before[-1].prompt == f"prompt {turn}"
    whole = sampling.around(session.turns(turned), got, before=2, after=1).where("turn >= 2").first()
    assert [b.turn for b in whole.before] == [whole.turn - 2, whole.turn - 1] and whole.trigger.turn == whole.turn


def plain_audit(rows, accepts, rejects, quotas, remainder, share, seed):
    g, out = Plain(seed), []
    for side, n in ((True, accepts), (False, rejects)):
        mine = sorted(r for r in rows if r[3] == side)
        spent = 0
        for last, (kind, quota) in [*((False, q) for q in quotas.items()), (True, (remainder, None))]:
            group = [r for r in mine if r[1] == kind]
            take = min(max(0, n - spent), len(group)) if last else len(group) if quota is None else min(quota, len(group))
            spent += take
            if take >= len(group):
                out += [(r[0], "core") for r in group]
                continue
            over = sorted(group, key=lambda r: (r[2], r[0]))[: round(take * share)]
            pool = [r for r in group if r not in over]
            out += [(pool[i][0], "core") for i in g.draw(len(pool), take - len(over))] + [(r[0], "oversample") for r in over]
    return sorted(out)


@pytest.mark.parametrize("seed", ["0", "42"])
def test_audits_equal_a_plain_draw(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{i:04d}", r.choice(["a", "a", "b", "c", "rest", "rest", "rest", "other"]), round(r.random(), 1), r.random() < 0.6) for i in range(400)]
    frame = spark.createDataFrame(rows, "key string, kind string, confidence double, accepted boolean").repartition(7)
    quotas = {"a": 15, "b": None, "c": 1000, "none": 3}
    for accepts, rejects, share in ((120, 60, 0.25), (10, 300, 0.5), (90, 45, 0.0)):
        got = sampling.audit(frame, accepts, rejects, quotas, "rest", share, seed)
        assert sorted((x.key, x.part) for x in got.collect()) == plain_audit(rows, accepts, rejects, quotas, "rest", share, seed)
    assert sampling.audit(frame.where("false"), 5, 5, quotas, "rest").count() == 0
    with pytest.raises(ValueError):
        sampling.audit(frame, 5, 5, {"a": -1}, "rest")


def test_ranks_of_a_group_that_holds_nearly_all(spark):
    rows = [(None if k % 50 == 0 else "hot", f"{(k * 37) % 3001:05d}") for k in range(3001)]
    got = sampling.ranked(spark.createDataFrame(rows, "g string, k string").repartition(5), ["g"], ["k"], "place").collect()
    for g in (None, "hot"):
        mine = sorted((r.place, r["k"]) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for x, k in rows if x == g)


def test_bounds_and_rates(spark):
    cases = [(0, 100), (3, 50), (7, 9), (5, 5), (0, 0), (40, 2000)]
    got = spark.createDataFrame(cases, "h long, n long").select("*", sampling.exact_upper(F.col("h"), F.col("n")).alias("u")).collect()
    for r in got:
        if r.n == 0:
            assert r.u is None
        elif r.h == r.n:
            assert r.u == 1.0
        else:
            assert abs(math.fsum(math.comb(r.n, k) * r.u**k * (1 - r.u) ** (r.n - k) for k in range(r.h + 1)) - 0.05) < 1e-6
    judged = spark.createDataFrame([(k, k < 60) for k in range(100)], "key int, accepted boolean")
    audited = spark.createDataFrame([(k, k % 5 != 0) for k in range(20)] + [(k, k == 61) for k in range(60, 70)], "key int, genuine boolean")
    r = sampling.audited_rates(judged, audited).first()
    assert (r.judged, r.accepted, r.precision, r.contamination) == (100, 60, 0.8, 0.1) and abs(r.recall_hat - 48 / 52) < 1e-12 and 0.39 < r.contamination_upper < 0.40
    none = sampling.audited_rates(judged, audited.where("false")).first()
    assert none.precision is None and none.contamination_upper is None and none.recall_hat is None
