"""The audit of sources against Python's counters, and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from lorekeep.llm import divergence

SCHEMA = "text string, lang string, source string, term string, n int, total string, doc_id long"


def plain(rows, least, ranks):
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in ((t or "", lang or "", s or "") for t, lang, s in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text))
        groups.add((lang, source))
        for t in terms:
            n[lang, source, t] += 1
        for t in {*terms}:
            docs[lang, t] += 1
    out = []
    for lang, source in groups:
        kept = [t for (of, t), d in docs.items() if of == lang and d >= least]
        sources = [s for of, s in groups if of == lang]

        def shares(names):
            counts = {t: sum(n[lang, s, t] for s in names) for t in kept}
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c + 5) // total for t, c in counts.items()}

        own, all_ = shares([source]), shares(sources)
        pairs = [(sum(abs(own[t] - other[t]) for t in kept), s) for s in sources if s != source for other in [shares([s])]]
        terms = [(own[t] - all_[t], t) for t in kept if n[lang, source, t] and own[t] > all_[t]]
        for part, found, most in (("pair", pairs, 10**9), ("term", terms, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "ranks"), [(3, 50), (1, 2), (1000, 50)])
def test_equals_counters_and_sql(spark, tmp_path, least, ranks):
    rng = random.Random(9)
    words = ["The", "the", "Öl", "öl", "漢字", "x1y", "don't", "é", "ÀB", "z_z", "w" * 50]
    rows = [(" ".join(rng.choice(words[: 4 + k % 8]) for _ in range(k % 13)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])) for k in range(150)]
    rows += [(None, "xx", "a"), ("", "xx", None), ("123 !?", "only", "one"), ("the " * 20_000, "en", "long"), *[("copy of the copy", "en", "hot")] * 80]
    frame = spark.createDataFrame([(*r, "t", 1, "x", k) for k, r in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in divergence.audit(frame, least, ranks).collect()]
    assert sorted(got) == plain(rows, least, ranks)
    frame.select("text", "lang", "source").toPandas().to_parquet(tmp_path / "d.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    sql = divergence.SQL.replace(">= 30", f">= {least}").replace("rank <= 50", f"rank <= {ranks}")
    assert sorted(duck.sql(sql).fetchall()) == sorted(got)


def test_shuffled_groups_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    rows = [("a b a", "l", "s"), ("b c", "l", "t"), ("a", "m", "s")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(frame, 1, 50).collect()) == plain(rows, 1, 50)
    assert divergence.audit(frame.where("false")).count() == 0


def test_shares_hold_counts_beyond_a_long(spark):
    huge = 4 * 10**17
    r = spark.range(1).select(divergence.share(*[__import__("pyspark").sql.functions.lit(v).cast("long") for v in (huge, huge * 3, 1000)]).alias("p")).first()
    assert r.p == 1 + 10**9 * (huge + 5) // (huge * 3 + 5000)


def test_texts_longer_than_a_part_and_groups_of_one_batch(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["Ab", "aB", "ß", "Éa", "漢", "x" * 9, "k", "q"])
    rows = [(rng.choice([" ", "1", "\n", "\x7f", "'"]).join(word() for _ in range(k % 90)), rng.choice(["l", "m"]), rng.choice(["s", "t", None])) for k in range(60)]
    rows += [(None, "l", "s"), ("", None, None), ("42", "m", "u"), ("y" * 300 + " y", "l", "s"), ("y" * 300, "l", "t")]
    want = plain(rows, 2, 50)
    table = pa.table({k: [r[c] or "" for r in rows] for k, c in (("lang", 1), ("source", 2), ("text", 0))})
    counts = []
    for part in (16, 64, 1 << 20):
        monkeypatch.setattr(divergence, "PART", part)
        total = Counter()
        for b in divergence._counted(iter(table.to_batches(20))):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        counts.append(total)
    assert counts[0] == counts[1] == counts[2] and counts[0]["l", "t", "y" * 300, "docs"] == 1
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(frame, 2, 50).collect()) == want


def test_occurrences_are_not_exploded(spark):
    """A term's occurrences are counted before Spark makes rows of them."""
    frame = spark.createDataFrame([("a b a " * 1000, "l", "s")], "text string, lang string, source string")
    plan = divergence.term_counts(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
