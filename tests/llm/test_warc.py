"""Archives: segments in any state, revisits, null ids and long pages."""

import hashlib

from pyspark.sql import functions as F

from lorekeep.llm import warc


def test_segments_missing_repeated_misordered_or_of_a_wrong_total(spark):
    block = warc.frame(b"payload " * 3000)
    cuts = [block[a : a + warc.SEGMENT] for a in range(0, len(block), warc.SEGMENT)]

    def rows(name, numbers, total):
        return [(f"{name}{k}", "response" if k == 1 else "continuation", name, k, total if k == len(cuts) else None, 1 if k == 1 else None, None, "sha1:x" if k == 1 else None, cuts[k - 1]) for k in numbers]

    n = list(range(1, len(cuts) + 1))
    cases = {"good": (n, len(block)), "turned": (n[::-1], len(block)), "missing": (n[:1] + n[2:], len(block)), "twice": (n + n[1:2], len(block)), "headless": (n[1:], len(block)), "long": (n, len(block) + 1), "endless": (n[:-1], 0)}
    table = [r for name, (numbers, total) in cases.items() for r in rows(name, numbers, total)]
    table += [("alone", "response", "alone", None, None, 2, None, "sha1:y", warc.frame(b"x")), ("broken", "response", "broken", None, None, 3, None, "sha1:z", block[:500])]
    got = {r.origin: (r.complete, r.payload and bytes(r.payload)) for r in warc.reassemble(spark.createDataFrame(table, warc.RECORDS)).collect()}
    assert {k for k, v in got.items() if v[0]} == {"good", "turned", "alone"} and len(got) == 9
    assert got["turned"][1] == got["good"][1] == b"payload " * 3000 and got["alone"][1] == b"x" and got["missing"][1] is None


def test_round_trip_of_nulls_repeats_and_long_pages(spark):
    same, longer = "ü" * 700, "p" * 50_000
    pages = [(1, "u", same), (5, "u", same), (None, "u", same), (3, None, None), (4, "a b\n", ""), (7, "u", longer), (7, "u", longer), (8, "u", longer), (None, "v", "n" * 1200), (None, "v", "n" * 1200), (9, "u", "short"), (10, "u", "short")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("keeper", F.lit(1)).repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect())
    keeper = {same: 5, longer: 8}
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        again = html in keeper and keeper[html] != i
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", keeper[html] if again else None))
    assert got == sorted(want)
    assert warc.round_trip(frame.where("false")).count() == 0
