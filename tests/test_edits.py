"""Patches, diffs, corrections and writes against plain versions."""

import itertools
import posixpath

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import paths
from lorekeep.operators import edits, session
from lorekeep.sources.sessions import events
from tests.test_sessions import agent, done, rec, use, user
from tests.test_trees import lines

GOOD = "*** Begin Patch\n*** Update File: a.rs\n*** Move to: b.rs\n@@ fn x\n ctx\n-old\n+new\n\n@@\n-gone\n*** Add File: c.rs\n+hello\n+@@ kept\n*** Delete File: d.rs\n*** Update File: e:f.rs\nbare\n+n\n*** End Patch\n"
WANT = [("a.rs", "update", "b.rs", [("ctx\nold\n", "ctx\nnew\n"), ("gone", "")]), ("c.rs", "add", None, [("", "hello\n@@ kept")]), ("d.rs", "delete", None, []), ("e:f.rs", "update", None, [("bare", "bare\nn")])]
BAD = [
    None, "", "*** Begin Patch", "x\n" + GOOD, GOOD + "more", GOOD.replace("*** End Patch\n", ""), "*** Begin Patch\nstray\n*** Add File: a\n*** End Patch", "*** Begin Patch\n*** Delete File: a\nbody\n*** End Patch", "*** Begin Patch\n*** Add File: a\n*** Move to: b\n*** End Patch",
    "*** Begin Patch\n*** Update File: \n*** End Patch", "*** Begin Patch\n*** Update File: a\n*** Move to: \n*** End Patch", "*** Begin Patch\n*** Odd File: a\n*** End Patch",
]


def test_patches_and_diffs(spark):
    cases = [GOOD, GOOD.replace("\n", "\r\n"), GOOD + "\n\n", "*** Begin Patch\n*** End Patch", *BAD]
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r["k"]: [(e.file_path, e.kind, e.move_path, [(h.old, h.new) for h in e.hunks]) for e in r.p] for r in frame.select("k", edits.patched(F.col("t")).alias("p")).collect()}
    assert got == {k: WANT if k < 3 else [] for k in range(len(cases))}
    diff = "diff --git a b\n--- a/x\n+++ b/x\n@@ -1,2 +1 @@ f\n-one\n-two\n+three\n ctx\n@@ -9 +9 @@\n+only\n"
    shown = spark.createDataFrame([(diff,), ("no diff",), ("@@",)], "t string").select(edits.diff_hunks(F.col("t")).alias("h")).collect()
    assert [[(h.old, h.new) for h in r.h] for r in shown] == [[("one\ntwo", "three"), ("", "only")], [], [("", "")]]


def test_paths(spark):
    folders = ["/r", "/r/s", "/r-x/s", "/r/.claude/worktrees/w", "/r/.claude/worktrees/w/s", "/r/.claude/worktrees/", "/", "/q"]
    files = ["a.py", "/r/a.py", "../a.py", "./b/../a.py", "/r/../r//a.py", "../../../../../x", "/r", "/r/.claude/worktrees/v/a.py", "../../../a.py"]
    for fn in ("tree", "relative"):
        rows = list(itertools.product(files, [*folders, None]))
        frame = spark.createDataFrame(rows, "f string, c string")
        if fn == "tree":
            got = spark.createDataFrame([(f,) for f in folders], "c string").select("c", paths.tree_of(F.col("c"), "/r").alias("t")).collect()
            assert {r.c: r.t for r in got} == {"/r": "main", "/r/s": "main", "/r-x/s": None, "/r/.claude/worktrees/w": "worktree:w", "/r/.claude/worktrees/w/s": "worktree:w", "/r/.claude/worktrees/": None, "/": None, "/q": None}
            continue
        for r in frame.select("f", "c", paths.relative(F.col("f"), F.col("c"), "/r").alias("p")).collect():
            whole = "/" + posixpath.normpath("/" + (r.f if r.f.startswith("/") else f"{r.c or '/r'}/{r.f}")).strip("/")
            parts = whole.split("/")
            want = None
            if whole.startswith("/r/.claude/worktrees/"):
                want = (f"worktree:{parts[4]}", "/".join(parts[5:])) if len(parts) > 5 else None
            elif whole.startswith("/r/"):
                want = ("main", whole[3:])
            assert (tuple(r.p) if r.p else None) == want, (r.f, r.c)


def edit(i, old, new, file="/r/a.py"):
    return use(i, "Edit", file_path=file, old_string=old, new_string=new)


PATCH = "*** Begin Patch\n*** Update File: /r/a.py\n@@\n-two\n-zwei\n+drei\n*** Add File: rel.md\n+x\n*** End Patch"
LOG = [
    user(0, "start"), agent(1, edit("1", "none", "one\ntwo"), edit("2", "one", "uno")), agent(2, edit("3", "two\n\n one", "zwei"), edit("4", "one", "x", "/r/b.py")), user(3, "second"),
    agent(4, {**use("5", "apply_patch"), "input": PATCH}, cwd="/r/sub"), user(5, "third"), user(6, "fourth"), agent(7, use("6", "MultiEdit", file_path="/r/a.py", edits=[{"old_string": "q", "new_string": "r"}, {"old_string": "drei\none", "new_string": ""}])),
]


@pytest.fixture(scope="module")
def turned(spark):
    files = {"s": LOG, "t": [user(0, " ", session_id="t"), user(1, "[Request interrupted by user]", session_id="t"), agent(50, use("9", "Write", file_path="a.py", content="all"), session_id="t", cwd="/r/.claude/worktrees/w"), agent(51, use("8", "Bash", command="make"), use("7", "Bash", command="ls"), session_id="t", cwd="/r"), user(52, [done("9")], session_id="t")], "u": [user(59, "elsewhere", session_id="u", cwd="/q"), agent(59, use("b", "Bash", command="pwd"), session_id="u", cwd="/q")]}
    return session.with_turns(events(lines(spark, files))).cache()


def test_corrections_equal_a_plain_match(spark, turned):
    e = edits.edits(turned)
    rows = sorted((r.path, r.idx, r["at"], r.nth, r.file_path, r.turn, [(h.old, h.new) for h in r.hunks]) for r in e.collect())
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [("s", 1, 0, 0, "/r/a.py"), ("s", 1, 1, 0, "/r/a.py"), ("s", 2, 0, 0, "/r/a.py"), ("s", 2, 1, 0, "/r/b.py"), ("s", 4, 0, 0, "/r/a.py"), ("s", 4, 0, 1, "rel.md"), ("s", 7, 0, 0, "/r/a.py"), ("t", 2, 0, 0, "a.py")]

    def share(a, b):
        new, old = ([" ".join(x.split()) for x in t.split("\n") if x.strip()] for t in (a[1], b[0]))
        return sum(x in old for x in new) / len(new) if new else 0.0

    for ahead in (1, 3):
        want = []
        for a in rows:
            after = [b for b in rows if b[0] == a[0] and b[4] == a[4] and b[1] > a[1] and b[5] - a[5] <= ahead]
            scored = sorted(((max((share(x, y) for x in a[6] for y in b[6]), default=0.0), b) for b in after), key=lambda s: (-s[0], s[1][1:4]))
            want += [(*a[1:4], *b[1:4], round(s, 9), k) for k, (s, b) in enumerate((s for s in scored if s[0] > 0), 1)]
        got = [(r.idx, r["at"], r.nth, r.c_idx, r.c_at, r.c_nth, round(r.overlap, 9), r["rank"]) for r in edits.corrections(e, ahead).collect()]
        assert sorted(got) == sorted(want) and len(want) >= 3
    before = edits.edits_before(e, turned.where("path = 's' and idx = 4").select("path", "turn", "idx"), lookback=1).orderBy("back").collect()
    assert [(r.idx, r["at"]) for r in before] == [(2, 1), (2, 0), (1, 1), (1, 0)]
    pairs = edits.harvest(e, turned.where("path = 's' and idx = 6").select("path", "turn", "idx"), most=3).orderBy("back").collect()
    assert [(r.idx, r.nth, r.c_idx) for r in pairs] == [(4, 1, None), (4, 0, 7), (2, 0, None)]


def test_writes_and_who_may_have_written(spark, turned):
    e = edits.edits(turned)
    w = {(r.rel, r.path, r.tree): (r.writes, r.tools, r.first_prompt, r.place) for r in edits.writes(e, turned, "/r").collect()}
    assert w == {("a.py", "s", "main"): (5, ["Edit", "apply_patch", "MultiEdit"], "start", 2), ("a.py", "t", "worktree:w"): (1, ["Write"], "[Request interrupted by user]", 1), ("b.py", "s", "main"): (1, ["Edit"], "start", 1), ("sub/rel.md", "s", "main"): (1, ["apply_patch"], "start", 1)}
    some = edits.writes(e, turned, "/r", since="2024-01-01 00:02:00", until="2024-01-01 00:07:00").where("rel = 'a.py'").collect()
    assert [(r.path, r.writes) for r in some] == [("s", 2)]
    at = lambda m: f"2024-01-01 00:{m}:00"
    files = spark.createDataFrame([("a.py", at("51")), ("gen.o", at("51")), ("odd", at("59")), ("never", "2020-01-01 00:00:00"), ("early.o", at("10"))], "rel string, m string").select("rel", F.col("m").cast("timestamp").alias("mtime"))
    got = {r.rel: (r.verdict, r.session_id, r.tool, [(c.session_id, list(c.commands)) for c in r.candidates]) for r in edits.attribute(files, e, turned, "/r", suspects=1, cell=600).collect()}
    assert got == {"a.py": ("written", "t", "Write", []), "gen.o": ("generated", None, None, [("t", ["ls"])]), "odd": ("external", None, None, []), "never": ("external", None, None, []), "early.o": ("generated", None, None, [("t", [])])}
