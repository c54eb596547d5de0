"""Questions about sessions as a host asks them, all in one pass over events and one over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import markers
from lorekeep.operators import session


def event_facts(turned: DataFrame, prefix: str = "", first: int = 1) -> DataFrame:
    """path, event_count, turn_count, user_messages, assistant_messages, has_users, all_sidechain, prefixed, first_prompt, last_prompt, prompts, workflow_text.

    all_sidechain: there are users, and all are of sidechains. prefixed: a user text among the first `first` events
    begins with the prefix. Prompts are those of turns that a prompt opened, in order; workflow_text is all texts of
    users and assistants, a line each. A session lies in one file, so its prompts and texts are arrays.
    """
    user, said = F.col("kind") == "user", F.col("kind").isin("user", "assistant")
    placed = turned.withColumn("_at", F.row_number().over(session.in_order()))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("idx", "text")))), lambda x: x.text)
    out = placed.groupBy("path").agg(
        F.count(F.lit(1)).alias("event_count"), (F.max("turn") - F.min("turn") + 1).alias("turn_count"), F.count(F.when(user, 1)).alias("user_messages"), F.count(F.when(F.col("kind") == "assistant", 1)).alias("assistant_messages"), F.max(user).alias("has_users"),
        F.coalesce(F.min(F.when(user, F.col("is_sidechain"))), F.lit(False)).alias("all_sidechain"), F.max(user & (F.col("_at") <= first) & F.col("text").startswith(prefix)).alias("prefixed"), listed(F.col("opens")).alias("prompts"), listed(said & ~markers.is_blank(F.col("text"))).alias("_said"),
    )
    return out.select("*", F.try_element_at("prompts", F.lit(1)).alias("first_prompt"), F.try_element_at("prompts", F.lit(-1)).alias("last_prompt"), F.array_join("_said", "\n").alias("workflow_text")).drop("_said")


def is_source(root: str, suffixes: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), path: str = "file_path") -> Column:
    """A file under the root that is no test, and has none of the endings and, below the root, none of the beginnings."""
    p = F.col(path)
    rest = F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, F.lit(len(root.rstrip("/")) + 2), F.length(p))).otherwise(p)
    out = session.under(root, path) & ~session.is_test(path)
    for s in suffixes:
        out = out & ~p.endswith(s)
    for s in prefixes:
        out = out & ~rest.startswith(s)
    return F.coalesce(out, F.lit(False))


def runs(*argv: str) -> Column:
    """A command whose words begin with these. Words are parted by white space, without a shell's quoting."""
    words = F.split(F.trim(F.col("command")), r"\s+")
    return F.coalesce(F.slice(words, 1, len(argv)) == F.array(*[F.lit(a) for a in argv]), F.lit(False))


def call_facts(calls: DataFrame, tests: dict[str, Column] | None = None, pending: str = "", skills: tuple[str, ...] = ()) -> DataFrame:
    """path, has_edit, has_error, failures, has_skill, has_skill_suffix, has_pending, unresolved, files, edited, and each test of a call.

    Failed calls are hidden but from has_error and failures. has_pending and unresolved ask for calls that `pending`
    names and that have no result; a skill's suffix is what stands behind its first colon.
    """
    shown, no = ~F.col("is_error"), F.lit(False)
    edit = F.col("hunks").isNotNull() & F.col("file_path").isNotNull()
    waits = F.col("pending") & (session.named(pending) if pending else F.lit(True))
    tail = F.when(F.instr("skill", ":") > 0, F.substring(F.col("skill"), F.instr("skill", ":") + 1, F.length("skill"))).otherwise(F.col("skill"))
    any_ = lambda test: F.max(shown & F.coalesce(test, no))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(shown & test, F.struct("idx", "at", "file_path")))), lambda x: x.file_path)
    return calls.groupBy("path").agg(
        any_(edit).alias("has_edit"), F.max("is_error").alias("has_error"), F.count(F.when(F.col("is_error"), 1)).alias("failures"), any_(F.col("skill").isin(*skills) if skills else no).alias("has_skill"), any_((F.col("skill").isin(*skills) | tail.isin(*skills)) if skills else no).alias("has_skill_suffix"),
        any_(waits).alias("has_pending"), F.count(F.when(shown & waits, 1)).alias("unresolved"), listed(F.col("file_path").isNotNull()).alias("files"), listed(edit).alias("edited"), *[any_(t).alias(n) for n, t in (tests or {}).items()],
    )


def overrides(turned: DataFrame, calls: DataFrame, token: str, invalidated_by: str) -> DataFrame:
    """path, has_override: a user said the token behind the last call that ends it."""
    said = turned.where((F.col("kind") == "user") & F.coalesce(F.col("text").contains(token), F.lit(False))).groupBy("path").agg(F.max("idx").alias("_said"))
    ended = calls.where(session.named(invalidated_by) & ~F.col("is_error")).groupBy("path").agg(F.max("idx").alias("_ended"))
    paths = turned.select("path").distinct()
    told = paths.join(said, "path", "left").join(ended, "path", "left")
    return told.select("path", (F.col("_said").isNotNull() & (F.coalesce("_ended", F.lit(-1)) < F.col("_said"))).alias("has_override"))


def winners(calls: DataFrame) -> DataFrame:
    """path, key, name, first, idx, at: for each call id (its time, if it is empty) its first place among the calls, and its last occurrence."""
    key = F.when(F.coalesce(F.col("call_id"), F.lit("")) == "", F.col("ts").cast("string")).otherwise(F.col("call_id"))
    placed = calls.withColumn("key", key).withColumn("_place", F.row_number().over(Window.partitionBy("path").orderBy("idx", "at")) - 1)
    last = F.max(F.struct("idx", "at", "name"))
    return placed.groupBy("path", "key").agg(F.min("_place").cast("long").alias("first"), last.alias("l")).select("path", "key", "l.name", "first", "l.idx", "l.at")


def signal_texts(turned: DataFrame, window: int | None, origin: str = "assistant", thinking: bool = False) -> DataFrame:
    """path, idx, text: the last `window` texts of a session (None: those of its current turn) of the assistant, or of any origin; thoughts too, if asked."""
    rows = turned if window is not None else session.current_turn(turned)
    who = F.col("kind") == "assistant" if origin == "assistant" else F.col("kind").isin("user", "assistant")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.col("thinking").alias("text")), F.struct(F.lit(1).alias("k"), "text")) if thinking else F.array(F.struct(F.lit(1).alias("k"), "text"))
    each = rows.where(who).select("path", "idx", F.explode(parts).alias("p")).select("path", "idx", "p.k", "p.text").where(~markers.is_blank(F.col("text")))
    if window is not None:
        newest = Window.partitionBy("path").orderBy(F.desc("idx"), F.desc("k"))
        each = each.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= window)
    return each.select("path", "idx", "text")


def meta_messages(turned: DataFrame, contains: str | None = None) -> DataFrame:
    """path, turn, idx, text of meta user events and of queued commands that came by a channel."""
    channel = (F.col("kind") == "attachment") & (F.col("detail") == "queued_command") & (F.get_json_object("payload", "$.attachment.origin.kind") == "channel")
    text = F.when(F.col("kind") == "attachment", F.get_json_object("payload", "$.attachment.prompt")).otherwise(F.col("text"))
    out = turned.where(((F.col("kind") == "user") & F.col("is_meta")) | F.coalesce(channel, F.lit(False))).select("path", "turn", "idx", text.alias("text"))
    return out if contains is None else out.where(F.col("text").contains(contains))
