"""Scores of conversations around a model: words with a polarity, negation within a clause, and stages before and behind it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.rng import let
from lorekeep.operators.spec import bare

# fixed values: a word counts from this magnitude on, and a hit is this strong
MIN_MAGNITUDE, FLOOR = 2, 3
NEGATORS = ("not", "no", "never", "n't", "cannot", "without", "nobody", "nothing", "neither", "nor")
CONJUNCTIONS = ("and", "or", "but", "so", "because", "if", "while", "although", "though", "unless", "since", "when", "that", "whether")
#: Lexicons up to so many rows are broadcast.
BROADCAST_WORDS = 200_000
_TOKEN = r"[\p{L}\p{N}]+(?=n['’]t\b)|n['’]t\b|[\p{L}\p{N}]+(?:['’][\p{L}]+)?|[^\s\p{L}\p{N}]"
_FLAGGED = "array<struct<token: string, negated: boolean>>"


def tokens(text: Column) -> Column:
    """(token, negated) of a text, in order, in lower case; n't stands by itself.

    A negator turns the words behind it up to a mark, a conjunction or the end of the line; it is never turned itself.
    There is no tagger here: all words but conjunctions count as content.
    """
    found = F.regexp_extract_all(F.lower(F.regexp_replace(text, "\n+", " . ")), F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(False).alias("active"), F.array().cast(_FLAGGED).alias("out"))

    def step(s: Column, raw: Column) -> Column:
        t = F.replace(raw, F.lit("’"), F.lit("'"))
        negator, ends = t.isin(*NEGATORS), ~t.rlike(r"[\p{L}\p{N}]") | t.isin(*CONJUNCTIONS)
        return F.struct((negator | (s.active & ~ends)).alias("active"), F.concat(s.out, F.array(F.struct(t.alias("token"), (s.active & ~ends & ~negator).alias("negated")))).alias("out"))

    return F.aggregate(F.coalesce(found, F.array().cast("array<string>")), start, step, lambda s: s.out)


def polarities(lexicon: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """word, score of what counts: the lexicon's words of some magnitude, and all overrides, which come first."""
    own = lexicon.where(F.abs("score") >= MIN_MAGNITUDE).select("word", F.col("score").cast("int").alias("score"))
    if overrides is None:
        return own.groupBy("word").agg(F.max_by("score", F.abs("score")).alias("score"))
    first = overrides.select("word", F.col("score").cast("int").alias("score"))
    return own.join(first.select("word"), "word", "left_anti").unionByName(first).groupBy("word").agg(F.max_by("score", F.abs("score")).alias("score"))


def hits(texts: DataFrame, words: DataFrame) -> DataFrame:
    """key, n of texts (key, n, text) that have a strong word, with `negative` and `positive`; a negated word counts the other way."""
    small = F.broadcast if words.count() <= BROADCAST_WORDS else (lambda df: df)
    each = texts.select("key", "n", F.explode(tokens(F.col("text"))).alias("t")).select("key", "n", F.col("t.token").alias("word"), "t.negated")
    told = each.join(small(words), "word").withColumn("p", F.when(F.col("negated"), -F.col("score")).otherwise(F.col("score")))
    return told.groupBy("key", "n").agg(F.max(F.col("p") <= -FLOOR).alias("negative"), F.max(F.col("p") >= FLOOR).alias("positive")).where("negative or positive")


@dataclass(frozen=True)
class Frustration:
    """Before the model: any text that matches decides."""

    pattern: str
    score: int


@dataclass(frozen=True)
class PositiveClamp:
    """A score becomes another if any text is short and has no strong positive word."""

    score: int
    to: int
    max_words: int


@dataclass(frozen=True)
class MildIrritation:
    """A score becomes another if any text has the trigger, but neither what is hostile nor a strong negative word."""

    trigger: str
    hostile: str
    score: int
    to: int


@dataclass(frozen=True)
class Resume:
    """The score is set if any text is nothing but one of the phrases."""

    phrases: tuple[str, ...]
    to: int
    strip: str = ".!?,;:"


def scored(buckets: DataFrame, words: DataFrame, model: Column, stages: list) -> DataFrame:
    """key, short, raw, score of buckets (key, texts, and whatever the model reads).

    `short` is the first stage before the model that decides; the model, any column such as a call of a vectorised
    function, is asked only where none does (raw). Stages behind it follow in order, on decided scores too. Null texts
    are left out; a bucket without texts keeps its score.
    """
    before, behind = [s for s in stages if isinstance(s, Frustration)], [s for s in stages if not isinstance(s, Frustration)]
    texts = F.filter("texts", lambda t: t.isNotNull())
    matches = lambda pattern: F.exists(texts, lambda t: t.rlike(pattern))
    short = F.coalesce(F.lit(None).cast("int"), *[F.when(matches(s.pattern), s.score) for s in before])
    asked = buckets.withColumn("short", short)
    raw = asked.where("short is null").select("key", "texts", "short", model.cast("int").alias("raw"))
    whole = raw.unionByName(asked.where("short is not null").select("key", "texts", "short", F.lit(None).cast("int").alias("raw")))
    each = buckets.select("key", F.posexplode(texts).alias("n", "text"))
    strong = hits(each, words)
    told = each.join(strong, ["key", "n"], "left")
    count = F.size(F.filter(F.split("text", r"[\s\p{Z}\x85]+"), lambda w: w != ""))
    no = F.lit(False)

    def holds(s) -> Column:
        if isinstance(s, PositiveClamp):
            return (count <= s.max_words) & ~F.coalesce("positive", no)
        if isinstance(s, MildIrritation):
            return F.col("text").rlike(s.trigger) & ~(F.col("text").rlike(s.hostile) | F.coalesce("negative", no))
        return bare(F.col("text"), s.strip).isin(*s.phrases)

    if behind:
        any_ = told.groupBy("key").agg(*[F.max(holds(s)).alias(f"_s{k}") for k, s in enumerate(behind)])
        whole = whole.join(any_, "key", "left")
    def after(score: Column, s, met: Column) -> Column:
        return let(score, lambda now: F.when(met & (F.lit(True) if isinstance(s, Resume) else now == s.score), s.to).otherwise(now))

    score = F.coalesce("short", "raw")
    for k, s in enumerate(behind):
        score = after(score, s, F.coalesce(F.col(f"_s{k}"), no))
    return whole.select("key", "short", "raw", score.cast("int").alias("score"))
