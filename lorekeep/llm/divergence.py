"""How the terms of each source of a language differ from its other sources and from the language as a whole.

Terms are counted by group within Arrow batches and the counts summed by a shuffle; all else is plain relational: groups
are crossed with their language's vocabulary so that terms they lack count 0, and the smoothed shares are joined with
each other on language and term, summed and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.store import discard, prepare, written
from lorekeep.llm.words import ALNUM, LOWER, Piece, pieces

#: A term is a run of ASCII letters and of characters beyond ASCII: of these bytes.
TERM = ALNUM.copy()
TERM[0x30:0x3A] = False
#: Bytes of text whose terms are counted at once. A longer text is counted part by part.
PART = 4 << 20
#: Up to so many (language, source) groups are broadcast, some megabytes; more are joined by shuffles.
BROADCAST_GROUPS = 50_000


def terms_of(piece: Piece) -> pa.DictionaryArray:
    """Every occurrence of a term in a piece, in order, with A-Z in lower case."""
    offsets = np.zeros(len(piece.row) + 1, np.int32)
    np.cumsum(piece.end - piece.start, out=offsets[1:])
    data = LOWER[piece.buf[TERM[piece.buf]]]
    return pa.Array.from_buffers(pa.string(), len(piece.row), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of parts of the table (lang, source, text); a term of a group may come several times."""
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        n_sources, held = len(sources.dictionary), []
        group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
        groups, group = np.unique(group, return_inverse=True)
        for piece in pieces(batch.column(2), TERM, PART):
            terms = terms_of(piece)
            names, code = terms.dictionary, terms.indices.to_numpy().astype(np.int64)
            if not piece.last or held:  # a part of one text, in which a term counts for one document
                held.append(pa.table({"term": names, "n": np.bincount(code, minlength=len(names))}))
                if not piece.last:
                    continue
                whole, held = pa.concat_tables(held).group_by("term").aggregate([("n", "sum")]), []
                names, n = whole["term"].combine_chunks(), whole["n_sum"].to_numpy()
                code, of, docs = np.arange(len(names)), np.full(len(names), group[piece.first]), np.ones(len(names), np.int64)
            else:
                occurrence = np.sort(code * piece.rows + piece.row)
                first = np.append(True, np.diff(occurrence) != 0)[: len(occurrence)]  # of its term in its document
                code, row = np.divmod(occurrence, piece.rows)
                found = np.sort((code * len(groups) + group[piece.first + row]) * 2 + first)
                key = found >> 1
                at = np.flatnonzero(np.append(True, np.diff(key) != 0)[: len(key)])
                n, docs = np.diff(np.append(at, len(key))), np.add.reduceat(found & 1, at) if len(at) else at
                code, of = np.divmod(key[at], len(groups))
            lang, source = np.divmod(groups[of], n_sources)
            rows = pa.record_batch([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), names.take(pa.array(code)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            for k in range(0, len(rows), 50_000):
                yield rows.slice(k, 50_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term, of every group; whole texts."""
    prepare(docs.sparkSession)
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = d.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share in parts of a thousand million: 1 + floor(10^9 (n + 5) / (total + 5 kept)), exact at any count."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 5).cast("decimal(20,0)")
    return (1 + F.call_function("div", top, (total + 5 * kept).cast("decimal(20,0)"))).cast("long")


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source).

    Part `pair`: how far each other source of the language is from the source, over all kept terms. Part `term`: the
    first `ranks` terms of which the source has a greater share than its language. A language keeps the terms of at
    least `least_docs` of its documents; without any, its pairs have the value 0. Null text, lang and source are
    empty, and an empty source is a group like any other; repeated rows count as often as they are there; ties are
    ranked by the item's bytes; an empty table gives no rows; other columns are not read. Counts beyond about 9 * 10^18
    are an error.
    """
    counts = written(term_counts(docs), "term-counts")
    groups = written(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")), "groups")
    small = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda x: x)
    vocabulary = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"), "vocabulary")
    totals = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = counts.join(vocabulary.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    sizes = groups.select("lang", "source").join(totals, "lang").join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sizes = written(sizes.select("lang", "source", "kept", "lang_total", F.coalesce("total", F.lit(0)).alias("total")), "group-sizes")
    # every group with every term that its language keeps
    dense = vocabulary.join(small(sizes), "lang").join(own, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    shares = written(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "shares")

    a, b = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("source", "p"), ("item", "q")))
    apart = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    both = apart.select("lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")).select("lang", "s.*", "value")
    bare = groups.join(totals, "lang", "left_anti")
    alike = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    terms = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    out = ranked(both.unionByName(alike), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= ranks))
    discard(counts)  # all that is left to compute reads the other tables
    return out


#: The same rows in DuckDB's SQL.
SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT lang, source, unnest(terms) AS term FROM d), w AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM d),
voc AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN voc USING (lang, term) GROUP BY ALL),
lc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL), lt AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM lc GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), gt AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
s AS (SELECT g.lang, g.source, lc.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(gt.total, 0) + 5 * lt.v) AS p, 1 + 1000000000::HUGEINT * (lc.n + 5) // (lt.total + 5 * lt.v) AS q
 FROM g JOIN lt ON lt.lang = g.lang JOIN lc ON lc.lang = g.lang LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = lc.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 50"""
