"""Divergence between the sources of a language, audited on joint count histograms.

1. Words are counted by (lang, source, term); a language keeps the terms that enough of its documents hold. Of a term's
   counts in the sources of its language, the list is its pattern; terms with one pattern count as one row with a number.
2. For each two sources of a language, the patterns give a histogram of (count, count) combinations with a number of
   terms. Only terms that both have are emitted; the cells with a zero on one side or on both follow from the histogram
   of each source alone, as what its row or column lacks. So rare terms cost one cell, however many they are.
3. The divergence f is evaluated once for each combination and multiplied by the number of terms; sums are decimals.

Mappers count words in bounded tables; all the rest is DataFrame functions. What a task holds of a term is bounded by the number of sources in its language, whose pairs
the result lists anyway.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, released, small_batches, stored

#: Runs of ASCII letters and of all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, SMOOTHING, SCALE, MOST_TERMS = 3, 1, 1_000_000_000, 200
MOST_BROADCAST_GROUPS = 100_000
MOST_HELD = 500_000
_DIGITS = "decimal(20,0)"
#: TERM on UTF-8 bytes: A-Z lower-cased, and a blank for each byte that is in no term.
_BYTES = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a partition's documents, given out whenever MOST_HELD of them are held."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in found.items():
            if n:
                of_all = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*of_all, terms, pa.array(n.values(), pa.int64()), pa.array(map(d.__getitem__, n), pa.int64())], names=["lang", "source", "term", "n", "d"])
        found.clear()

    for batch in it:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            words = text.translate(_BYTES).split()
            n, d = found[lang, source]
            n.update(words)
            d.update(set(words))
        if sum(len(n) for n, _ in found.values()) > MOST_HELD:
            yield from rows()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term; null lang, source and text are empty."""
    empty = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*empty, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(released(_counted), "lang string, source string, term string, n long, d long")
    # dealt by what all later steps share: a term's rows, a few from each mapper, are shuffled once
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kept: Column, smoothing: int, scale: int) -> Column:
    """The smoothed share of a term in parts of ``scale``, rounded down, and 1."""
    above = F.lit(scale).cast(_DIGITS) * (count + F.lit(smoothing)).cast(_DIGITS)
    return 1 + F.call_function("div", above, (total + smoothing * kept).cast(_DIGITS))


def term_value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_cells(kept: DataFrame, pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, terms): for each two sources a < b, how many kept terms have each combination of counts.

    kept (lang, source, term, n), pairs (lang, a, b), vocabulary (lang, v).
    """
    entry = F.struct("source", "n")
    patterns = kept.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("cells")).groupBy("lang", "cells").agg(F.count("*").alias("terms"))
    two = patterns.filter(F.size("cells") > 1).select("lang", "cells", "terms", F.posexplode("cells").alias("at", "x"))
    two = two.select("lang", "terms", "x", F.explode(F.slice("cells", F.col("at") + 2, F.size("cells"))).alias("y"))
    joint = two.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.sum("terms").alias("terms"))
    none = F.lit(0).cast("long")
    cell = lambda ca, cb, n: F.struct(ca.alias("ca"), cb.alias("cb"), n.alias("terms"))
    ca, cb, n = F.col("ca"), F.col("cb"), F.col("terms")
    # what both have isn't among the zeros of either; it was taken off the cell (0, 0) twice, by each one's terms
    met = joint.select("lang", "a", "b", F.inline(F.array(cell(ca, cb, n), cell(ca, none, -n), cell(none, cb, -n), cell(none, none, n))))
    alone = stored(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    left = alone.withColumnsRenamed({"source": "a", "n": "ca"}).join(pairs, ["lang", "a"]).select("lang", "a", "b", F.inline(F.array(cell(ca, none, n), cell(none, none, -n))))
    right = alone.withColumnsRenamed({"source": "b", "n": "cb"}).join(pairs, ["lang", "b"]).select("lang", "a", "b", F.inline(F.array(cell(none, cb, n), cell(none, none, -n))))
    base = pairs.join(vocabulary, "lang").select("lang", "a", "b", none.alias("ca"), none.alias("cb"), F.col("v").alias("terms"))
    tally = met.unionByName(left).unionByName(right).unionByName(base)
    return tally.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("terms").alias("terms")).filter("terms != 0")


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the words of each source lie from others of its language.

    Part ``pair``: one row for each other source of the language, value the divergence over all kept terms. Part
    ``term``: the ``most_terms`` terms by which a source lies most above its language. Null lang, source and text count as
    empty; every row is a document, repeated ones and those without a term too. A source whose language keeps no term
    has the value 0 to each other; a language with one source has no pairs. An empty table gives an empty result. Texts
    are read whole; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    groups = stored(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    of_term = Window.partitionBy("lang", "term")  # as many rows as its language has sources
    whole = term_counts(docs).withColumns({"all": F.sum("n").over(of_term), "docs": F.sum("d").over(of_term)})
    kept = stored(whole.filter(F.col("docs") >= least_docs).drop("d", "docs"))
    by_lang = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_n"))
    by_lang = groups.select("lang").distinct().join(by_lang, "lang", "left").fillna(0, ["v", "lang_n"])
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    stats = stored(groups.join(by_group, ["lang", "source"], "left").fillna(0, ["group_n"]).join(by_lang, "lang"))

    small = lambda df: broadcast_if_small(df, MOST_BROADCAST_GROUPS)
    p = share(F.col("n"), F.col("group_n"), F.col("v"), smoothing, scale)
    q = share(F.col("all"), F.col("lang_n"), F.col("v"), smoothing, scale)
    terms = kept.join(small(stats), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", term_value(F.col("p"), F.col("q")).alias("value"))

    a = stats.select("lang", F.col("source").alias("a"), F.col("group_n").alias("an"), "v")
    b = stats.select("lang", F.col("source").alias("b"), F.col("group_n").alias("bn"))
    pairs = stored(a.join(small(b), "lang").filter("a < b"))
    cells = pair_cells(kept.drop("all"), small(pairs.select("lang", "a", "b")), small(stats.select("lang", "v").distinct()))
    cells = cells.join(small(pairs), ["lang", "a", "b"])
    pa, pb = (share(F.col(c), F.col(n), F.col("v"), smoothing, scale) for c, n in (("ca", "an"), ("cb", "bn")))
    cells = cells.select("lang", "a", "b", "terms", pa.alias("pa"), pb.alias("pb"))
    times = lambda f: F.sum(f.cast(_DIGITS) * F.col("terms").cast(_DIGITS)).cast("long")
    sums = cells.groupBy("lang", "a", "b").agg(times(term_value(F.col("pa"), F.col("pb"))).alias("ab"), times(term_value(F.col("pb"), F.col("pa"))).alias("ba"))
    sums = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").fillna(0, ["ab", "ba"])
    ways = F.array(*(F.struct(F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), F.col(v).alias("value")) for x, y, v in (("a", "b", "ab"), ("b", "a", "ba"))))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(sums.select("lang", F.inline(ways))).unionByName(ranked(terms).filter(F.col("rank") <= most_terms))
