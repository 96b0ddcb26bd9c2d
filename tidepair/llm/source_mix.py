"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; cumulative sums over the buckets give each source
the bucket in which its budget ends; only that bucket is split again. After a few levels a
source has a threshold, and the mix is a filter: nothing is sorted or collected. What the document
at the threshold left open is filled from those behind it that still fit, by a few more
thresholds of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepair.llm import text as tx
from tidepair.session import stage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Hash bits, and bits split at each level: at most 2**STEP rows a source in a histogram.
BITS, STEP = 60, 10
#: Thresholds of a source: behind each one goes on with the documents that fit into the rest.
PASSES = 3


def rank_hash(doc_id: str = "doc_id") -> Column:
    """The first 60 bits of the MD5 of the id: an order that reruns and other engines repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): budgets by weight, none above ``most`` times its source.

    What a capped source can't take is shared among the others by weight, again and again
    until none is above. A source's target is so the lesser of its cap and level * weight; the
    level rises from round to round, and two sums a round come to the driver. The table has
    one row a source; sources are numbered in code point order with null last.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    table = stage(by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place)), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") >= most * F.col("source_size")
        row = table.agg(
            F.sum(F.when(above, most * F.col("source_size")).otherwise(0)).alias("capped"),
            F.sum(F.when(~above, F.col("weight")).otherwise(0)).alias("free"),
        ).first()
        if not row.free or row.free == free:
            break
        free = row.free
        level = (total - row.capped) / row.free
    cap = (most * F.col("source_size")).cast("double")
    return table.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), cap).alias("target"))


def _threshold(sizes: DataFrame, rests: DataFrame, bits: int, step: int) -> DataFrame:
    """(source, below, left): rows with hash < below fill up to ``rest`` (source, rest); ``left`` of it stays open.

    The rest ends inside one bucket of the source's histogram; only rows of that bucket pass to
    the next level, ever fewer of them.
    """
    open_ = rests.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(step, bits + 1, step):
        shift = bits - level
        within = sizes.join(open_, sizes["source"].eqNullSafe(open_["source"]) & (F.shiftright(sizes["hash"], shift + step) == open_["prefix"]))
        cells = within.groupBy(sizes["source"], F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("held"))
        run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("filled", F.sum("held").over(run)).select(F.col("source").alias("s"), "cell", "held", "filled")
        # The last bucket that fits whole says how much is left; the next one is where it ends.
        at = open_.join(cells, open_["source"].eqNullSafe(cells["s"]), "left").groupBy("source", "rest", "prefix").agg(
            F.max(F.when(F.col("filled") <= F.col("rest"), F.col("filled"))).alias("used"),
            F.min(F.when(F.col("filled") > F.col("rest"), F.col("cell"))).alias("end"),
        )
        # If all fits, the threshold is the end of the range: the prefix after it.
        end = F.coalesce("end", F.shiftleft(F.col("prefix") + 1, step))
        open_ = stage(at.select("source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), end.alias("prefix")), "cells")
    return open_.select("source", F.col("prefix").alias("below"), F.col("rest").alias("left"))


def thresholds(sizes: DataFrame, goals: DataFrame, bits: int = BITS, step: int = STEP, passes: int = PASSES) -> DataFrame:
    """(source, copies, cuts): take ``copies`` of every row and one more where a cut has it.

    ``cuts`` lists (start, below, most): rows with start <= hash < below and a size of at most
    ``most``. The first cut takes rows up to the one that no longer fits; each further one goes on
    behind it with those that fit into what is left. So a source ends short of its target by less than the
    smallest of the rows that the last cut stopped at.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = (F.floor(F.col("target")).cast("long") - whole * F.col("source_size")).alias("most")
    state = goals.select("source", whole.alias("copies"), F.lit(0).cast("long").alias("start"), rest)
    state = state.withColumn("cuts", F.array().cast("array<struct<start: long, below: long, most: long>>"))
    for _ in range(passes):
        bounds = state.select(F.col("source").alias("s"), "start", "most")
        fits = sizes.join(bounds, sizes["source"].eqNullSafe(F.col("s")) & (F.col("hash") >= F.col("start")) & (F.col("size") <= F.col("most")) & (F.col("size") > 0))
        found = _threshold(fits.select("source", "size", "hash"), state.select("source", F.col("most").alias("rest")), bits, step)
        found = found.select(F.col("source").alias("s"), "below", "left")
        cut = F.struct(F.col("start"), F.col("below"), F.col("most"))
        state = state.join(found, state["source"].eqNullSafe(F.col("s"))).select(
            "source", "copies", F.col("below").alias("start"), F.col("left").alias("most"), F.array_append("cuts", cut).alias("cuts")
        )
        state = stage(state, "cuts")
    return state.select("source", "copies", "cuts")


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of the documents, the sources' targets and their thresholds."""
    sizes = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), tx.n_words("text").alias("size"), rank_hash().alias("hash"))
    sizes = stage(sizes, "sizes")
    goals = stage(targets(sizes, weights, most), "targets")
    return sizes, goals, thresholds(sizes.select("source", "size", "hash"), goals)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Size is the number of words (a null text has none). ``taken`` counts the words that the mix
    takes, copies included: whole copies of all the source's documents, and one more of those
    that the source's cuts have. A null source is a source of its own, last in
    order. Rows that repeat a doc_id share its hash and are taken together; so are rows without
    an id. An empty table gives an empty result; sources without words take nothing.
    """
    sizes, goals, cuts = plan_mix(docs, weights, most)
    known = goals.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    rows = sizes.join(known, sizes["source"].eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def copies() -> Column:
    """How often a row is taken; needs its ``hash``, its ``size`` and its source's ``copies`` and ``cuts``."""
    fits = lambda c: (F.col("hash") >= c["start"]) & (F.col("hash") < c["below"]) & (F.col("size") <= c["most"])
    return F.col("copies") + F.exists("cuts", fits).cast("long")


def draw(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; columns stay as they are."""
    _, _, cuts = plan_mix(docs, weights, most)
    cuts = cuts.select(F.col("source").alias("s"), "copies", "cuts")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), tx.n_words("text").alias("size"), rank_hash().alias("hash"))
    row = row.join(cuts, row["source"].eqNullSafe(F.col("s"))).withColumn("n", copies().cast("int"))
    return row.where("n > 0").select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*")


# A pass: rows from ``start`` on that fit are taken in the order of their hashes while they stay within ``most``.
_PASSES_SQL = ",\n".join(
    f"""run{k} AS (
    SELECT *, sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM (SELECT *, hash >= start AND size <= most AND size > 0 AS fits FROM pass{k})
),
pass{k + 1} AS (
    SELECT r, doc_id, source, size, hash, source_size, target, copies, had OR (fits AND upto <= most) AS had,
        coalesce(min(CASE WHEN fits AND upto > most THEN hash END) OVER w, 1::BIGINT << {BITS}) AS start,
        most - coalesce(max(CASE WHEN fits AND upto <= most THEN upto END) OVER w, 0) AS most
    FROM run{k} WINDOW w AS (PARTITION BY source)
)"""
    for k in range(PASSES)
)

SQL = f"""
WITH sizes AS (
    SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{tx.WORD}')) AS size,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1 AS weight
    FROM sizes GROUP BY source
),
steps AS (
    SELECT *, sum(3 * source_size) OVER w AS capped, (SELECT sum(weight) FROM sources) - sum(weight) OVER w AS free,
        (SELECT sum(source_size) FROM sources) AS total
    FROM sources WINDOW w AS (ORDER BY 3.0 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (
    SELECT *, (total - coalesce(capped, 0))::DOUBLE / coalesce(free, (SELECT sum(weight) FROM sources)) AS level
    FROM steps
),
chosen AS (SELECT max(level) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (
    SELECT source, source_size, least((SELECT level FROM chosen) * weight, 3.0 * source_size::DOUBLE) AS target FROM sources
),
goals AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM targets
),
pass0 AS (
    SELECT s.*, source_size, target, copies, 0::BIGINT AS start, floor(target)::BIGINT - copies * source_size AS most, false AS had
    FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
),
{_PASSES_SQL}
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (copies + had::INT))::BIGINT AS taken FROM pass{PASSES}"""
