"""Mix sources to target weights by weighted fair queueing.

Each source is a queue of its documents, shuffled, gone through once or more. A
document's virtual finish time is the source's cumulative tokens up to its end,
divided by the source's target; all sources reach time 1 as their targets are
spent. Sorting all documents by finish time and stopping at the total budget is
the mix: what has finished is taken whole, and the document that a source is
serving when the budget ends is cut there.

Everything is DataFrame operations. A source may hold most of all rows, so no
window runs over a source: documents fall into cells by the first bits of their
shuffle key, cells are summed, and a document's place is the sum of the cells
before it and of the rows before it in its cell.

Sizes are words; a null text has size 0. Null is a source of its own and the last.
Documents with equal shuffle key and size are interchangeable; repeated rows stay
rows. An empty table gives an empty mix. A source without words has target 0.
Extra columns are kept by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .text import WORD, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
#: Rows that a cell holds on average, at most.
CELL_ROWS = 20_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all sizes by weight, at most ``epochs`` times the source's size.

    Sources by code point, null last, take the weights in turn. What a source can't
    use is shared again among the others: with the sources sorted by size/weight,
    those before some place are full and the others get one level times their
    weight. That place is the first whose level is within its own size/weight, and
    the levels fall from there on. The table has a row for each source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    most = epochs * F.col("source_size").cast("double")
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        sizes.select("source", "source_size", weight.alias("weight"), most.alias("most"), (F.sum("source_size").over(everything.orderBy(F.lit(0))) * share).alias("budget"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything.orderBy(F.lit(0))))
        .select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))
    )


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """A fixed random order of documents: equal on every run, and the same in other engines.

    It takes in the text, so that the rows of one id, or of none, are spread as well.
    """
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken, finish) for each row of docs, sorted by finish.

    taken: words that the mix takes of the document, repeats counted. finish: its
    virtual finish time in the first round; null where its source has no target. The
    budget is the sum of the targets, so in the global order of finish times it ends
    at virtual time 1: what is served after that is not taken. ``taken`` states this
    cut in closed form for each row, so no running sum over the sorted mix is needed.
    """
    key = shuffle_key(F.col("doc_id"), F.col("text")).alias("key")
    sized = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key), "sizes")
    rows, digits = sized.count(), 1
    while 16**digits * cell_rows < rows and digits < 8:
        digits += 1
    cell = F.substring("key", 1, digits)
    cells = sized.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("cell_size"))
    by_source = Window.partitionBy("source")
    cells = cells.select("source", "cell", (F.sum("cell_size").over(by_source.orderBy("cell")) - F.col("cell_size")).alias("before_cell"))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    start = F.coalesce(F.sum("size").over(Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a, c, g = sized.withColumn("cell", cell).withColumn("own", start).alias("a"), cells.alias("c"), goal.alias("g")
    placed = (
        a.join(c, F.col("a.source").eqNullSafe(F.col("c.source")) & (F.col("a.cell") == F.col("c.cell")))
        .join(g, F.col("a.source").eqNullSafe(F.col("g.source")))
        .select("a.doc_id", "a.source", "a.key", "a.size", "g.source_size", "g.target", (F.col("c.before_cell") + F.col("a.own")).alias("start"))
    )
    # round r serves the document over the source's tokens r * source_size + [start, start + size)
    served = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("long") - F.col("start") - r * F.col("source_size"))) for r in range(epochs)]
    taken = sum(served[1:], served[0])
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target"))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("finish")).repartitionByRange("finish", "key").sortWithinPartitions("finish", "key")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: a row of docs each time that it is taken, in order of virtual finish time.

    The document that ends a source's share is cut after its last word that is
    taken (its white space becomes single spaces); n_chars follows where docs has it.
    """
    names = docs.columns
    chosen = plan(docs, weights, share, epochs).where("taken > 0").groupBy("key", "source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.min("finish").alias("finish"))
    d = docs.withColumns({"_size": word_count(F.col("text")), "_key": shuffle_key(F.col("doc_id"), F.col("text"))}).alias("d")
    w = Window.partitionBy("_key", "d.source").orderBy("_size")
    left = d.join(chosen.alias("c"), (F.col("_key") == F.col("c.key")) & F.col("d.source").eqNullSafe(F.col("c.source"))).withColumn("_n", F.row_number().over(w) - 1)
    # rows that repeat an id, source and text share what is taken of them, in turn
    own = F.greatest(F.lit(0), F.least(F.col("_size") * epochs, F.col("c.taken") - F.col("_n") * F.col("_size") * epochs))
    times = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda r: F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_own") - r * F.col("_size"))))
    each = left.withColumn("_own", own).select("d.*", F.col("c.finish").alias("_finish"), F.col("c.source_size").alias("_source_size"), F.col("c.target").alias("_target"), F.posexplode(times).alias("_round", "_words")).where("_words > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.when(F.col("_words") < F.col("_size"), F.char_length(cut).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in names else {})
    finish = F.col("_finish") + F.col("_round") * F.col("_source_size") / F.col("_target")
    return each.withColumn("_finish", finish).repartitionByRange("_finish", "_key").sortWithinPartitions("_finish", "_key").select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in names))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0 * source_size AS most,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
  FROM totals),
levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size, least(most, coalesce((SELECT max(level) FROM levels WHERE level <= most / weight) * weight, most)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN CAST(start + size AS DOUBLE) / CAST(target AS DOUBLE) END AS finish
FROM placed
"""
