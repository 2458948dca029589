"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplewise.llm.common import materialise, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (1, 2, 3), 3
#: Classes into which the places of a source are split at once, and rows of a class that one task may sort; a larger
#: class is split again.
CLASSES, SORTED = 4096, 50_000
#: The least quality weight, so that every document can be taken.
LEAST = 0.01
#: Digits, each of CLASSES, by which rows are told apart: of the key, then of the hashes of equal keys, then of equal rows.
_KEY_DIGITS, _TIE_DIGITS, _NO_DIGITS = 4, 4, 5


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight in (0, 1] from two counts over the whole text: signs that prose seldom has, and different words.

    Half of it goes where signs are one in 20 characters, and it falls with the
    number of different words where that is below twice the root of all words.
    """
    signs = F.regexp_count(text, F.lit(r"[*&%$#|!<>{}^~]")) / F.greatest(F.length(text), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rich = F.size(F.array_distinct(found)) / (2 * F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")))
    return F.coalesce(F.greatest(F.least(rich, F.lit(1.0)) / (1 + 20 * signs), F.lit(LEAST)), F.lit(1.0))


def _mark(id_col: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def sizes(docs: DataFrame, id_col: str, text: str, source: str, weight: str | None = None, keep: tuple[Column, ...] = ()) -> DataFrame:
    """A written table: doc_id, source, size, key (the exponential key), tie (md5 of id and text), no (another for each row),
    place (digits of the row's place in its source) and ``keep``."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(LEAST)) if weight else quality(F.col(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), w.alias("w"), _mark(id_col, text).alias("tie"), *keep)
    # 12 hex digits give u in (0, 1) exactly; -ln(u) / w is an exponential variable of rate w
    u = (F.conv(F.substring("tie", 1, 12), 16, 10).cast("double") + 0.5) / 2**48
    keyed = rows.withColumn("key", -F.log(u) / F.col("w")).withColumn("no", F.monotonically_increasing_id())
    return materialise(keyed.withColumn("place", _digits()).drop("w"))


def _digits() -> Column:
    """A key's place as _KEY_DIGITS digits: key / (1 + key) rises with the key and spreads keys of any weight over (0, 1)."""
    part, out = F.col("key") / (1 + F.col("key")), []
    for _ in range(_KEY_DIGITS):
        part = part * CLASSES
        out.append(F.least(F.floor(part), F.lit(CLASSES - 1)).cast("int"))
        part = part - F.floor(part)
    return F.array(*out)


def _cumulated(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over all rows before in ``order``; a written table.

    Rows are dealt by ranges; each range is summed on its own and raised by the
    ranges before it, of which there are as many as partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    totals = dealt.groupBy("range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("range").alias("of"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_0") for k in sums])
    inner = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"{k}_1") for k, c in sums.items()])
    joined = own.join(F.broadcast(before), F.col("range") == F.col("of"))
    return materialise(joined.select(*df.columns, *[(F.col(f"{k}_0") + F.col(f"{k}_1")).alias(k) for k in sums]))


def targets(per_source: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): weights in the sources' code-point order, null last, shares of all words, capped.

    Resharing what capped sources leave until none is above ends at one level: the
    share of a unit of weight with which the uncapped take all that remains. Sources
    are capped in the order of cap * size / weight, as long as the level that the
    others then have is not below it. There may be any number of sources.
    """
    by_name = [F.col("source").asc_nulls_last()]
    named = _cumulated(per_source.select("source", "source_size"), by_name, {"n": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    weighted = named.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap).drop("n")
    by = [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    levels = _cumulated(weighted, by, {"limits": F.col("limit"), "weights": F.col("weight"), "place": F.lit(1)})
    whole = levels.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    levels = levels.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("all_size") - F.col("limits")) / (F.col("all_weight") - F.col("weights")))
    first = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    shared = levels.crossJoin(F.broadcast(levels.agg(F.min(first)["level"].alias("final"))))
    target = F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") > F.col("limit")), F.col("limit").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return shared.select("source", "source_size", target.cast("double").alias("target"))


def _digit(i: int, of: str = "") -> Column:
    """The i-th digit of a row; after those of the key come those of the tie and of a hash of the row's number."""
    if i < _KEY_DIGITS:
        return F.col(f"{of}place")[i]
    if i < _KEY_DIGITS + _TIE_DIGITS:
        return F.conv(F.substring(f"{of}tie", 3 * (i - _KEY_DIGITS) + 1, 3), 16, 10).cast("int")
    return F.pmod(F.shiftright(F.xxhash64(f"{of}no"), 12 * (i - _KEY_DIGITS - _TIE_DIGITS)), F.lit(CLASSES)).cast("int")


def _order() -> Column:
    """What rows of a source are ordered by: the key's place, the tie, and a hash of the row's number, in the order of their digits."""
    return F.struct("place", "tie", *[_digit(_KEY_DIGITS + _TIE_DIGITS + i).alias(f"d{i}") for i in range(_NO_DIGITS)], "no")


def plan(rows: DataFrame) -> DataFrame:
    """Per source, a written table: source, source_size, target, epochs, and ``cut``, the last place taken once more.

    Sizes are summed by source and class and prefix-summed over the classes of a
    source; the class in which the rest of the budget ends is split by the next
    digit as long as it has more than SORTED rows, and only then sorted. Rows that
    repeat id and text are told apart by their number, so that a budget may end
    among them. A document is taken if at most half of it lies beyond the budget.
    """
    per_source = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = targets(per_source)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(CAP))).otherwise(F.lit(0)).cast("long")
    aims = materialise(aims.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    # the class in which each budget ends: its digits so far, what lies before it, and its rows
    left, ends = rows, aims.select("source", "rest", F.lit(0).cast("long").alias("before"))
    for i in range(_KEY_DIGITS + _TIE_DIGITS + _NO_DIGITS):
        classes = materialise(left.groupBy("source", _digit(i).alias("class")).agg(F.sum("size").alias("size"), F.count("*").alias("n")))
        upto = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
        summed = classes.withColumn("earlier", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        at = summed.alias("a").join(small(ends.select("source", "before", "rest")).alias("b"), same).withColumn("start", F.col("earlier") + F.col("before")).where("start < rest")
        last = at.groupBy(F.col("a.source").alias("source")).agg(F.max_by(F.struct("class", "n", "start", "rest"), "class").alias("x"))
        ends = materialise(last.select("source", "x.class", "x.n", F.col("x.start").alias("before"), "x.rest"))
        left = left.alias("a").join(small(ends.select("source", "class")).alias("b"), same & (_digit(i, "a.") == F.col("b.class")), "left_semi").select("a.*")
        if (ends.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        left = materialise(left)
    run = Window.partitionBy("a.source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = left.withColumn("at", _order()).alias("a").join(small(ends).alias("b"), same).withColumn("upto", F.col("before") + F.sum("size").over(run))
    taken = last.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy(F.col("a.source").alias("source")).agg(F.max("at").alias("cut"))
    # where no row of the last class is taken, all before it are: the cut lies just before its first row
    first = left.withColumn("at", _order()).groupBy("source").agg(F.min("at").alias("begin"))
    cuts = first.alias("a").join(taken.alias("b"), same, "left").select("a.source", F.coalesce("b.cut", "a.begin").alias("cut"), F.col("b.cut").isNotNull().alias("with"))
    out = aims.alias("a").join(cuts.alias("b"), same, "left").select("a.source", "source_size", "target", "epochs", "cut", "with")
    return materialise(out)


def _times(rows: DataFrame) -> DataFrame:
    """``rows`` with their source's plan and ``times``: how often each is taken, the epochs and once more up to the cut."""
    planned = small(plan(rows))
    joined = rows.withColumn("at", _order()).alias("a").join(planned.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    more = F.col("cut").isNotNull() & ((F.col("at") < F.col("cut")) | (F.col("with") & (F.col("at") == F.col("cut"))))
    return joined.withColumn("times", F.col("epochs") + more.cast("long")).drop("at", "cut")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Size is the number of words of the whole text (null: 0). A source's target is
    its weighted share of all words, at most 3 times its own; it is met by whole
    epochs and then by documents in the order of exponential keys, scaled by
    their quality weights, up to the rest of the budget. ``weight`` names a column
    of weights, such as a classifier's scores (null or below LEAST: LEAST); without
    one quality() makes them from the text. Keys are made of id and text, so
    reruns agree; rows that repeat both may be cut among themselves, and any of
    them then stands for the others. A null source is a source of its own, the
    last; a null id is an id like any other. An empty table gives none; other
    columns are not read.
    """
    rows = _times(sizes(docs, id_col, text, source, weight))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows without words go."""
    # the row is kept as a struct, so that no column of it meets one of ours
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _times(sizes(docs, id_col, text, source, weight, (row,)))
    often = rows.withColumn("times", F.when(F.col("size") > 0, F.col("times")).otherwise(0).cast("int")).where("times > 0")
    return often.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, each source sorted as a whole."""
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(length(regexp_replace(text, '{WORD}', 'x', 'g')) - length(regexp_replace(text, '{WORD}', '', 'g')), 0) AS size,
        coalesce(greatest(least(len(list_distinct(regexp_extract_all(text, '{WORD}'))) / (2 * sqrt(greatest(len(regexp_extract_all(text, '{WORD}')), 1)::DOUBLE)), 1.0)
            / (1 + 20 * ((length(text) - length(regexp_replace(text, '[*&%$#|!<>{{}}^~]', '', 'g'))) / greatest(length(text), 1))), {LEAST}), 1.0) AS w,
        md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS tie FROM documents),
    k AS (SELECT *, -ln((('0x' || tie[1:12])::BIGINT + 0.5) / 281474976710656) / w AS key FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    g AS (SELECT source, source_size, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
    o AS (SELECT *, {CAP} * source_size AS lim, row_number() OVER (ORDER BY {CAP} * source_size / weight, source NULLS LAST) AS place FROM g),
    l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT)::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level FROM o),
    f AS (SELECT level AS final FROM l WHERE level * weight <= lim ORDER BY place LIMIT 1),
    a AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * weight > lim THEN lim::DOUBLE ELSE final * weight END AS target FROM l LEFT JOIN f ON true),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {CAP}) ELSE 0 END::BIGINT AS epochs FROM a),
    c AS (SELECT k.doc_id, k.size, k.key, k.tie, e.*, sum(size) OVER (PARTITION BY k.source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""
