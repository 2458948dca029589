"""Personal data: four kinds found by pattern, and terms that give protected values away.

Everything here is DataFrame expressions. Patterns are matched with
``regexp_extract_all`` and placed with ``split``: the pieces between matches give
the positions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplewise.llm.common import materialise, small

#: The stated patterns, with possessive repeats and a start that skips what can't match, so that long runs cost linear time.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = (*PATTERNS, "term")
SPAN = "struct<s:int,e:int,t:string>"
#: Terms: words of any length, wherever in a text they stand.
TERM = r"[\p{L}\p{M}\p{N}]+"
#: Texts of different words in which a term must be seen with a value; bits that it must tell of it; how surely it
#: must give it away to be generalised, and to be removed.
SUPPORT, BITS, GENERALISE, REMOVE = 3, 3.0, 0.5, 0.9
#: Items that are summed up together, code points of a block that texts are cut from, lists that flagged terms are dealt to.
GROUP, BLOCK, SLOTS = 64, 1024, 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _sums(items: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running results of ``add`` over an array, each with its own item; arrays of the accumulator grow, so this is for few items."""

    def step(acc: Column, x: Column) -> Column:
        own = add(acc["at"], x)
        return F.struct(own.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(items, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def _plus(a: Column, x: Column) -> Column:
    return a + x


def _later(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def running(items: Column, add: Callable[[Column, Column], Column] = _plus, levels: int = 3) -> Column:
    """Running sums (or other associative results with the zero 0) of an array of integers, in time linear in its length.

    Groups of GROUP items are summed on their own, then their totals in the same
    way, and each group is raised by what comes before it.
    """
    if levels == 1:
        return _sums(items, F.lit(0), add)

    def within(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.element_at(g, -1))
        return _let(running(totals, add, levels - 1), lambda upto: F.flatten(F.transform(groups, lambda g, i: F.when(i == 0, g).otherwise(F.transform(g, lambda x: add(F.get(upto, i - 1), x))))))

    def cut(own: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(own) - 1) / GROUP).cast("int"))
        return _let(F.transform(starts, lambda g: _sums(F.slice(own, g * GROUP + 1, GROUP), F.lit(0), add)), within)

    return _let(items, lambda own: F.when(F.size(own) > GROUP, cut(own)).otherwise(_sums(own, F.lit(0), add)))


def _spans(text: Column, pattern: str) -> Column:
    """(s, e, t) of the matches, in code points, e exclusive; in time linear in the text."""
    none = F.array().cast(f"array<{SPAN}>")

    def place(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def replaced(text: Column, puts: Column) -> Column:
    """``text`` with spans replaced: ``puts`` are (s, e, r) in order of s; one that begins within others adds no r.

    What lies between spans is cut from blocks of BLOCK code points, so the time is
    linear in the text and in the number of spans.
    """

    def build(blocks: Column, spans: Column, reach: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            i, j = (a / BLOCK).cast("int"), (b / BLOCK).cast("int")
            first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
            whole = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            apart = F.concat(F.substr(first, a % BLOCK + 1, F.lit(BLOCK)), whole, F.substr(last, F.lit(1), b % BLOCK))
            return F.when(i == j, F.substr(first, a % BLOCK + 1, b - a)).otherwise(apart)

        def one(x: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            return F.when(x["s"] >= before, F.concat(between(before, x["s"]), x["r"])).otherwise("")

        tail = between(F.element_at(reach, -1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), tail)

    def bind(spans: Column) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        reach = running(F.transform(spans, lambda x: x["e"]), _later)
        return F.when(F.size(spans) > 0, _let(blocks, lambda own: _let(reach, lambda upto: build(own, spans, upto)))).otherwise(text)

    return _let(puts, bind)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _part_fits(p: Column) -> Column:
    number = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.when(F.length(number) <= 3, number.cast("int") <= 255).otherwise(F.lit(False))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


CHECKS = {
    "email": None,
    "ip": lambda x: F.forall(F.split(x["t"], r"\."), _part_fits),
    "card": lambda x: _luhn(_digits(x["t"])),
    "phone": lambda x: F.length(_digits(x["t"])).between(8, 15),
}


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the array of its spans that pass its check. ``text`` is not null."""
    out = {}
    for kind, (pattern, sign) in PATTERNS.items():
        spans = _spans(text, pattern)
        if CHECKS[kind]:
            spans = F.filter(spans, CHECKS[kind])
        if sign:
            spans = F.when(F.contains(text, F.lit(sign)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))
        out[kind] = spans
    return out


def _outside(text: Column, spans: Column) -> Column:
    """``text`` without ``spans``."""
    return replaced(text, F.transform(F.array_sort(spans), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(" \n ").alias("r"))))


def _hashed(kind: str):
    # a function of its own: transform() would take a second parameter for the index
    return lambda x: F.xxhash64(F.lit(kind), F.lower(x["t"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table: doc_id, uid, k (md5 of the text), the base spans of each kind, hashes of their different values
    (null without any), and the different words outside them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    found = rows.select("doc_id", "x", *[c.alias(k) for k, c in base_spans(F.col("x")).items()])
    kinds = {k: F.col(k) for k in PATTERNS}
    some = reduce(lambda a, b: a | b, [F.size(c) > 0 for c in kinds.values()])
    values = F.concat(*[F.transform(c, _hashed(k)) for k, c in kinds.items()])
    free = F.when(some, _outside(F.col("x"), F.concat(*kinds.values()))).otherwise(F.col("x"))
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(free, F.lit(TERM), F.lit(0))), F.lower))
    named = [F.monotonically_increasing_id().alias("uid"), F.md5(F.col("x").cast("binary")).alias("k")]
    return materialise(found.select("doc_id", *named, *kinds.values(), F.when(some, F.array_distinct(values)).alias("es"), terms.alias("terms")))


def _different(scanned: DataFrame) -> DataFrame:
    """One row of ``scanned`` for each different text."""
    again = small(materialise(scanned.groupBy("k").agg(F.min("uid").alias("first"), F.count("*").alias("n")).where("n > 1").select("k", "first")))
    copies = small(materialise(scanned.select("k", "uid").join(again, "k").where("uid != first").select("uid")))
    return scanned.join(copies, "uid", "left_anti")


def disclosing(scanned: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Terms that give a protected value away, (term, action), and where they are, (k, term); None if there are none.

    Counted over all different texts, value and term anywhere in them: a term tells
    log2(p(value | term) / p(value)) bits of a value, and gives it away with
    probability p(value | term). It must stand with the value in SUPPORT texts of
    different words, so that copies of one text prove nothing; tell BITS bits; and
    give it away with a probability of GENERALISE (the term is then replaced by its
    class) or REMOVE (it is removed).

    n_et, the texts that have both, is at most n_e, n_t and the texts with some
    value that have the term. Values and terms that can't pass by these bounds are
    left out before pairs are formed, and no others.
    """
    texts = _different(scanned)
    total = texts.count()
    rare = total / 2**BITS
    having = texts.where("es is not null")
    values = small(materialise(having.select(F.explode("es").alias("e")).groupBy("e").agg(F.count("*").alias("n_e")).where(F.col("n_e").between(SUPPORT, rare))))
    # texts of the same words have the same terms: one stands for all that share a value
    words = F.xxhash64(F.array_join(F.sort_array("terms"), " "))
    groups = having.select("k", words.alias("c"), F.explode("es").alias("e")).join(values, "e").groupBy("e", "n_e", "c").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    groups = materialise(groups.select("k", "e", "n_e", "n"))
    held = small(materialise(groups.groupBy("k").agg(F.max("n_e").alias("most"))))
    enough = (F.col("n_t") >= SUPPORT) & (F.col("n_t") <= rare) & (F.col("n_t") * GENERALISE <= F.col("n_v"))
    valued = F.col("es").isNotNull().cast("long")
    counted = texts.select(valued.alias("v"), F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"), F.sum("v").alias("n_v")).where(enough)
    terms = small(materialise(counted.select("term", "n_t")))
    seen = having.join(held, "k").select("k", "most", F.explode("terms").alias("term")).join(terms, "term").where(F.col("n_t") * GENERALISE <= F.col("most"))
    both = seen.join(small(groups), "k").where(F.col("n_t") * GENERALISE <= F.col("n_e"))
    pairs = both.groupBy("e", "n_e", "term", "n_t").agg(F.sum("n").alias("n_et"), F.count("*").alias("contexts")).where(F.col("contexts") >= SUPPORT)
    sure = F.col("n_et") / F.col("n_t")
    rated = pairs.select("term", sure.alias("sure"), F.log2(sure * F.lit(total) / F.col("n_e")).alias("bits"))
    worst = rated.where((F.col("bits") >= BITS) & (F.col("sure") >= GENERALISE)).groupBy("term").agg(F.max("sure").alias("sure"))
    flagged = materialise(worst.select("term", F.when(F.col("sure") >= REMOVE, "remove").otherwise("generalise").alias("action")))
    if not flagged.limit(1).count():
        return None
    return flagged, texts.select("k", F.explode("terms").alias("term"))


def _term_spans(text: Column, flags: Column) -> Column:
    """(s, e, t, action) of the words of ``text`` that are among ``flags`` (term, action).

    Flags are dealt to SLOTS lists by a hash, so that a word is compared with few of them.
    """
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")

    def match(words: Column, ends: Column, slots: Column) -> Column:
        def one(m: Column, e: Column) -> Column:
            own = F.lower(m)
            hit = F.get(F.filter(F.get(slots, slot(own)), lambda f: f["term"] == own), 0)
            return F.when(hit.isNotNull(), F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("t"), hit["action"].alias("action")))

        return F.filter(F.zip_with(words, ends, one), lambda x: x.isNotNull())

    def place(words: Column) -> Column:
        pieces = F.slice(F.split(text, TERM, -1), F.lit(1), F.size(words))
        ends = running(F.zip_with(pieces, words, lambda p, m: F.length(p) + F.length(m)))
        slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.filter(flags, lambda f: slot(f["term"]) == i))
        return _let(ends, lambda e: _let(slots, lambda own: match(words, e, own)))

    return _let(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), place)


def _placed(docs: DataFrame, found: tuple[DataFrame, DataFrame] | None, text: str) -> DataFrame | None:
    """(k, placed): the spans (s, e, t, action) of what is flagged in each text that has any; a written table.

    Words are placed within a row, in time linear in a text's words: no row is made for a word.
    """
    if found is None:
        return None
    flagged, hits = found
    own = hits.join(small(flagged), "term").groupBy("k").agg(F.collect_set(F.struct("term", "action")).alias("flags"))
    own = materialise(own)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("x")).withColumn("k", F.md5(F.col("x").cast("binary")))
    at = texts.join(small(own), "k").select("k", _term_spans(F.col("x"), F.col("flags")).alias("placed"))
    # copies of a text give the same spans
    return materialise(at.groupBy("k").agg(F.first("placed").alias("placed")))


def _free(spans: Column, taken: list[Column]) -> Column:
    """``spans`` outside those that are taken; none for null. Both are sorted together, and each is held against
    the furthest end before it and the nearest start after it."""
    kind = "array<struct<s:int,e:int,t:string,action:string>>"
    end = F.lit(2**31 - 1)

    def clear(marks: Column) -> Column:
        ends = running(F.transform(marks, lambda m: F.when(m["action"].isNull(), m["e"]).otherwise(0)), _later)
        starts = running(F.reverse(F.transform(marks, lambda m: F.when(m["action"].isNull(), end - m["s"]).otherwise(0))), _later)

        def one(e: Column, n: Column) -> Column:
            def fits(m: Column, i: Column) -> Column:
                return F.when(m["action"].isNotNull() & (F.get(e, i) <= m["s"]) & (end - F.get(n, i) >= m["e"]), m)

            return F.filter(F.transform(marks, fits), lambda m: m.isNotNull())

        return _let(ends, lambda e: _let(F.reverse(starts), lambda n: one(e, n)))

    base = F.transform(F.concat(*taken), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["t"].alias("t"), F.lit(None).cast("string").alias("action")))
    marks = F.array_sort(F.concat(base.cast(kind), spans.cast(kind)))
    return F.when(F.size(spans) > 0, _let(marks, clear)).otherwise(F.array().cast(kind))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, email, ip, card, phone, term for every row: arrays of (s, e, t) by start, code points, e exclusive.

    Base kinds are the leftmost non-overlapping matches of their patterns, those
    that fail their check dropped. ``term`` has the terms that ``disclosing()``
    flags, outside base spans. Null and empty texts have none; repeated rows
    repeat; an empty table gives none; other columns are not read.
    """
    scanned = scan(docs, id_col, text)
    placed = _placed(docs, disclosing(scanned), text)
    if placed is None:
        return scanned.select("doc_id", *PATTERNS, F.array().cast(f"array<{SPAN}>").alias("term"))
    terms = _free(F.col("placed"), [F.col(k) for k in PATTERNS])
    return scanned.join(small(placed), "k", "left").select("doc_id", *PATTERNS, F.transform(terms, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"))).alias("term"))


def digest(found: DataFrame) -> DataFrame:
    """The spans of find() as counts, a digest of the base kinds and one string of all."""
    base = F.concat(*[_named(F.col(k), k) for k in PATTERNS])
    every = F.concat(base, _named(F.col("term"), "term"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:-1], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), counts[-1])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced: base kinds by ``<EMAIL>`` and so on, terms by ``<TERM>`` or nothing.

    Of spans that overlap the first, by start and then by kind, is replaced
    together with what the others reach beyond it. Texts without spans, null ones
    too, stay as they are, and so do all other columns.
    """
    scanned = scan(docs, id_col, text)
    placed = _placed(docs, disclosing(scanned), text)
    cols = docs.columns
    # the row is kept as a struct, so that no column of it meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(text).alias("raw"), F.coalesce(F.col(text), F.lit("")).alias("x_"))
    if placed is None:
        rows = rows.withColumn("placed_", F.lit(None).cast("array<struct<s:int,e:int,t:string,action:string>>"))
    else:
        keyed = rows.withColumn("k_", F.md5(F.col("x_").cast("binary")))
        rows = keyed.join(small(placed.select(F.col("k").alias("k_"), F.col("placed").alias("placed_"))), "k_", "left")
    base = base_spans(F.col("x_"))
    rows = rows.select("row", "raw", "x_", "placed_", *[c.alias(f"{k}_") for k, c in base.items()])
    taken = [F.col(f"{k}_") for k in PATTERNS]
    terms = _free(F.col("placed_"), taken)

    def marked(i: int, k: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(f"<{k.upper()}>").alias("r"))

    put = [F.transform(F.col(f"{k}_"), marked(i, k)) for i, k in enumerate(PATTERNS)]
    put.append(F.transform(terms, lambda x: F.struct(x["s"].alias("s"), F.lit(len(PATTERNS)).alias("i"), x["e"].alias("e"), F.when(x["action"] == "remove", "").otherwise("<TERM>").alias("r"))))
    rows = rows.withColumn("spans_", F.array_sort(F.concat(*put)))
    rows = rows.withColumn("clean_", F.when(F.size("spans_") > 0, replaced(F.col("x_"), F.col("spans_"))).otherwise(F.col("raw")))
    return rows.select(*[F.col("clean_").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in cols])
