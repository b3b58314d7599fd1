"""Line-level dedup by winnowing, in DataFrame functions only.

Text is read in units: lines, cut further after a mark of punctuation and, where a unit of more than ``LONG``
bytes has none, after words picked by their hash. All these cuts depend on the neighbouring characters alone, so a
passage has the same units wherever it stands, also in the middle of a line. A gram is ``GRAM`` units; of every
``WINDOW`` neighbouring grams the one with the least hash is a fingerprint. So any run of ``GRAM + WINDOW - 1``
whole units that two places share holds a shared fingerprint, which is some 30 words of ordinary prose.

Fingerprints are joined on position by aggregation: keys that occur once go after a count with a map-side
combine, the first place in document order is found for the others, and every later place is joined to it. So a
line that a third of all documents hold makes a row per place, never pairs, and is joined by broadcast. A place
carries the hashes of the ``WINDOW - 1`` units on either side, as far as the next fingerprint can be, and matches
are extended both ways by those that agree. Runs that meet are one; those of ``LEAST`` words or more are deleted
from the later place, those of the first stay. Units count as equal if two hashes of 64 and 32 bits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, let, materialise, small

GRAM = 3
WINDOW = 4
LONG = 120
LEAST = 25
#: The low bits that number a gram; more than a text has.
PLACE = (1 << 27) - 1
#: Longer than any array, and no overflow when a start is added.
ENDLESS = 2**30
#: Documents with runs that are joined by broadcast; a document has some tens of runs.
RUNS = 500_000
SPACE = " \t\r\n\x0b\x0c"
#: A unit ends with a line feed or with a mark and the space after it.
_END = r"(?<=\n)|(?<=[.,!?] )"
_CUT = "\x1e"
_SIDES = [*range(-(WINDOW - 1), 0), *range(GRAM, GRAM + WINDOW - 1)]


def _words(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.translate(c, "\t\r\n", "   "), " "), ""))


def units(text: Column) -> Column:
    """The text in units; one after another they are the text."""

    def cut(unit: Column) -> Column:
        marked = F.transform(F.split(unit, " "), lambda w: F.when(F.pmod(F.hash(w), F.lit(4)) == 0, F.concat(w, F.lit(_CUT))).otherwise(w))
        return F.split(F.array_join(marked, " "), _CUT)

    whole = F.coalesce(text, F.lit(""))
    marked = F.replace(whole, F.lit("\n"), F.lit("\n" + _CUT))
    for mark in ".,!?":
        marked = F.replace(marked, F.lit(mark + " "), F.lit(f"{mark} {_CUT}"))
    # Both ways cut at the same places; the pattern is for the rare text that has the separator itself.
    found = F.when(F.contains(whole, F.lit(_CUT)), F.split(whole, _END, -1)).otherwise(F.split(marked, _CUT))
    long = lambda u: (F.octet_length(u) > LONG) & ~F.contains(u, F.lit(_CUT))
    return F.flatten(F.transform(found, lambda u: F.when(long(u), cut(u)).otherwise(F.array(u))))


def _numbered(found: Column) -> Column:
    """(at, unit) of the units that aren't blank, without the space around them."""
    trimmed = F.transform(found, lambda u, i: F.struct(i.alias("at"), F.btrim(u, F.lit(SPACE)).alias("unit")))
    return F.filter(trimmed, lambda u: u["unit"] != "")


def _places(text: Column) -> Column:
    """(h, m, at, near) of every fingerprint: its two hashes, the number of its first unit, the hashes of those around it."""
    trimmed = F.filter(F.transform(units(text), lambda u: F.btrim(u, F.lit(SPACE))), lambda u: u != "")

    def of(us: Column) -> Column:
        return let(F.transform(us, lambda u: F.xxhash64(u)), lambda hs: let(F.transform(us, lambda u: F.hash(u)), lambda ms: fingerprints(hs, ms)))

    def gram(hs: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(hs, i + k) for k in range(GRAM)])

    def ahead_by(step: int):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, ENDLESS), lambda x, y: F.least(x, y))

    def fingerprints(hs: Column, ms: Column) -> Column:
        last = F.size(hs) - GRAM
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        # A gram's hash in the high bits and its number in the low ones: the least of a window tells which gram it is.
        low, reach = F.transform(starts, lambda i: gram(hs, i).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))), 1
        while reach < WINDOW:  # by doubling; beyond the end none counts
            step = min(reach, WINDOW - reach)
            low = let(low, ahead_by(step))
            reach += step
        chosen = F.array_distinct(F.transform(low, lambda v: v.bitwiseAND(F.lit(PLACE)).cast("int")))
        return F.transform(
            chosen,
            lambda i: F.struct(
                gram(hs, i).alias("h"), F.hash(*[F.get(ms, i + k) for k in range(GRAM)]).alias("m"), i.alias("at"), *[F.get(ms, i + k).alias(f"u{n}") for n, k in enumerate(_SIDES)]
            ),
        )

    return let(trimmed, of)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, runs): the ranges (a, b) of units not blank that an earlier place has, for each document with any."""
    sides = [f"u{n}" for n in range(len(_SIDES))]
    # Hashed in a select below, as beside the explode the text would be hashed again for each of its places. The places
    # aren't a column there: explode would be given a filter on their number, which finds them a second time.
    found = docs.select("doc_id", "text", _text_hash().alias("text_hash"))
    places = found.select("doc_id", "text_hash", F.explode(_places(F.col("text"))).alias("p"))
    places = materialise(places.select("doc_id", "text_hash", F.struct("p.h", "p.m").alias("key"), "p.at", *[f"p.{c}" for c in sides]), "places", hashes=True)
    several = materialise(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    met = materialise(join_counted(places, several, "key", places.count()), "met", hashes=True)
    first = materialise(met.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "at", *sides)).alias("first")), "firsts", hashes=True)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = join_counted(met, first, "key", met.count()).where(~same | (F.col("at") >= F.col("first.at") + GRAM))

    def reach(order: list[int]) -> Column:
        out = F.lit(0)
        for n in reversed(order):
            out = F.when(F.col(f"u{n}") == F.col(f"first.u{n}"), out + 1).otherwise(0)
        return out

    back, ahead = reach(list(range(WINDOW - 1))[::-1]), reach(list(range(WINDOW - 1, len(_SIDES))))
    back = F.when(same, F.least(back, F.col("at") - F.col("first.at") - GRAM)).otherwise(back)
    ranges = later.select("doc_id", "text_hash", (F.col("at") - back).alias("a"), (F.col("at") + GRAM - 1 + ahead).alias("b")).distinct()
    order = Window.partitionBy("doc_id", "text_hash").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("new", F.coalesce((F.col("a") > before + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "text_hash", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def _text_hash() -> Column:
    return F.xxhash64(F.col("text"), F.octet_length("text"))


def _without(text: Column, runs: Column) -> Column:
    """(text, runs, words) after ``runs`` have gone: what is left, how many runs that was, and their words."""

    def of(found: Column) -> Column:
        return let(F.transform(_numbered(found), lambda u: u["at"]), lambda at: cut(found, at))

    def cut(found: Column, at: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(found, a + 1, F.greatest(b - a, F.lit(0))), "")  # noqa: E731  units a to b - 1
        sized = F.transform(runs, lambda r: F.struct(F.get(at, r["a"]).alias("a"), (F.get(at, r["b"]) + 1).alias("b")))
        sized = F.transform(sized, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), _words(part(r["a"], r["b"])).alias("words")))
        return let(F.filter(sized, lambda r: r["words"] >= LEAST), lambda gone: rest(found, part, gone))

    def rest(found: Column, part, gone: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1)["b"])
        kept = F.transform(gone, lambda r, i: let(part(begin(i), r["a"]), lambda left: closed(left, found, r)))
        end = part(F.when(F.size(gone) == 0, F.lit(0)).otherwise(F.element_at(gone, -1)["b"]), F.size(found))
        whole = F.array_join(F.concat(kept, F.array(end)), "")
        # A text that didn't end with a line feed or space doesn't get one.
        plain = F.rtrim(whole, F.lit(SPACE))
        whole = F.when(F.rtrim(text, F.lit(SPACE)) == text, plain).otherwise(whole)
        words = F.aggregate(gone, F.lit(0), lambda s, r: s + r["words"])
        return F.when(F.size(gone) > 0, F.struct(whole.alias("text"), F.size(gone).alias("runs"), words.alias("words")))

    def closed(left: Column, found: Column, r: Column) -> Column:
        """``left`` ends as the run after it does, where that began within a line or right after a word."""
        last = F.get(found, r["b"] - 1)
        line = F.endswith(last, F.lit("\n")) & (left != "") & ~F.endswith(left, F.lit("\n"))
        word = F.endswith(last, F.lit(" ")) & (F.rtrim(left, F.lit(SPACE)) == left) & (left != "")
        return F.when(line, F.concat(F.rtrim(left, F.lit(" ")), F.lit("\n"))).when(word, F.concat(left, F.lit(" "))).otherwise(left)

    return let(units(text), of)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns and rows of ``docs`` in struct ``doc``, with ``text``, ``runs_removed`` and ``words_removed``.

    ``text`` lacks every run of at least ``LEAST`` words that an earlier place has: documents come in the order of
    doc_id (null first), then of their text's hash. Units are compared without the space around them; blank ones are
    never matched and stay unless they lie within a run. What of a repeated passage falls short of a whole unit at its two ends
    stays. A null text stays null. Rows equal in doc_id and text count as one place: none of them is later than
    another. Columns whose names clash can't meet, as the input row stays a struct. An empty table gives no rows.
    """
    runs = materialise(repeated_runs(docs).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "runs"), "runs")
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("__id"),
        _text_hash().alias("__t"),
    )
    both = base.join(small(runs, RUNS), F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")), "left")
    changed = F.when(F.col("runs").isNotNull(), _without(F.col("doc.text"), F.col("runs")))
    out = both.select("doc", changed.alias("c"))
    return out.select(
        "doc",
        F.when(F.col("c").isNotNull(), F.col("c.text")).otherwise(F.col("doc.text")).alias("text"),
        F.coalesce("c.runs", F.lit(0)).cast("long").alias("runs_removed"),
        F.coalesce("c.words", F.lit(0)).cast("long").alias("words_removed"),
    )
