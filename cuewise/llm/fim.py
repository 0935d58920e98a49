"""Fill-in-the-middle: texts cut at unit boundaries and put in prefix-suffix-middle or suffix-prefix-middle order.

Method: relational units.  The matches of the unit pattern are exploded with their
ordinals, a window sums unit lengths up to each, the cut requests of a document (two
ordinals, drawn from a hash of its id) meet the sums by ordinal, and a document's two
offsets are aggregated from what they met.  The text is then cut by substring.

Scale: all native.  Lengths travel apart from texts; a text moves once, to meet its two
offsets, and the offsets are the side that is built in memory.  Documents are named by 128 bits of
their id and text, so repeated rows, and rows without an id, are cut once each distinct text and
equal rows share the result.  A window spans one document's units, which one row held before.

Edge cases: a null text is empty, has no units and stays as it is (``plain``, null lengths); so
does a text that holds a sentinel; a null id is drawn for as the empty string; equal rows give equal rows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .staging import Staging

#: A line with its line feed, or the rest of the text.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
_KEY = ["name_1", "name_2"]


def drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The ``k``-th of a document's random numbers, 32 bits each."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def named(docs: DataFrame) -> DataFrame:
    """(name_1, name_2, doc_id, text): null texts empty, and 128 bits that name id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("name_1"), F.xxhash64(F.lit("fim"), "text", "doc_id").alias("name_2"), "doc_id", "text")


def offsets(rows: DataFrame, *, unit: str, seed: int) -> DataFrame:
    """(name_1, name_2, n, first, second): units of each named row and the characters before its two cuts."""
    lengths = rows.select(*_KEY, "doc_id", F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), F.length).alias("lengths"))
    held = Staging(rows.sparkSession, "fim").write(lengths.groupBy(*_KEY).agg(F.first("doc_id").alias("doc_id"), F.first("lengths").alias("lengths")), "lengths")

    units = held.select(*_KEY, F.posexplode("lengths").alias("at", "length"))
    so_far = F.sum("length").over(W.partitionBy(*_KEY).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    ends = units.select(*_KEY, (F.col("at") + 1).alias("ordinal"), so_far.alias("end"))

    asked = held.select(*_KEY, F.size("lengths").cast("long").alias("n"), "doc_id")
    draw = lambda k: drawn(F.col("doc_id"), seed, k) % (F.col("n") + 1)
    cuts = F.array(F.least(draw(0), draw(1)), F.greatest(draw(0), draw(1)))
    requests = asked.select(*_KEY, "n", F.posexplode(cuts).alias("which", "ordinal"))

    # A cut before the first unit meets none: nothing is before it.
    met = requests.join(ends, [*_KEY, "ordinal"], "left")
    before = lambda which: F.coalesce(F.max(F.when(F.col("which") == which, F.col("end"))), F.lit(0)).cast("int")
    return met.groupBy(*_KEY).agg(F.first("n").alias("n"), before(0).alias("first"), before(1).alias("second"))


def fill_in_middle(docs: DataFrame, *, unit: str = LINE, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``percent`` of all documents are rearranged, ``spm_percent`` of these in
    suffix-prefix-middle order.
    """
    rows = named(docs)
    places = offsets(rows, unit=unit, seed=seed)
    whole = rows.join(places.hint("shuffle_hash"), _KEY)
    plain = (F.col("text") == "") | F.col("text").rlike(_SENTINEL) | (drawn(F.col("doc_id"), seed, 2) % 100 >= percent)
    form = F.when(plain, "plain").when(drawn(F.col("doc_id"), seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    formed = whole.select("doc_id", "text", "n", "first", "second", form.alias("form"))
    prefix, suffix = F.substr("text", F.lit(1), F.col("first")), F.substr("text", F.col("second") + 1)
    middle = F.substr("text", F.col("first") + 1, F.col("second") - F.col("first"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return formed.select(
        "doc_id", "n", "form", F.when(cut, F.col("first").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("second") - F.col("first")).cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged, from its output and form alone; no sentinel can arise where two parts meet."""
    part = F.split(output, _SENTINEL, -1)
    at = lambda *ks: F.concat(*(F.get(part, F.lit(k)) for k in ks))
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)
