"""Line dedup: lines equal to an earlier line, or one character apart from it, go.

Lines are compared in lower case with one space between words, and the bound is one edit: a unit put in, taken out or
replaced. The unit is a word, whatever changed within it, if the longer of two lines has at least `MIN_WORDS` words, and
a character (code point) if it has fewer, where a word would be too much of the line. Lines are ordered by (doc_id, place
in the text), a null id last; a line goes if an earlier one, kept or not, is within the bound, so of a series of lines
that drift apart by an edit each, only the first stays. Lines without a word are left alone.

The join is on deletion neighbourhoods: two lines of one length are within the bound only if they are equal without the
unit at some place, and two that differ by one in length only if the longer without some unit is the other. Lines emit
the hashes of such variants, and groups of equal variants are answered by their minimum, never by pairs: each line meets
the earliest line of the group. Pairs are verified unit for unit.

Variants are emitted only where there can be an equal one. With L the length of the shorter line, one edit lies in one of
any number of stretches that cut L units, and both lines agree in front of that stretch and behind it. So lines first
look for partners by the two halves, then by about sqrt(L) stretches, and emit the variants of the stretches that another
line shares. These are filters without loss, and keep the work on a line of n units at n * sqrt(n).

Texts are shuffled once, to fetch the lines that emit variants; all else travels as hashes. Lines are first reduced to
one row for each different line, with partial aggregates, so a line on a third of all pages costs one row.

Edge cases: a null text has no lines; rows that share an id and a text share their decisions; an empty table gives an
empty result. Internal work is on named columns only, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import let
from graphloom.session import materialize

from .ranks import numbered
from .text import single_spaced, spaced_words, whole

#: Words that the longer of two lines has at least for the unit to be a word.
MIN_WORDS = 8


def _split(text: Column) -> Column:
    return F.split(whole(text), "\n")


def normal(line: Column) -> Column:
    """A line in lower case, with one space between words."""
    return F.trim(single_spaced(F.lower(line)))


def halves(line: Column, n: Column) -> Column:
    """Hashes of which two lines within the bound share one; n: words of the line.

    The shorter of two lines, of L units, has L div 2 of them in front of the edit or behind it. Lines within the bound
    by characters have at most MIN_WORDS - 1 words, those by words at least that many.
    """
    size = F.length(line)
    cut = lambda h: F.call_function("substring_index", line, F.lit(" "), h)
    words = lambda h: [F.xxhash64(F.lit(1), h, cut(h)), F.xxhash64(F.lit(2), h, cut(-h))]
    letters = lambda h: [F.xxhash64(F.lit(3), h, line.substr(F.lit(1), h)), F.xxhash64(F.lit(4), h, line.substr(size - h + 1, h))]
    both = lambda ends, m: F.when(m % 2 == 1, F.array(*ends(F.floor(m / 2).cast("int")))).otherwise(F.array(*ends(F.floor(m / 2).cast("int")), *ends(F.floor(m / 2).cast("int") - 1)))
    none = F.array().cast("array<long>")
    return F.when(n >= MIN_WORDS, both(words, n)).otherwise(F.concat(both(letters, size), F.when(n == MIN_WORDS - 1, F.array(*words(F.lit((MIN_WORDS - 1) // 2)))).otherwise(none)))


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content, place, h1, h2 (hashes of the line), keys: a row for each line that has a word."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole(F.col(text))).alias("content"), F.posexplode(_split(F.lower(F.col(text)))).alias("place", "line"))
    rows = rows.select("doc_id", "content", "place", F.trim(single_spaced(F.col("line"))).alias("line")).filter("line != ''").withColumn("n", spaced_words(F.col("line")))
    return rows.select("doc_id", "content", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), halves(F.col("line"), F.col("n")).alias("keys"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "place")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has."""
    shared = rows.groupBy(key).agg(F.count("*").alias("n_")).filter("n_ > 1").select(key)
    return rows.join(shared, key, "left_semi")


def _candidates(lines: DataFrame) -> DataFrame:
    """The lines that share half their units with another line."""
    keys = lines.select("h1", "h2", F.explode(F.array_distinct("keys")).alias("key"))
    return lines.join(_shared(keys, "key").select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")


def _texts(lines: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rank (in the order of their first places), h1, h2, line of different lines."""
    ranked = numbered(lines.select("h1", "h2", "first"), [F.col("first"), F.col("h1"), F.col("h2")])
    wanted = ranked.groupBy("first.doc_id", "first.content").agg(F.collect_list(F.struct(F.col("first.place").alias("place"), "rank", "h1", "h2")).alias("wanted")).alias("w")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(whole(F.col(text))).alias("content")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.content") == F.col("w.content"))
    picked = let(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda x: F.struct(x["rank"].alias("rank"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.get(lines, x["place"]).alias("line"))))
    found = texts.join(wanted, same).select(F.explode(picked).alias("at")).select("at.rank", "at.h1", "at.h2", normal(F.col("at.line")).alias("line"))
    return found.dropDuplicates(["rank"])


def units(lines: DataFrame) -> DataFrame:
    """rank, kind (0 for words, 1 for characters), n, units (strings); a line of MIN_WORDS - 1 words has a row of each."""
    n = spaced_words(F.col("line"))
    words = F.struct(F.lit(0).alias("kind"), F.split("line", " ").alias("units"))
    letters = F.struct(F.lit(1).alias("kind"), F.split("line", "").alias("units"))
    both = F.when(n >= MIN_WORDS, F.array(words)).when(n == MIN_WORDS - 1, F.array(words, letters)).otherwise(F.array(letters))
    return lines.select("rank", F.explode(both).alias("of")).select("rank", "of.kind", F.size("of.units").alias("n"), "of.units")


def _without(array: Column, place: Column) -> Column:
    return F.concat(F.slice(array, 1, place - 1), F.slice(array, place + 1, F.size(array)))


def variants(lines: DataFrame) -> DataFrame:
    """variant, kind, place, n, shorter, rank: the deletions that another line may share. lines: rank, kind, n, units (long).

    shorter: the length of the shorter line that the variant is to meet, n for a replaced unit, else n - 1.
    """
    cut = lines.select("rank", "kind", "n", "units", F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("shorter"))
    cut = cut.withColumn("stretches", F.greatest(F.lit(1), F.ceil(F.sqrt("shorter"))).cast("int"))
    begin = lambda q: F.floor(q * F.col("shorter") / F.col("stretches")).cast("int")
    behind = lambda q: F.col("shorter") - begin(q + 1)
    key = lambda q: F.xxhash64("kind", "shorter", q, F.slice("units", 1, begin(q)), F.slice("units", F.col("n") - behind(q) + 1, behind(q)))
    keyed = cut.select("rank", "kind", "shorter", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("stretches") - 1), key)).alias("q", "key"))
    hit = _shared(keyed, "key").groupBy("rank", "kind", "shorter").agg(F.collect_list("q").alias("hits"))  # at most sqrt(n) of each line
    last = lambda q: F.col("n") - behind(q)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda q: F.when(last(q) > begin(q), F.sequence(begin(q) + 1, last(q))).otherwise(F.array().cast("array<int>")))))
    by_word = (F.col("kind") == 1) | (F.col("n") >= MIN_WORDS)  # by words, the longer line has at least so many
    placed = cut.filter(by_word).join(hit, ["rank", "kind", "shorter"]).select("rank", "kind", "units", "n", "shorter", F.explode(places).alias("place"))
    return placed.select(F.xxhash64(_without(F.col("units"), F.col("place"))).alias("variant"), "kind", "place", "n", "shorter", "rank")


def _near(lines: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """h1, h2 of the lines that have an earlier line one edit apart. lines: one row for each different line."""
    found = materialize(_texts(_candidates(lines), docs, doc_id, text), "near-candidates")
    cut = units(found)
    hashed = materialize(cut.withColumn("units", F.transform("units", lambda w: F.xxhash64(w))), "near-units")
    emitted = materialize(variants(hashed), "variants")
    replaced = emitted.filter("shorter = n")
    same = ["variant", "kind", "place", "n"]
    least = replaced.groupBy(*same).agg(F.min("rank").alias("earlier"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    replaced = replaced.join(least, same).filter("earlier < rank").select("kind", F.col("rank").alias("later"), "earlier", F.col("place").alias("a_place"), F.col("place").alias("b_place"))
    plain = hashed.select(F.xxhash64("units").alias("variant"), "kind", F.col("n").alias("shorter"), F.col("rank").alias("whole"))
    longer = emitted.filter("shorter < n").join(plain, ["variant", "kind", "shorter"])
    is_later, none = F.col("rank") > F.col("whole"), F.lit(None).cast("int")
    grown = longer.select("kind", F.greatest("rank", "whole").alias("later"), F.least("rank", "whole").alias("earlier"), F.when(is_later, F.col("place")).otherwise(none).alias("a_place"), F.when(is_later, none).otherwise(F.col("place")).alias("b_place"))
    pairs = replaced.unionByName(grown).groupBy("kind", "later", "earlier").agg(F.min("a_place").alias("a_place"), F.min("b_place").alias("b_place"))
    a = cut.select("kind", F.col("rank").alias("later"), F.col("units").alias("a"))
    b = cut.select("kind", F.col("rank").alias("earlier"), F.col("units").alias("b"))
    less = lambda x: F.when(F.col(f"{x}_place").isNull(), F.col(x)).otherwise(_without(F.col(x), F.col(f"{x}_place")))
    verified = pairs.join(a, ["kind", "later"]).join(b, ["kind", "earlier"]).filter(less("a") == less("b"))
    return found.join(verified.select(F.col("later").alias("rank")).distinct(), "rank", "left_semi").select("h1", "h2")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content, place, near: each line that goes; near if no equal line comes before it, only a similar one."""
    lines = materialize(occurrences(docs, doc_id, text), "lines")
    different = lines.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    different = materialize(different, "different-lines")
    near = materialize(_near(different, docs, doc_id, text), "near-lines")
    gone = different.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("n > 1 or near")
    gone = gone.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hit = lines.select("doc_id", "content", "place", "h1", "h2").join(gone, ["h1", "h2"])
    first = _order() == F.col("first")
    return hit.filter(F.col("near") | ~first).select("doc_id", "content", "place", (F.col("near") & first).alias("near"))


def line_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row doc_id, content, n_lines, removed (sorted places of the lines that go, from 0), n_near."""
    gone = removed_lines(docs, doc_id, text).distinct().groupBy("doc_id", "content").agg(F.sort_array(F.collect_list("place")).alias("removed"), F.count_if("near").alias("n_near")).alias("g")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole(F.col(text))).alias("content"), F.when(F.col(text).isNull(), 0).otherwise(F.size(_split(F.col(text)))).cast("long").alias("n_lines")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.content") == F.col("g.content"))
    return rows.join(gone, same, "left").select("d.doc_id", "d.content", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_empty: bool = True) -> DataFrame:
    """The documents without the lines that go; all other columns as they are.

    drop_empty: leave out documents that had a word and have none left.
    """
    gone = removed_lines(docs, doc_id, text).groupBy("doc_id", "content").agg(F.collect_set("place").alias("places")).alias("g")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(whole(F.col(text))).alias("content")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.content") == F.col("g.content"))
    joined = rows.join(gone, same, "left").select("row", "d.text", "g.places").withColumn("lines", F.when(F.col("places").isNotNull(), F.split("text", "\n")))
    joined = joined.withColumn("left_", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places"))
    cut = F.array_join(F.transform("left_", lambda i: F.get("lines", i)), "\n")
    joined = joined.select("row", F.when(F.col("places").isNull(), F.col("text")).otherwise(cut).alias("cut"), F.col("places").isNotNull().alias("changed"))
    if drop_empty:
        joined = joined.filter(~F.col("changed") | F.col("cut").rlike("[^\\x20\\x09-\\x0D]"))
    return joined.select(F.col("row").withField(text, F.col("cut")).alias("row")).select("row.*")
