"""Quality rules by cross-document line frequency.

Lines are normalised and hashed, the distinct documents of each host that hold a line are counted, lines above the
host's limit are removed, and a document of whose words too few are left is rejected. Exact copies of a text within a
host count as one document, so that copying alone doesn't make a line boilerplate.

All counts cover all documents. The counts are summed on (host, line, document) first, so a line that is on every page
of a host is dealt out over all tasks, and only its partial counts meet; when frequent lines are looked up, each is dealt
out over `SALTS` parts. Texts are never shuffled: lines travel as a hash of 16 bytes, and are made once.

Edge cases: a null text is empty, and has no words, so it fails the base rules; a null host is a host of its own;
repeated rows get equal results, one for each; an empty table gives an empty result. Only the three named columns are
read, so others cannot clash. Lines without a word are neither counted nor removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

from .text import GAP, SPACE, ascii_lower, single_spaced, spaced_words, whole, words_of

WINDOW = 8
#: Parts that the places of one line are dealt out over.
SALTS = 16
SYMBOLS = "#*$%&|<>"


def _covered(places: Column) -> Column:
    """Words that windows starting at these sorted places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("int").alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"), p.cast("int").alias("last")),
        lambda acc: acc["n"],
    )


def base_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, content (a hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = whole(F.col(text))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(body).alias("content"), body.alias("text"))
    d = d.withColumn("hashes", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    spoken = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.withColumn("spoken", spoken)
    last = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    d = d.select(
        "doc_id", "host", "content",
        F.size("hashes").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])).alias("windows"),
    )
    d = d.withColumn("doubled", F.size("windows") > F.size(F.array_distinct("windows")))
    # most texts repeat no window; the others alone are sorted, so that equal windows become neighbours
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.col("doubled"), placed))
    twins = F.filter("placed", lambda x, i: (F.get("placed", i - 1)["h"] == x["h"]) | F.coalesce(F.get("placed", i + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("twins", F.sort_array(F.transform(twins, lambda x: x["i"])))
    d = d.withColumn("n_repeat_words", F.when(F.col("doubled"), _covered(F.col("twins"))).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.drop("windows", "doubled", "placed", "twins").withColumn("base_failed", failed)


def _lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """doc_id, host, content, place, line and line2 (hashes of the normalised line), words, for each line with a word."""
    body = whole(F.col(text))
    clean = F.trim(single_spaced(F.col("line")))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(body).alias("content"), F.posexplode(F.split(ascii_lower(body), "\n")).alias("place", "line"))
    d = d.withColumn("line", clean).filter("line != ''").withColumn("words", spaced_words(F.col("line")).cast("long"))
    return d.select("doc_id", "host", "content", "place", F.xxhash64("line").alias("line"), F.xxhash64(F.lit(1), "line").alias("line2"), "words")


def _hits(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The lines that are frequent; those of one line are dealt out by place and document."""
    salt = F.pmod(F.xxhash64("content", "place"), F.lit(SALTS))
    parts = frequent.select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), F.col("line2").alias("f_line2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("f_salt"))
    same = F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line")) & (F.col("line2") == F.col("f_line2")) & (salt == F.col("f_salt"))
    return lines.join(parts, same, "left_semi")


def frequent_lines(docs: DataFrame, min_docs: int = 20, share: float = 0.01, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """host, line, line2 of the lines in more than max(min_docs, share of the host's) distinct documents of a host."""
    return _frequent(_lines(docs, doc_id, text, host), docs, min_docs, share, text, host)


def _frequent(lines: DataFrame, docs: DataFrame, min_docs: int, share: float, text: str, host: str) -> DataFrame:
    lines = lines.select("host", "line", "line2", "content")
    counts = lines.distinct().groupBy("host", "line", "line2").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    hosts = docs.select(F.col(host).alias("host"), F.xxhash64(whole(F.col(text))).alias("content")).distinct()
    limits = hosts.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("docs"))
    known = counts.join(limits, F.col("host").eqNullSafe(F.col("of")))
    return known.filter(F.col("n") > share * F.col("docs")).select("host", "line", "line2")


def line_frequency_rules(
    docs: DataFrame,
    min_docs: int = 20,
    share: float = 0.01,
    keep_share: float = 0.3,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """The base rules' columns, removed_words, and kept: whether a document passes the base rules and is not depleted.

    A document is depleted if less than keep_share of its words are left once frequent lines are gone.
    """
    names = {"doc_id": doc_id, "text": text, "host": host}
    lines = materialize(_lines(docs, **names), "lines")
    hit = _hits(lines, _frequent(lines, docs, min_docs, share, text, host))
    # repeated rows have the same lines, which count once
    removed = hit.select("doc_id", "host", "content", "place", "words").distinct().groupBy("doc_id", "host", "content").agg(F.sum("words").alias("hit_words"))
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("content").alias("r_content"), "hit_words")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("host").eqNullSafe(F.col("r_host")) & (F.col("content") == F.col("r_content"))
    rated = base_rules(docs, **names).join(removed, same, "left").withColumn("removed_words", F.coalesce("hit_words", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("removed_words") < keep_share * F.col("n_words")
    return rated.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("content", "r_id", "r_host", "r_content", "hit_words")


def strip_frequent_lines(docs: DataFrame, frequent: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents without the host's frequent lines; their other columns stay as they are."""
    names = {"doc_id": doc_id, "text": text, "host": host}
    hit = _hits(_lines(docs, **names), frequent)
    gone = hit.groupBy("doc_id", "host", "content").agg(F.collect_set("place").alias("places"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(whole(F.col(text))).alias("content")).alias("d")
    gone = gone.alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.host").eqNullSafe(F.col("g.host")) & (F.col("d.content") == F.col("g.content"))
    lines = F.split("d.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "g.places")
    cut = F.when(F.col("g.places").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    joined = rows.join(gone, same, "left").select("row", cut.alias("cut"))
    return joined.select(F.col("row").withField(text, F.col("cut")).alias("row")).select("row.*")
