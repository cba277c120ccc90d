"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two models of order one are trained from labelled samples: random strings are the values that the fixed patterns find in
all documents; ordinary identifiers are made of the words of some documents, joined as identifiers, paths and dated names
join them, with numbers. A run of token characters is a secret if it is long enough, has a letter and a digit, overlaps no
match of a fixed pattern, and its log-likelihood ratio under the two models, for each character and in all, is above the
limits. Both models are tables of 67 x 67 transitions, whatever the corpus; the transitions are counted with partial
aggregates.

Everything is a native expression, and each text is read once. Where a match begins follows from the pieces between
matches: the text is split by the pattern, and lengths are summed along the text in blocks of the square root of their
number, so that a text of n matches takes n * sqrt(n) steps.

Edge cases: a null text is empty; without samples of either label nothing is added to the fixed patterns; repeated rows
get equal results; an empty table gives an empty result. Only the two named columns are read, so others cannot clash.
Positions are in code points, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import let, running

from .text import whole

# The patterns, and what a match of each must have.
ASSIGN = """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}+"  # runs of 24 or more are the matches of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
N = len(ALPHABET)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (s, k, e, m): begin, kind, end and text of the leftmost non-overlapping matches, in order."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    span = lambda begin, m: F.struct(begin.alias("s"), F.lit(kind).alias("k"), (begin + F.length(m)).alias("e"), m.alias("m"))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
        return let(gaps, lambda g: F.zip_with(F.zip_with(g, running(F.zip_with(g, found, lambda a, m: a + F.length(m)), F.lit(0), lambda a, b: a + b), lambda a, b: a + b), found, span))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def base_matches(text: Column) -> Column:
    """The matches of the fixed patterns by begin, then kind."""
    assign = F.filter(matches(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS, 1), lambda x: F.length(x["m"]) >= 20)
    return F.sort_array(F.concat(assign, access, matches(text, HEX, 2)))


# --- models


def spans(docs: DataFrame, min_length: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, runs: matches of the fixed patterns, and runs of at least min_length token characters."""
    body = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    return body.select("doc_id", base_matches(F.col("text")).alias("base"), matches(F.col("text"), f"{RUN}{{{min_length},}}+", 3).alias("runs"))


def ordinary_samples(docs: DataFrame, max_documents: int = 4000, text: str = "text") -> DataFrame:
    """token, random (false): names made of each two neighbouring words of about max_documents documents.

    The documents are those whose texts' hashes fall under a share, about max_documents of them, all if there are fewer.
    Names are joined by an underscore, a hyphen, a slash, a capital or nothing, and end in a word, a number, a version, a date or a time.
    """
    share = min(1.0, max_documents / max(docs.count(), 1))
    chosen = docs.select(whole(F.col(text)).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # a word begins where no letter is before it, so that a long run of letters is read once and not from each of its places
    pairs = chosen.select(F.explode(F.regexp_extract_all("text", F.lit("(?<![A-Za-z])[A-Za-z]{2,}+\\x20[A-Za-z]{2,}"), F.lit(0))).alias("pair"))
    pairs = pairs.select(F.split("pair", " ").alias("w"), F.xxhash64("pair").alias("h"))
    digit = lambda n, width: F.lpad(F.pmod(F.shiftright("h", 8), F.lit(n)).cast("string"), width, "0")
    one, two = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    low = [F.concat(F.lower(one), F.lit(glue), F.lower(two)) for glue in ("_", "-", "/", "")]
    joined = F.array(*low, F.concat(F.lower(one), F.initcap(two)), F.concat(F.initcap(one), F.initcap(two)), F.upper(low[0]))
    glue = F.array(*map(F.lit, ("_", "-", "/", "")))
    date = F.concat_ws("-", F.concat(F.lit("20"), digit(100, 2)), digit(12, 2), digit(28, 2))
    time = F.concat(F.lit("T"), digit(24, 2), F.lit("-"), digit(60, 2), F.lit("-"), digit(59, 2), F.lit("Z"))
    ends = F.array(F.lit(""), F.lit(""), digit(10_000, 4), F.concat(F.lit("v"), digit(10, 1)), date, F.concat(date, time), digit(1_000_000, 6))
    pick = lambda of, by: F.get(of, F.pmod(F.shiftright("h", by), F.size(of)).cast("int"))
    named = F.concat(pick(joined, 16), pick(glue, 24), pick(ends, 32))
    dated = F.concat(pick(ends, 40), pick(glue, 48), pick(joined, 16))
    return pairs.select(F.explode(F.array(named, dated)).alias("token"), F.lit(False).alias("random"))


def labelled_samples(docs: DataFrame, found: DataFrame | None = None, max_documents: int = 4000, text: str = "text") -> DataFrame:
    """token, random: the values that the fixed patterns find in all documents, and ordinary names. found: of spans."""
    found = spans(docs, text=text, doc_id=text) if found is None else found
    value = lambda x: F.when(x["k"] == 0, F.regexp_extract(x["m"], ASSIGN, 2)).otherwise(x["m"])
    known = found.select(F.explode(F.transform("base", value)).alias("token")).withColumn("random", F.lit(True))
    return known.unionByName(ordinary_samples(docs, max_documents, text))


def train(samples: DataFrame, smoothing: float = 5.0) -> list[float] | None:
    """Logarithm of P(next | character, random) / P(next | character, identifier) for each two characters of the alphabet.

    samples: token, random. smoothing: weight of the single characters' shares in each transition. None if there are no samples of one of the labels. What comes to the driver is a count for
    each label and transition.
    """
    clean = samples.select("random", F.regexp_replace("token", f"[^{RUN[1:]}", "").alias("token")).filter(F.length("token") > 1)
    letters = clean.select("random", F.split("token", "").alias("c"))
    pairs = letters.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {True: {}, False: {}}
    for random, pair, n in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        counts[random][pair] = n
    if not counts[True] or not counts[False]:
        return None
    single = {r: [1 + sum(n for pair, n in c.items() if pair[1] == b) for b in ALPHABET] for r, c in counts.items()}
    share = {r: [n / sum(ns) for n in ns] for r, ns in single.items()}
    table = []
    for a in ALPHABET:
        rows = {r: [c.get(a + b, 0) + smoothing * share[r][i] for i, b in enumerate(ALPHABET)] for r, c in counts.items()}
        sums = {r: sum(row) for r, row in rows.items()}
        table += [round(math.log(rows[True][i] / sums[True]) - math.log(rows[False][i] / sums[False]), 6) for i in range(N)]
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token, summed character by character."""
    weights = F.array(*[F.lit(x) for x in table])
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        now = F.instr(F.lit(ALPHABET), c) - 1
        return F.struct(now.alias("last"), F.when(acc["last"] < 0, 0.0).otherwise(acc["sum"] + F.get(weights, acc["last"] * N + now)).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"])


def judged(found: DataFrame, table: list[float] | None, per_character: float = 0.5, in_all: float = 12.0) -> DataFrame:
    """doc_id, base, added: of the runs of spans, those that the models call random and that no base match overlaps."""
    if table is None:
        return found.select("doc_id", "base", F.slice("runs", 1, 0).alias("added"))

    def secret(x: Column) -> Column:
        mixed = x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]")
        return mixed & (ratio(x["m"], table) >= F.greatest(F.lit(in_all), per_character * (F.length(x["m"]) - 1)))

    def apart(events: Column) -> Column:
        # a base match overlaps a run if one that begins before ends behind its begin, or the next one begins before its end
        last = running(F.transform(events, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        most = F.lit(2**31 - 1)
        following = F.reverse(running(F.transform(F.reverse(events), lambda x: F.when(x["k"] < 3, x["s"]).otherwise(most)), most, lambda a, b: F.least(a, b)))
        free = F.zip_with(F.arrays_zip(events.alias("x"), last.alias("last")), following, lambda p, f: F.when((p["x"]["k"] == 3) & (p["last"] <= p["x"]["s"]) & (f >= p["x"]["e"]), p["x"]))
        return F.filter(free, lambda x: x.isNotNull())

    random = found.select("doc_id", "base", F.filter("runs", secret).alias("random"))
    alone = let(F.sort_array(F.concat("base", "random")), apart)
    return random.select("doc_id", "base", F.when(F.size("random") == 0, F.col("random")).when(F.size("base") == 0, F.col("random")).otherwise(alone).alias("added"))


def scan(
    docs: DataFrame,
    table: list[float] | None,
    min_length: int = 20,
    per_character: float = 0.5,
    in_all: float = 12.0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, base, added: arrays of (s, k, e, m) of the fixed patterns, and of random strings outside them.

    table: of train, or None to add nothing. min_length, per_character, in_all: least length and log-likelihood ratios.
    """
    return judged(spans(docs, min_length, doc_id, text), table, per_character, in_all)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, table: list[float] | None, mark: str = "[SECRET]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with each span replaced by a mark; their other columns as they are. Overlapping spans are one."""
    inner = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    found = scan(inner.select(F.col("row").alias("doc_id"), "text"), table).select(F.col("doc_id").alias("row"), F.sort_array(F.concat("base", "added")).alias("spans"))
    body = F.col("row")[text]

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], body.substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(x["s"] < acc["at"], acc["out"]).otherwise(fresh).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    done = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], body.substr(acc["at"] + 1, F.length(body))))
    return found.select(F.col("row").withField(text, F.when(body.isNotNull(), done)).alias("row")).select("row.*")
