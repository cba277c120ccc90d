import random
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm import line_dedup as D
from graphloom.llm import line_frequency as L

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def near(a, b):
    """Whether two lines are at most one edit apart: of words if the longer has eight, else of characters."""
    if max(a.count(" "), b.count(" ")) >= D.MIN_WORDS - 1:
        a, b = a.split(" "), b.split(" ")
    if abs(len(a) - len(b)) > 1:
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return front + back >= max(len(a), len(b)) - 1


def brute_removed(rows):
    """doc_id -> places, for rows with different ids."""
    lines = [(i is None, i or 0, p, " ".join(words(line.lower()))) for i, t in rows for p, line in enumerate((t or "").split("\n")) if words(line)]
    lines.sort(key=lambda x: x[:3])
    out = defaultdict(list)
    for k, (no, i, p, w) in enumerate(lines):
        if any(near(v, w) for *_, v in lines[:k]):
            out[None if no else i].append(p)
    return {i: sorted(out[i]) for i, _ in rows}


def documents(seed=0):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "Theta", "É"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 1, 3, 6, 7, 8, 9, 20]))] for _ in range(14)]
    base += [["a"] * 9, ["x"], ["q"], ["aaaa"]]

    def edited(words):
        words = list(words)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at, kind = rng.randrange(len(words) + 1), rng.choice("idr")
            if kind == "i":
                words.insert(at, rng.choice(vocabulary))
            elif at < len(words):
                words[at : at + 1] = [] if kind == "d" else [rng.choice(vocabulary)]
        line = list(" ".join(words))
        for _ in range(rng.choice([0, 0, 0, 1])):
            line.insert(rng.randrange(len(line) + 1), rng.choice("ab é🙂"))
        return rng.choice(["", " ", "\t"]) + "".join(line).replace(" ", rng.choice([" ", "  ", "\t"]))

    rows = [(i, "\n".join(edited(rng.choice(base)) if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 12)))) for i in range(40)]
    return [*rows, (40, None), (41, ""), (None, rows[0][1])]


def test_line_dedup_as_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, place int, row int")
    want = brute_removed(rows)
    assert {r.doc_id: list(r.removed) for r in D.line_decisions(df).collect()} == want
    kept = {r.doc_id: r.text for r in D.dedup_lines(df).collect()}
    for i, t in rows:
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i])
        assert kept.get(i) == left or (i not in kept and want[i] and not words(left))
    assert D.dedup_lines(df).columns == df.columns


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x y\nx y"), (1, "x y\nx y"), (2, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id, tuple(r.removed)) for r in D.line_decisions(df).collect()) == [(1, (1,)), (1, (1,)), (2, (0,))]
    assert sorted(r.text for r in D.dedup_lines(df).collect()) == ["x y", "x y"]
    assert D.line_decisions(df.limit(0)).count() == 0 and D.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_and_lines_of_seven_and_eight_words(spark):
    lines = ["the quick brown fox jumps", "the quick brown fax jumps", "cat", "cart", "chapter 12 of the book", "chapter 21 of the book", "ab", "ba", "z"]
    lines += ["a1 a2 a3 a4 a5 a6 a7", "a1 a2 a3 new a4 a5 a6 a7", "a1 a2 a3 other a5 a6 a7"]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.line_decisions(df).collect() if r.removed) == [1, 3, 10]


def test_long_lines(spark):
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    many = [rng.choice("abcdefgh") for _ in range(100_000)]
    lines = [letters, letters[:777] + "Z" + letters[778:], letters[:9] + "ZZ" + letters[9:], letters[1:], " ".join(many), " ".join(many[:-9] + many[-8:]), " ".join(["y", "y", *many])]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in D.line_decisions(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 0}


def brute_rates(rows, min_docs, share, keep):
    normal = lambda line: " ".join(words("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
    on, docs = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        docs[h].add(t or "")
        for line in (t or "").split("\n"):
            if normal(line):
                on[h, normal(line)].add(t or "")
    out = []
    for i, t, h in rows:
        t = t or ""
        w = words(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        seen = defaultdict(int)
        for g in grams:
            seen[g] += 1
        covered = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
        spoken = [x for x in t.split("\n") if words(x)]
        gone = sum(len(words(x)) for x in spoken if len(on[h, normal(x)]) > min_docs and len(on[h, normal(x)]) > share * len(docs[h]))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(spoken) - len(set(spoken)), len(covered), failed, gone, not failed and len(w) - gone >= keep * len(w)))
    return sorted(out, key=str)


def test_line_frequency_as_brute_force(spark):
    rng = random.Random(3)
    common = ["All rights RESERVED by us", "menu # home | about"]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 3))]
        lines += [rng.choice(common) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.2:
            lines.append("the same nine words come again in this line " * 3)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h2", None])))
    rows += [(100, None, "h1"), (101, "", None), (0, rows[0][1], rows[0][2]), (None, "é 🙂 x", "h1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, line int")
    got = L.line_frequency_rules(df, 3, 0.05, 0.3)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == brute_rates(rows, 3, 0.05, 0.3)
    frequent = L.frequent_lines(df, 3, 0.05)
    stripped = L.strip_frequent_lines(df, frequent)
    assert stripped.count() == len(rows) and stripped.filter(F.lower("text").contains("all rights reserved by us")).count() == 0
    assert L.line_frequency_rules(df.limit(0)).count() == 0


def test_frequency_of_very_long_texts_and_one_common_line(spark):
    rng = random.Random(9)
    long = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(4000))
    rows = [(0, long, "h"), *((i, f"one line that every page of the host has\nword{i} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(30)), "h") for i in range(1, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = {r.doc_id: r for r in L.line_frequency_rules(df, 20, 0.01, 0.3).collect()}
    assert (got[0].n_words, got[0].removed_words, got[0].kept) == (200_000, 0, True)
    assert all((got[i].removed_words, got[i].kept) == (9, True) for i in range(1, 200))
