import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bpe, queries, simhash, stages
from graphloom.llm.shingles import keep_one, shingle_set
from graphloom.session import materialize

from .test_lines import brute_removed, words
from .test_mixing import brute_targets


@pytest.fixture(scope="module")
def tables(spark, sf):
    """What each stage has kept, in order, with documents first."""
    found = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], sf), name.replace(" ", "-")))
    return found


def test_quality_keeps_the_good(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table that has ratings enough to tell
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    selected = stages.quality(spark, docs, sf)
    kept = {r.doc_id for r in selected.collect()}
    assert selected.columns == docs.columns
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((i in kept) == (q == 1) for i, q in labels) / len(labels) >= 0.95


def test_line_dedup_as_brute_force(tables):
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    gone, want = brute_removed(rows), {}
    for i, t in rows:
        text = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])
        if words(text) or not gone[i]:
            want[i] = text
    assert {r.doc_id: r.text for r in tables[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())


def brute_kept(present, former):
    """The smallest id of each class: documents are linked by their texts now or before, or one's now and the other's before."""
    sets = {i: [shingle_set((t or "").encode()) for t in dict.fromkeys([present[i], former.get(i, present[i])])] for i in present}

    def near(a, b):
        both = len(np.intersect1d(a, b))
        return (not len(a) and not len(b)) or 9 * both >= 4 * (len(a) + len(b)) > 0

    left, kept = dict.fromkeys(sorted(present)), set()
    while left:
        kept.add(first := next(iter(left)))
        del left[first]
        edge = [first]
        while edge:
            at = edge.pop()
            hit = [i for i in left if any(near(a, b) for a in sets[at] for b in sets[i])]
            edge += hit
            for i in hit:
                del left[i]
    return kept


def test_one_of_each_class_stays(tables):
    present, former = ({r.doc_id: r.text for r in tables[k].collect()} for k in (2, 0))
    assert {r.doc_id for r in tables[3].collect()} == brute_kept(present, former)
    assert tables[3].columns == tables[0].columns


def test_near_copies_go_after_their_shared_lines_have(spark, sf, tmp_path):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(12))
    lines = [[line() for _ in range(10)] for _ in range(4)]
    rows = [(i, "\n".join(x), "en", "s", 0) for i, x in enumerate(lines)]
    edited = [" ".join(["other" if k in (3, 7) else w for k, w in enumerate(x.split())]) if i == 2 else x for i, x in enumerate(lines[1])]
    rows += [(10, "\n".join(edited), "en", "s", 0), (11, "\n".join(lines[2][:3] + [line() for _ in range(7)]), "en", "s", 0), (None, "\n".join(lines[3]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    without = stages.line_dedup(spark, docs, str(tmp_path))
    assert {r.doc_id: r.text.count("\n") for r in without.collect()} == {0: 9, 1: 9, 2: 9, 3: 9, 10: 0, 11: 6}
    assert {r.doc_id for r in stages.near_duplicates(spark, without, str(tmp_path)).collect()} == {0, 1, 2, 3, 11}
    assert {r.doc_id for r in keep_one(without).collect()} == {0, 1, 2, 3, 10, 11}


def test_empty_tables_and_null_ids_through_the_pipeline(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("odd", [(None, "a b c", None, None, None), (None, None, "en", "s", 0), (1, "", "en", None, 0), (1, "d e\nd e", "en", "s", 7), (1, "d e\nd e", "en", "s", 7)])):
        folder = tmp_path / name
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert all(r.decodes for r in got) and bool(got) == bool(rows)


def test_mix_has_its_shares(tables):
    size, source, most = Counter(), Counter(), 0
    for r in tables[3].collect():
        size[r.doc_id] = len(words(r.text))
        source[r.source] += size[r.doc_id]
        most = max(most, size[r.doc_id])
    times = Counter(r.doc_id for r in tables[4].collect())
    assert max(times.values()) <= 2 and set(times) <= set(size)
    taken = Counter()
    for r in tables[4].collect():
        taken[r.source] += size[r.doc_id]
    assert all(abs(taken[s] - t) <= most for s, t in brute_targets(source).items())


def test_tokens_are_those_of_the_texts(tables):
    encoder = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    rows = tables[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in tables[4].collect())
    assert all(r.decodes and encoder.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_keep_one_with_null_ids_and_repeats(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "x y z"), (3, "x y z"), (5, "X  y z"), (None, ""), (7, None), (None, "q r s t u")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, content string")
    got = Counter((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert got == Counter([(None, "a b c d"), (3, "x y z"), (7, None), (None, "q r s t u")])
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_registered_queries_have_their_columns(spark, sf):
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 11)} and len(corpus_pipeline.STAGES) == 5
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert queries.op8_mix_sources(spark, sf).filter(F.col("taken") > 2 * F.col("size")).isEmpty()


def test_every_stage_begins_with_a_release(spark, sf, monkeypatch):
    class Released(Exception):
        pass

    def release(session):
        raise Released

    monkeypatch.setattr(stages, "release", release)
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(Released):
            stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
