"""The pipeline's stages against brute force on what each gets."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import queries, simhash


def test_stages_take_effect(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.cut(stage(spark, docs, sf), name)
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in queries.op3_toxicity(spark, sf).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, p in scores.items() if p == 0}
        if name == "simhash":
            groups = {}
            for r in before.collect():
                groups.setdefault(simhash.fingerprint(r.text), []).append(r.doc_id)
            roots = {p: p for p in groups}
            for p in groups:
                for q in groups:
                    if (p ^ q).bit_count() <= 3:
                        a, b = (next(iter(x)) for x in ({roots[p]}, {roots[q]}))
                        roots = {k: min(a, b) if v in (a, b) else v for k, v in roots.items()}
            least = {}
            for p, ids in groups.items():
                least[roots[p]] = min([*ids, *([least[roots[p]]] if roots[p] in least else [])])
            assert sorted(r.doc_id for r in docs.collect()) == sorted(least.values())
        if name == "decontaminate":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            hit = {r.doc_id for r in queries.op4_decontaminate(spark, sf).where("contaminated").collect()}
            assert gone == hit & {r.doc_id for r in before.collect()}
        if name != "token_ids":
            assert docs.columns == columns
    assert docs.count() == before.count() and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_of_no_rows(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_simhash_stage_keeps_one_row_of_each_group(spark, sf):
    a, b, c = (" ".join(f"{x}{i * i}" for i in range(40)) for x in "abc")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [
        (1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "s", 1),  # repeated rows
        (5, a, "en", "s", 1), (5, b, "en", "s", 1),  # an id of a copy and of a text of its own
        (None, c, "en", "s", 1), (None, c, "en", None, None), (None, c, "en", "s", 1),  # copies without ids
        (None, b, "en", "s", 1), (None, None, None, None, None), (9, "", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = corpus_pipeline.simhash(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, a), (5, b), (None, c), (9, "")], key=repr)


def test_stages_of_odd_rows(spark, sf):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with the stages' own names."""
    benchmark = queries.table(spark, sf, "benchmark").where("length(text) > 200").first().text
    long_ = " ".join(f"w{i}" for i in range(60_000))
    one = " ".join(f"t{i * i}" for i in range(50))
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t", None, "a", 2), (4, long_, "en", "a", 1),
        (5, one, "en", "b", 1), (5, one, "en", "b", 1), (6, one, "en", None, 1), (None, one, None, "b", None), (7, benchmark, "en", "b", 1), (8, "short one", "de", "c", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "size", "taken", "component_id", "n_hit", "items", "row", "at", "before"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.repartition(3)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, corpus_pipeline.cut(stage(spark, docs, sf), name)
        if name != "token_ids":
            assert docs.columns == columns
            kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    after_simhash = {t: i for i, t in kept[1]}
    assert sum(t == one for _, t in kept[1]) == 1 and after_simhash[one] == 5 and sum(not (t or "").strip() for _, t in kept[1]) <= 1
    assert all(t != benchmark for _, t in kept[2]) and any(t == long_ for _, t in kept[2])
    assert all(kept[3].count(x) <= 3 for x in kept[3]) and set(kept[3]) <= set(kept[2])
    assert docs.count() == len(kept[3])
