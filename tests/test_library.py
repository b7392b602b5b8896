"""Functions, search, sampling, sources, store and engine."""

from __future__ import annotations

import json
import math
import sys
import types

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import scalar as S
from lakeloom.functions.vectors import cosine_distance
from lakeloom.operators import metrics, sampling, search
from lakeloom.plans import registry
from lakeloom.plans.engine import Acceleration, DatasetSpec, Engine, ReadOnly, ResultsCache, check_read_only, check_refresh_sql
from lakeloom.sources import readers
from lakeloom.sources.scratch import new_dir
from lakeloom.sources.store import Store


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_greatest_and_least_skip_nulls(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 2.1), (3, None)], "a long, b double")
    assert [r[0] for r in df.select(F.greatest("a", "b")).collect()] == [1.0, 2.1, 3.0]


def test_cosine_distance(spark):
    v = lambda *x: F.array(*[F.lit(y) for y in x])
    assert one(spark, cosine_distance(v(1.0, 0.0), v(0.0, 2.0))) == pytest.approx(0.5)
    assert one(spark, cosine_distance(v(1.0, 0.0), v(3.0, 0.0))) == pytest.approx(0.0)
    assert one(spark, cosine_distance(v(1.0, 0.0), v(-3.0, 0.0))) == pytest.approx(1.0)
    assert math.isnan(one(spark, cosine_distance(v(0.0, 0.0), v(1.0, 1.0))))
    assert one(spark, cosine_distance(F.array(F.lit(1.0), F.lit(None)), v(1.0, 1.0))) is None
    with pytest.raises(Exception, match="different lengths"):
        one(spark, cosine_distance(v(1.0), v(1.0, 1.0)))


def test_postgres_functions(spark):
    s = F.lit("hello wide-world")
    assert one(spark, S.substr(F.lit("hello"), 0, 3)) == "he"
    assert one(spark, S.initcap(s)) == "Hello Wide-World"
    assert one(spark, S.regexp_replace(s, "(w)(.)", r"\2\1")) == "hello iwde-world"
    assert one(spark, S.regexp_replace(s, "(W)(.)", r"\2\1", "gi")) == "hello iwde-owrld"
    assert one(spark, S.regexp_match(s, r"(w\w+)-(\w+)")) == ["wide", "world"]
    assert one(spark, S.regexp_match(s, "zzz")) is None
    assert one(spark, S.trunc(F.lit(-3.789), 1)) == pytest.approx(-3.7)
    assert one(spark, S.log(F.lit(1000.0))) == pytest.approx(3)
    assert one(spark, S.concat(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "ab"
    assert one(spark, S.chr_(F.lit(128578))) == "🙂"
    assert one(spark, S.digest(F.lit("a"), "sha224")).hex().startswith("abd37534")
    assert one(spark, S.arrow_typeof(F.lit(1).cast("long"))) == "Int64"
    j = F.lit('{"a": {"b": [1, 2.5, true]}, "c": "x"}')
    assert one(spark, S.json_get_int(j, "a", "b", 0)) == 1 and one(spark, S.json_get_float(j, "a", "b", 1)) == 2.5
    assert one(spark, S.json_get_bool(j, "a", "b", 2)) is True and one(spark, S.json_get_str(j, "c")) == "x"
    assert one(spark, S.json_contains(j, "c")) and one(spark, S.json_length(j)) == 2 and one(spark, S.json_length(F.lit("[1,2,3]"))) == 3
    assert one(spark, F.to_json(S.json_get(j, "a"))) == '{"b":[1,2.5,true]}'


def test_null_order(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert [r.a for r in df.orderBy(S.asc("a")).collect()] == [1, 3, None]
    assert [r.a for r in df.orderBy(S.desc("a")).collect()] == [None, 3, 1]


def test_chunks_cover_the_text():
    text = "First sentence here. Second one follows.\n\nA new paragraph, somewhat longer than the rest of it."
    for target in (10, 25, 60, 500):
        bounds = search.chunk_bounds(text, target)
        assert all(b - a <= target for a, b in bounds)
        assert "".join("".join(text[a:b].split()) for a, b in bounds) == "".join(text.split())
    assert search.chunk_bounds("", 10) == []


def test_markdown_and_token_chunks():
    text = "# One\nalpha beta gamma\n\n## Two\ndelta epsilon zeta eta\ntheta iota\n# Three\nkappa"
    pieces = [text[a:b] for a, b in search.chunk_bounds(text, 40, markdown=True)]
    assert pieces[0] == "# One\nalpha beta gamma" and pieces[-1].endswith("# Three\nkappa") and all(len(p) <= 40 for p in pieces)
    words = lambda t: len(t.split())
    long_ = " ".join(f"w{i}" for i in range(500))
    chunks = search.chunk_bounds(long_, 7, size=words)
    assert " ".join(long_[a:b] for a, b in chunks) == long_ and all(words(long_[a:b]) <= 7 for a, b in chunks) and len(chunks) <= 80


def test_search_by_text_over_datasets(spark):
    embedder = search.hash_embedder(64)
    a = search.embed_column(spark.createDataFrame([(1, "red apple pie"), (2, "blue sky")], "id int, text string"), "text", embedder)
    b = spark.createDataFrame([("k", "apple pie red", 5), ("l", "green tree", 6)], "key string, body string, n int")
    found = search.search_datasets({"a": (a, "text", ["id"]), "b": (b, "body", ["key"])}, search.SearchRequest("red apple pie", limit=2, additional_columns=["n"]), embedder).collect()
    assert [(r.dataset, r.primary_key) for r in found] == [("a", '{"id":1}'), ("b", '{"key":"k"}')] and found[1].metadata == '{"n":5}'
    assert all(abs(r.score - 1) < 1e-6 for r in found)


def test_embedders_get_few_texts_at_a_time(spark):
    """Each vector holds the number of texts that its call got: neither long texts nor many rows add to it."""

    def embedder(texts):
        return [[float(len(texts)), float(len(t or ""))] for t in texts]

    long_ = "word " * 40_000
    rows = [(1, long_), (2, None), (3, ""), (4, "one two"), *((k, "some words of a row") for k in range(5, 2000))]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: r for r in search.embed_column(df, "text", embedder, target_chunk=40).collect()}
    assert len(got) == len(rows) and max(v[0] for r in got.values() for v in r.text_embedding) <= 512
    for i, text in rows:
        bounds = search.chunk_bounds(text or "", 40)
        assert [tuple(x) for x in got[i].text_offset] == bounds and [v[1] for v in got[i].text_embedding] == [b - a for a, b in bounds]
    plain = {r.id: r.text_embedding for r in search.embed_column(df, "text", embedder).collect()}
    assert len(plain) == len(rows) and max(v[0] for v in plain.values()) <= 512 and [plain[i][1] for i in (1, 2, 3, 4)] == [200_000, 0, 0, 7]


def test_best_chunks_match_brute_force(spark, sf):
    from lakeloom.plans.operator_queries import QUERIES, QUERY

    embedder, best = search.hash_embedder(64), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        chunks = [r.text[a:b] for a, b in search.chunk_bounds(r.text or "", 400)]
        scores = []
        for text, v in zip(chunks, embedder(chunks)):
            size = sum(x * x for x in v) ** 0.5 * sum(x * x for x in QUERY) ** 0.5
            if size:
                scores.append((1 - (1 - sum(x * y for x, y in zip(v, QUERY)) / size) / 2, text))
        if scores:
            best.append((max(s for s, _ in scores), r.doc_id))
    want = sorted(best, key=lambda x: (-round(x[0], 9), x[1]))[:10]
    got = [(r.score, r.doc_id) for r in QUERIES["vec_chunk_best"](spark, sf).collect()]
    assert [i for _, i in sorted(got, key=lambda x: (-round(x[0], 9), x[1]))] == [i for _, i in want]
    assert [s for s, _ in sorted(got, reverse=True)] == pytest.approx([s for s, _ in want])


def test_files_of_a_web_server_are_a_dataset(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"a,b\n1,x\n2,y\n")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    engine = Engine(spark)
    engine.register(DatasetSpec("from_web", f"http://127.0.0.1:{server.server_port}/data/t.csv"))
    server.shutdown()
    assert [tuple(r) for r in engine.sql("SELECT a, b FROM from_web ORDER BY a").collect()] == [(1, "x"), (2, "y")]
    assert "CREATE TABLE from_web" in engine.schema_prompt()


def test_search_plain_and_chunked(spark):
    embedder = search.hash_embedder(32)
    query = embedder(["blue whale"])[0]
    df = spark.createDataFrame([(1, "the red fox"), (2, "a blue whale"), (3, "x " * 100 + "blue whale. " + "y " * 100), (4, None)], "id int, text string")
    plain = search.embed_column(df, "text", embedder)
    assert search.embedding_kind(plain.schema, "text") == "plain"
    assert search.vector_search(plain, "text", ["id"], search.SearchRequest(query, limit=1), "d").first().value == "a blue whale"
    chunked = search.embed_column(df, "text", embedder, target_chunk=14)
    assert search.embedding_kind(chunked.schema, "text") == "chunked"
    found = search.vector_search(chunked, "text", ["id"], search.SearchRequest(query, where="id = 3"), "d").first()
    assert "blue" in found.value and 0 <= found.score <= 1 and found.dataset == "d" and found.primary_key.id == 3
    assert search.embedding_kind(df.schema, "text") is None
    ordered = search.predict(df.withColumn("ts", -F.col("id")), lambda batches: (b[["id"]] for b in batches), "id int")
    assert ordered.count() == 4


def test_samples(spark):
    df = spark.createDataFrame([(i % 3, "abc"[i % 2]) for i in range(20)], "x int, y string")
    rows = [tuple(r) for r in sampling.sample_distinct(df, ["x", "y"], 4).collect()]
    assert rows == [(0, "a"), (1, "b"), (2, "a"), (0, "a")]
    assert sampling.sample_top(df, "x desc, y", 1).first().x == 2


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double")
    counts = metrics.bucket_counts(df, "v", [25.0, 50.0, 75.0])
    got = counts.select(*[metrics.percentile(F.col("buckets"), p).alias(str(p)) for p in (0.1, 0.5, 0.75, 0.99)]).first()
    assert tuple(got) == pytest.approx((10.0, 50.0, 75.0, 75.0))
    assert metrics.bucket_counts(df.limit(0), "v", [1.0]).select(metrics.percentile(F.col("buckets"), 0.5)).first()[0] is None


PAGES = {None: {"data": {"rows": [{"a": {"id": 1, "n": {"x": 2}}}], "page": {"next": "2"}}}, "2": {"data": {"rows": [{"a": {"id": 3, "n": {"x": 4}}}], "page": {"next": None}}}}


def test_paged_json_and_unnesting(spark, tmp_path, monkeypatch):
    code = f"import json\nPAGES = {PAGES!r}\ndef fetch(cursor):\n    return json.dumps(PAGES[cursor])\n"
    (tmp_path / "paged_fixture.py").write_text(code)
    spark.sparkContext.addPyFile(str(tmp_path / "paged_fixture.py"))
    schema = "a struct<id int, n struct<x int>>"
    one_level = readers.read_paged(spark, "paged_fixture:fetch", schema, "/data/rows", "/data/page/next", depth=1)
    assert one_level.columns == ["id", "n"]
    two = readers.read_paged(spark, "paged_fixture:fetch", schema, "/data/rows", "/data/page/next", depth=2)
    assert sorted(map(tuple, two.collect())) == [(1, 2), (3, 4)]
    with pytest.raises(ValueError, match="two columns"):
        readers.unnest(spark.sql("SELECT 1 AS id, named_struct('id', 2) AS s"), 1)


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# one\ntext")
    (tmp_path / "d/b.md").write_text("two")
    docs = readers.read_files(spark, str(tmp_path / "d"), "text")
    assert sorted(r.content for r in docs.collect()) == ["# one\ntext", "two"]
    assert sorted(r["size"] for r in readers.listing(spark, str(tmp_path / "d")).collect()) == [3, 10]
    (tmp_path / "t.csv").write_text('id,name\n1,"a,b"\n2,c\n')
    assert [tuple(r) for r in readers.read_files(spark, str(tmp_path / "t.csv")).collect()] == [(1, "a,b"), (2, "c")]
    with pytest.raises(ValueError):
        readers.read_files(spark, str(tmp_path / "d"))
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space='preserve'> you</w:t></w:r></w:p><w:p><w:t>x</w:t></w:p>")
    assert readers.docx_text(buffer.getvalue()) == "Hello you\nx"
    (tmp_path / "d/f.docx").write_bytes(buffer.getvalue())
    parsed = readers.parsed_documents(spark, str(tmp_path / "d/f.docx"), readers.docx_text)
    assert parsed.first().content == "Hello you\nx"


def test_partition_columns_are_text(spark):
    path = new_dir(spark, "hive")
    spark.createDataFrame([(1, 2024), (2, 2025)], "id int, year int").write.partitionBy("year").parquet(path)
    assert dict(readers.read_files(spark, path, "parquet", hive_partitions=True).dtypes)["year"] == "string"
    assert readers.read_files(spark, path, "parquet").columns == ["id"]


def test_store_readers_keep_their_version(spark):
    store = Store(spark, new_dir(spark, "store"))
    assert store.read() is None
    store.overwrite(spark.range(3))
    before = store.read()
    store.overwrite(before.where("id > 0"))
    store.append(spark.range(10, 12))
    assert before.count() == 3 and sorted(r.id for r in store.read().collect()) == [1, 2, 10, 11] and store.latest()["rows"] == 4


@pytest.mark.parametrize("sql,ok", [("SELECT 1", True), ("  -- note\nWITH a AS (SELECT 1) SELECT * FROM a", True), ("SELECT 'drop table x; delete from y'", True), ("DROP TABLE x", False), ("INSERT INTO t VALUES (1)", False), ("SELECT 1; SELECT 2", False), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False), ("SET x = 1", False), ("CREATE VIEW v AS SELECT 1", False), ("EXPLAIN SELECT 1", True), ("SELECT '--' ; DROP TABLE x", False), (r"SELECT 'it\'s; ok'", True), ("SELECT 'a''; b' -- ; c", True)])
def test_only_reading_statements(sql, ok):
    if ok:
        check_read_only(sql)
    else:
        with pytest.raises(ReadOnly):
            check_read_only(sql)


@pytest.mark.parametrize("sql,ok", [("SELECT * FROM t", True), ("select * from t where a > 1 order by a limit 5", True), ("SELECT a FROM t", False), ("SELECT * FROM u", False), ("SELECT * FROM t JOIN u", False), ("SELECT * FROM t WHERE a > 1 UNION SELECT * FROM u", False), ("SELECT * FROM t WHERE x = 1 EXCEPT SELECT * FROM u", False), ("SELECT * FROM t LIMIT 5; DROP TABLE x", False), ("SELECT * FROM t WHERE a IN (SELECT b FROM u)", False), ("SELECT * FROM t WHERE EXISTS (SELECT 1 FROM u)", False), ("SELECT *, 1 FROM t", False), ("SELECT DISTINCT * FROM t", False), ("SELECT * FROM t -- note\nWHERE v = 'join; union'", True)])
def test_refresh_statements(spark, sql, ok):
    if ok:
        check_refresh_sql(sql, "t")
    else:
        with pytest.raises(ValueError):
            check_refresh_sql(sql, "t")


def test_engine_life_cycle(spark):
    engine = Engine(spark, ResultsCache(ttl=60))
    acc = Acceleration(new_dir(spark, "kept"), mode="append", primary_key=["id"], on_conflict={("id",): "upsert"}, on_zero_results="use_source")
    source = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "id int, t long, v string")
    engine.register(DatasetSpec("things", source, mode="read_write", time_column="t", time_format="unix_seconds", acceleration=acc))
    count = "SELECT count(*) AS n FROM things"
    assert engine.fetch(count).first()["n"] == 2
    assert engine.fetch(count) is engine.fetch(count)
    engine.write("things", spark.createDataFrame([(2, 20, "B"), (3, 15, "c")], source.schema))
    assert {tuple(r) for r in engine.table("things").collect()} == {(1, 10, "a"), (2, 20, "B"), (3, 15, "c")}
    assert engine.fetch(count).first()["n"] == 3
    engine.specs["things"].source = spark.createDataFrame([(1, 10, "old"), (4, 30, "d")], source.schema)
    assert engine.refresh("things") and engine.table("things").count() == 4
    assert engine.scan("things", "v = 'old'").count() == 1 and engine.scan("things", "v = 'a'").count() == 1
    assert engine.delete("things", "id = 4").first()["count"] == 1
    changes = spark.createDataFrame([(1, "d", (1, 10, "a")), (1, "c", (9, 1, "n"))], "seq int, op string, data struct<id int, t long, v string>")
    engine.apply("things", changes)
    assert {r.id for r in engine.table("things").collect()} == {2, 3, 9}
    with pytest.raises(ReadOnly):
        engine.sql("DELETE FROM things")
    with pytest.raises(ValueError):
        engine.set_refresh_sql("things", "SELECT id FROM things")
    with pytest.raises(ValueError, match="depend on each other"):
        engine.register_views({"va": "SELECT * FROM vb", "vb": "SELECT * FROM va"})
    engine.system_tables()
    assert spark.table("runtime_task_history").count() > 3 and spark.table("runtime_datasets").first().accelerated
    assert "id int" in engine.table_schema("things") and engine.primary_keys() == {"things": ["id"]}
    engine.register(DatasetSpec("fixed", source))
    with pytest.raises(ReadOnly):
        engine.write("fixed", source)


def test_results_cache_forgets(spark):
    cache = ResultsCache(max_bytes=100, ttl=60)
    asked, other = spark.range(3).where("id > 1"), spark.range(3).where("id > 2")
    for k in range(3):
        cache.put((k, (("t", k),)), asked, spark.range(k), 48)
    assert cache.get((0, (("t", 0),)), asked) is None and cache.get((2, (("t", 2),)), asked).count() == 2
    assert cache.get((2, (("t", 2),)), other) is None  # another plan with an equal key
    cache.put((3, (("u", 0),)), asked, asked, 101)
    assert (3, (("u", 0),)) not in cache.entries
    cache.invalidate("t")
    assert not cache.entries and cache.size == 0


def test_sql_falls_back_to_the_source_and_knows_system_tables(spark):
    engine = Engine(spark)
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    acc = Acceleration(new_dir(spark, "kept"), refresh_sql="SELECT * FROM backed WHERE id = 1", on_zero_results="use_source")
    engine.register(DatasetSpec("backed", source, acceleration=acc))
    assert [r.v for r in engine.sql("SELECT v FROM backed").collect()] == ["a"]
    assert [r.v for r in engine.sql("SELECT v FROM backed WHERE id = 2").collect()] == ["b"]
    assert [r.v for r in engine.sql("SELECT v FROM backed").collect()] == ["a"]
    named = "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public' AND table_name = 'backed' AND 'runtime.x' <> ''"
    assert [r.table_name for r in engine.sql(named).collect()] == ["backed"]
    found = engine.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'backed' ORDER BY ordinal_position").collect()
    assert [tuple(r) for r in found] == [("id", "int"), ("v", "string")]
    assert engine.sql("SELECT count(*) AS n FROM runtime.task_history WHERE error_message IS NULL").first().n > 2


def test_refresh_is_retried(spark, monkeypatch):
    from lakeloom.operators import retry

    monkeypatch.setattr(retry, "waits", lambda most=None, longest=0: iter([0.0] * (most or 0)))
    engine, tries = Engine(spark), []
    engine.specs["flaky"] = DatasetSpec("flaky", spark.range(3), acceleration=Acceleration(new_dir(spark, "kept")))

    def source(spec):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not now")
        return spec.source

    monkeypatch.setattr(engine, "source", source)
    assert engine.refresh("flaky") == 3 and len(tries) == 3
    with pytest.raises(ValueError):
        engine.refresh("flaky", sql="SELECT id FROM flaky")


def test_llm_is_not_needed():
    import ast
    from pathlib import Path

    root = Path(readers.__file__).resolve().parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_function_registry(spark):
    from lakeloom.functions.registry import FUNCTIONS, call

    assert len(FUNCTIONS) > 85
    assert one(spark, call("LPAD", F.lit("a"), F.lit(3), F.lit("*"))) == "**a"
    assert one(spark, call("date_part", F.lit("year"), F.lit("2024-05-06").cast("date"))) == 2024
    assert one(spark, call("least", F.lit(3), F.lit(None).cast("int"), F.lit(2))) == 2
    assert one(spark, call("trunc", F.lit(1.99))) == 1.0
    with pytest.raises(ValueError, match="no function"):
        call("nothing")


def test_sinks_and_catalog(spark):
    engine = Engine(spark)
    engine.register(DatasetSpec("late", None, mode="read_write", acceleration=Acceleration(new_dir(spark, "late"))))
    assert not engine.table_exists("late")
    assert engine.write("late", spark.range(3)) == 3 and engine.table_exists("late")
    with pytest.raises(ValueError):
        engine.write("late", spark.createDataFrame([("x",)], "id string"))
    engine.register_views({"late_view": "SELECT id FROM late WHERE id > 0"})
    engine.system_tables()
    got = {(r.table_schema, r.table_name, r.table_type) for r in engine.tables().collect()}
    assert {("public", "late", "BASE TABLE"), ("public", "late_view", "VIEW"), ("runtime", "runtime_task_history", "BASE TABLE")} <= got
    assert engine.tables("runtime").count() == 3


def test_unnest_reaches_every_word_of_every_document(spark, tmp_path):
    texts = {0: "a b c d e f  g", 199: "", 200: "x", 5000: " ".join(map(str, range(3000))), 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["arrays_unnest_all"](spark, str(tmp_path)).collect())
    assert got == sorted((i, k + 1, w) for i, t in texts.items() if t is not None for k, w in enumerate(t.split(" ")))
