"""Operators on pages and vectors against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import embedding_dedup, url_filter, warc
from lakeloom.llm.common import filesystem, new_dir

# ---- WARC


def make_pages(n=60, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"https://h{i}.org/ä b?q={i}", "<p>" + "é" * rng.randint(0, 300) + str(i)) for i in range(n)]
    rows += [(100 + i, f"http://copy.org/{i}", rows[7][2]) for i in range(20)]
    rows += [(200, None, None), (201, "x://y", ""), (202, "a\r\nX-Page: 1", "<a>\r\n\r\n</a>"), (None, "u", "null id"), (203, "u", "null id"), (204, "long", "x" * 2_000_000)]
    return rows + [rows[5], rows[5], rows[70]]


def expected(rows, least=0):
    first = {}
    for i, u, h in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        data = (h or "").encode()
        if len(data) >= least:
            first.setdefault(data, (i, u))
    out, seen = [], set()
    for i, u, h in rows:
        data = (h or "").encode()
        response = len(data) < least or (first[data] == (i, u) and data not in seen)
        if response:
            seen.add(data)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[data][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,roll", [(0, 64 << 20), (0, 2000), (50, 5000)])
def test_warc_round_trip_is_deterministic(spark, least, roll):
    rows = make_pages()
    pages = spark.createDataFrame([r + (1,) for r in rows], "page_id long, url string, html string, size int")
    sums = []
    for k in (3, 5):
        path = new_dir(spark, "warc")
        manifest = warc.write_warc(pages.repartition(k), path, least, roll)
        sums.append(sorted((r.name, r.sha1, r.n_records, r.bytes) for r in manifest.collect()))
        got = warc.read_warc(spark, path).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, least)
    assert sums[0] == sums[1] and (len(sums[0]) > 1) == (roll < 64 << 20)
    fs, root = filesystem(path)
    names = [f.base_name for f in fs.get_file_info(__import__("pyarrow.fs").fs.FileSelector(root))]
    assert not [n for n in names if n.startswith("_temporary")]
    order = []
    for name, *_ in sums[0]:
        data = gzip.decompress(fs.open_input_file(f"{root}/{name}").read())
        order += [int(m) if m else 10**9 for m in re.findall(rb"\r\nX-Page: (\d*)\r\nX-Payload", data)]
    assert order == sorted(order) and len(order) == len(rows)


def test_warc_of_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- URL filter


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    best = None
    for action, rule in url_filter.RULES:
        of, rest = rule.split("/", 1)
        if (host == of or host.endswith("." + of)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best


def test_url_filter_matches_brute_force(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/en", "http://example.com?x=/en/", "http://xcom/", "http://com/", "http://net/es/1", "http://a.net/fr/#x", "a://b://c/d", "http://É.com/\n/x", "http://u@h:80/p", "http://" + "a" * 50_000 + ".org/x"]
    urls += [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.', 'x.y.'])}{rng.choice(['example', 'casino', 'Library'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/', '/en/', '/es/', '/fr/a', '/poker/'])}{rng.choice(['', '?a', '#b', '1.html'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[5]])] + [(None, "http://x.org/", "")], "page_id long, url string, host string")
    got = url_filter.judge(pages, model).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        host, path = brute_parts(r.url)
        assert (r.host, r.path) == (host, path)
        rule = brute_rule(host, path)
        assert r.rule == (rule and rule[1]) and r.verdict == (rule[0] if rule else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_url_scores_match_brute_force(spark):
    from xxhash import xxh64_intdigest

    weights, intercept = model = url_filter.train(url_filter.labelled_urls(spark))
    urls = [None, "http://casino.example.org/de/poker?x", "HTTPS://Library.Example.COM/En/1#t", "a://ü/ß", "no", "http://x", "http://" + "ab" * 400 + ".org/" + "c" * 900]
    for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string"), model).collect():
        host, path = brute_parts(r.url)
        found = set()
        for kind, part in (("h", host), ("p", path)):
            seed, marked = xxh64_intdigest(kind.encode(), 42), f"^{part}$"
            for n in (3, 4):
                for k in range(len(marked) - n + 1):
                    h = xxh64_intdigest(marked[k : k + n].encode(), seed)
                    found.add((h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS)
        margin = intercept + sum(float(f"{weights[f]:.5g}") for f in found)
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-9)


def test_url_model_tells_words_apart(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    rows = [("https://superpoker.example.org/de/1", "block"), ("http://m.casinos.example.org/en/9", "block"), ("http://plain.example.org/en/warez/4.html", "block"), ("https://citymuseum.example.org/de/1", "allow"), ("http://ththan.example.org/en/5155#top", "allow"), ("http://tionsh.example.net/en/12/", "allow")]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame([(u,) for u, _ in rows], "url string"), model).collect()}
    assert got == dict(rows)
    assert url_filter.train(url_filter.labelled_urls(spark).limit(0)) == ([0.0] * url_filter.BUCKETS, 0.0)


# ---- embeddings


def brute_vectors(rows, threshold=0.93):
    ok = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    links = {k: set() for k in range(len(rows))}
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), least, r[0] is not None and r[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,block", [(128, 512), (3, 4)])
def test_near_vectors_match_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(embedding_dedup, "HOT", hot)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(40, 24))
    for k in range(160):
        v = base[k % 40] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.2, 0.3])
        rows.append((k, v.astype(np.float32).tolist(), int(k % 3) if k % 5 else 0))
    rows += [(200 + k, (base[0] + rng.normal(size=24) * 0.08).astype(np.float32).tolist(), 0) for k in range(25)]  # a dense group
    rows += [(300 + k, base[1].astype(np.float32).tolist(), 1) for k in range(12)]
    rows += [(400, None, 0), (401, [0.0] * 24, 0), (402, [None] * 24, 0), (403, [float("nan")] * 24, 0), (404, [float("inf")] * 24, 0), (405, rows[1][1], None), (None, rows[1][1], 1), (406, [], 0), (407, [1.0, 0.0], 0), (408, [2.0, 0.0], 0), rows[4], rows[4]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash")).repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table).collect()), key=str)
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a, o = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    for classes in (1_000, 50_000, 2_000_000):
        tables, bits = embedding_dedup.shape(classes, 64)
        x, y = (embedding_dedup.bucket_keys(v, tables, bits).reshape(2000, tables, -1) for v in (a, b))
        assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.995


def test_hadamard_is_the_matrix():
    h = np.array([[1.0]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(3).normal(size=(5, 8))
    assert np.allclose(embedding_dedup.hadamard(x), x @ h)


def test_doubles_are_compared_as_doubles(spark):
    a = np.zeros(16)
    a[0] = 1.0
    c = 0.93
    b = np.zeros(16)
    b[0], b[1] = c, np.sqrt(1 - c * c)
    below = np.zeros(16)
    below[0], below[1] = c - 1e-9, np.sqrt(1 - (c - 1e-9) ** 2)  # as floats it would reach the threshold
    rows = [(1, a.tolist(), 1), (2, b.tolist(), 1), (3, below.tolist(), 2), (4, a.tolist(), 2)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[3] == got[4] == 0


def test_components_of_hubs(spark):
    from lakeloom.llm.components import components

    edges = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(600, 900)] + [(899, 2000), (2000, 5000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(400), 0), **dict.fromkeys([*range(600, 900), 1000, 2000, 5000], 600)}
