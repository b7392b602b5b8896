"""Operators on texts against brute force, with the edge cases that their docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import common, decontaminate, language, masked_lm, mixing, queries, simhash, token_store, toxicity
from lakeloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = [(None, None, None, None, None), (900, None, "en", "a", 0), (901, "", "en", None, 0), (902, " \t\n ", None, "a", 3), (903, "---", "de", "b", 3)]


def word(rng):
    return "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))


def make_rows(n=60, seed=1, most=60):
    rng = random.Random(seed)
    rows = [(i, " ".join(word(rng) for _ in range(rng.randint(1, most))), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "é", "z"]), 1) for i in range(n)]
    rows += [(n + i, r[1], r[2], r[3], 1) for i, r in enumerate(rows[:10])]  # exact copies
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((n + 50, " ".join(word(rng) for _ in range(20_000)), "en", "a", 1))  # a very long text
    return rows + EMPTY


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- SimHash


def fingerprint(text, n=3):
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, linked):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash_matches_brute_force(docs):
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    roots = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r, k in zip(rows, roots):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((r.doc_id is None, r.doc_id, f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, roots))
    assert [g for g in got if not g[0]] == [w for w in want if not w[0]]
    assert [g[2:] for g in got if g[0]] == [w[2:] for w in want if w[0]]


@pytest.mark.parametrize("hot,block", [(64, 1024), (4, 8), (1, 3)])
def test_simhash_links_are_complete_however_lists_are_split(spark, monkeypatch, hot, block):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values)[:6]:  # dense groups and chains around some
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                v ^= 1 << b if rng.random() < 0.6 else 0
            values.add(v)
    values = sorted(values)
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    found = {r.node: r.root for r in components(simhash.links(fps)).collect()}
    roots = brute_components(values, lambda a, b: (a ^ b).bit_count() <= 3)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    groups, want = {}, {}
    for s, r in zip(signed, roots):
        groups.setdefault(found.get(s, s), set()).add(s)
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (1001, 1002)], "u long, v long")
    assert {r.node: r.root for r in components(edges).collect()} == {**dict.fromkeys(range(301), 0), 1001: 1001, 1002: 1001}


# ---- decontamination


def brute_hits(text, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("part_bytes", [8 << 20, 100])
def test_decontamination_matches_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    rng = random.Random(3)
    items = [(i, " ".join(word(rng) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (23, "Ü ß!x"), (24, items[4][1]), (4, items[5][1])]
    texts = ["", None, "!!", "a\x00b", items[5][1].upper(), items[6][1] + ", " + items[6][1]]
    for _ in range(60):
        words = [word(rng) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(words))
            own = (rng.choice(items)[1] or "").split()
            words[at:at] = own[rng.randint(0, max(0, len(own) - 10)) :]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    texts.append(" ".join(word(rng) for _ in range(30_000)) + " " + items[9][1])
    docs = spark.createDataFrame([(i, t, 99) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.search_benchmark(docs, bench).collect()}
    named = [(str(i), t) for i, t in items]
    assert got == {i: brute_hits(t, named) for i, t in enumerate(texts)}


def test_decontamination_of_no_rows_or_items(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.search_benchmark(none, bench).count() == 0
    assert decontaminate.search_benchmark(docs, bench).where("contaminated OR n_hit <> 0").count() == 0


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        now = {s: 3 * sizes[s] if s in full else left * w[s] / open_ for s in names}
        over = {s for s in names if s not in full and now[s] > 3 * sizes[s]}
        if not over:
            return now
        full |= over


@pytest.mark.parametrize("leaf", [2048, 4])
def test_mixing_meets_targets(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = spark.createDataFrame([r + ("x",) for r in make_rows(most=30)], SCHEMA + ", taken string").where("doc_id IS NULL OR doc_id <> 110")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r["size"] == n and r.taken == r.copies * n and r.taken <= 3 * n
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), n)
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.taken) for r in again) == sorted((r.doc_id or -1, r.text or "", r.taken) for r in rows)


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_mixing_of_shared_and_missing_ids_agrees_in_reruns(spark, monkeypatch, piece):
    monkeypatch.setattr(common, "NUMBERED", piece)
    monkeypatch.setattr(mixing, "LEAF", 64)
    rng = random.Random(8)
    rows = [(rng.choice([1, None]), " ".join(word(rng) for _ in range(rng.randint(1, 9))), "en", rng.choice(["a", "b", None]), 1) for _ in range(600)]
    rows += [(1, "one text", "en", "a", 1)] * 200 + [(None, None, None, None, None)] * 20
    docs = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(((r.doc_id or -1, r.text or "", r.source or "", r.taken) for r in mixing.mix(docs.repartition(k)).collect())) for k in (3, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert len({t for *_, x, _, t in ((i, x, s, t) for i, x, s, t in runs[0]) if x == "one text"}) > 1  # copies are rounded apart


def test_numbered_tells_equal_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "NUMBERED", 3)
    rows = common.cut(spark.createDataFrame([(i, k) for i, k in enumerate([5] * 20 + [6, 7, 7])], "row long, key long"), "rows")
    got = {}
    for r in common.numbered(rows, "key", "row", "nth").collect():
        got.setdefault(r.key, []).append(r.nth)
    assert {k: sorted(v) for k, v in got.items()} == {5: list(range(20)), 6: [0], 7: [0, 1]}


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(2)
    for _ in range(200):
        p, q, w, v = rng.random(), rng.random(), rng.randint(1, 50), rng.randint(1, 50)
        total, n = [0.0, 0.0], 2000
        for k in range(n):
            a, b = mixing.pivot(p, w, q, v, (k + 0.5) / n)
            assert a * w + b * v == pytest.approx(p * w + q * v) and (a in (0, 1) or b in (0, 1)) and 0 <= a <= 1 and 0 <= b <= 1
            total[0], total[1] = total[0] + a / n, total[1] + b / n
        assert total == pytest.approx([p, q], abs=2e-3)


def test_mixing_of_no_rows(none):
    assert mixing.mix(none).count() == 0


# ---- tokens


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for width in (1, 3, 7, 8, 13, 16, 17, 24, 31):
        ids = rng.integers(0, 1 << width, 1001).astype(np.uint32)
        data = token_store.pack(ids, width)
        assert len(data) == (1001 * width + 7) // 8 and (token_store.unpack(data, width, 1001) == ids).all()
    assert token_store.bits_for(49407) == 16 and token_store.bits_for(1) == 1


def test_random_access(monkeypatch):
    import io

    monkeypatch.setattr(token_store, "BLOCK_IDS", 64)
    rng, out = np.random.default_rng(2), io.BytesIO()
    texts = [rng.integers(0, 5000, rng.integers(0, 300)).astype(np.uint32) for _ in range(50)]
    writer = token_store.Writer(out, 13)
    for k, ids in enumerate(texts):
        writer.add(None if k == 49 else k, ids)
    writer.close()
    reader = token_store.Reader(io.BytesIO(out.getvalue()))
    for k in rng.permutation(50):
        assert (reader.document(int(k)) == texts[k]).all()
    everything = np.concatenate(texts)
    assert (reader.ids(100, 1000) == everything[100:1000]).all() and reader.nulls[49] and not reader.nulls[:49].any()


def encodings(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_encoder_matches_the_library():
    from lakeloom.llm.queries import vocabulary

    rng = random.Random(4)
    alphabet = "aZ é'sß1²ªº×İıΣς́  \tñÑ,.!|<>endoftext🙂漢字١\x1c\x85\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(500)]
    texts += ["<|endoftext|> it's DON'T\r\nx", "", " ", "á ́b", "ΑΣ ΑΣ. ΣΑΣ"]
    texts += ["a <|endoftext|> b", "a<|startoftext|><|endoftext|>b ", "<|EndOfText|> x", "<|endoftext |>", "<|endoftext|>" * 3, "Ünï <|startoftext|>\n" * 50]
    assert [x.tolist() for x in token_store.Encoder(vocabulary()).encode(texts, 2)] == encodings(texts)


def test_frequent_chunks_are_encoded_once(monkeypatch):
    """What many batches had is still known when rare chunks have filled the memory; blocks and forgetting change no id."""
    from lakeloom.llm.queries import vocabulary

    monkeypatch.setattr(token_store, "CACHE", 60)
    monkeypatch.setattr(token_store, "JOINED", 7, raising=False)
    encoder, given = token_store.Encoder(vocabulary()), []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **more):
            given.extend(w for t in texts for w in t.split())
            return self.tokenizer.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counting(encoder.tokenizer)
    letter = "abcdefghijklmnopqrstuvwxyz"
    often = "the of and House, don't\n\tof\r the. " + "ñandú Über 12"
    rare = [" ".join(f"{a}{b}{n}x" for b in letter) for n, a in zip(("q", "zz", "vv", "kk"), letter)]
    for batch in ([often], [often, ""], [rare[0], "", rare[1]], [rare[2]], [rare[3], often], [often]):
        given.clear()
        assert [x.tolist() for x in encoder.encode(batch, 2)] == encodings(batch)
    assert not given
    encoder.encode([rare[1], rare[2]], 2)
    encoder.encode([rare[0]], 2)
    given.clear()
    encoder.encode([often], 2)
    assert not given and len(encoder.chunks) < 200


def test_batches_are_put_together():
    import pyarrow as pa

    batches = [pa.record_batch({"text": t, "k": [str(x) for x in t]}, schema=pa.schema([("text", pa.string()), ("k", pa.string())])) for t in (["a" * 30, None], [], ["b"] * 5, ["c" * 200, "d"], ["e" * 60])]
    got = list(token_store.together(iter(batches), "text", 64))
    assert [x for b in got for x in b.column("text").to_pylist()] == [x for b in batches for x in b.column("text").to_pylist()]
    assert [b.num_rows for b in got] == [7, 1, 2] and not list(token_store.together(iter([]), "text"))


def test_token_table_matches_the_library(docs, none):
    from lakeloom.llm.queries import vocabulary

    got = token_store.token_table(docs, vocabulary()).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for r, ids in zip(got, encodings([r.text for r in rows])):
        assert (r.start, r.n_tokens) == (start, len(ids))
        if rows.count(next(x for x in rows if x.doc_id == r.doc_id)) == 1:
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_store.token_table(none, vocabulary()).count() == 0


# ---- learned operators


def test_toxicity_learns_words_and_leaves_the_fold_out(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [word(rng) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zorgle", "Flumpish", "krimmet"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + EMPTY, SCHEMA).withColumn("predicted", F.lit("clash"))
    known = spark.createDataFrame([*labels, labels[0], (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect() if r.doc_id is not None}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].predicted == 0
    # Labels of the held-out fold change nothing.
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels], "doc_id long, toxic int")
    assert np.array_equal(toxicity.train(docs, flipped).weights, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).weights)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(docs, known.limit(0)).score("x") == 0.0


def brute_grams(text):
    """The distinct hashed n-grams of three to six characters, in plain integers."""
    chars, found = [ord(c) for c in f" {text.lower()} "], set()
    for n in (3, 4, 5, 6):
        for k in range(len(chars) - n + 1):
            h = chars[k]
            for c in chars[k + 1 : k + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x85EBCA6B & 0xFFFFFFFF)
            found.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> 12)
    return found


def test_toxicity_matches_brute_force(spark, monkeypatch):
    rng = random.Random(16)
    texts = {i: " ".join(rng.choice(["zorgle", "blatt"] if i % 3 == 0 and rng.random() < 0.2 else ["lena", "Tomi", "käse", "und"]) for _ in range(rng.randint(3, 40))) for i in range(120)}
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()] + [(None, "zorgle", None, None, None), (7, texts[7], "xx", None, 3)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 100)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    known = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = [sum(i % 3 != 0 for i in known), sum(i % 3 == 0 for i in known)]
    counts = {}
    for i in known:
        for f in brute_grams(texts[i]):
            counts.setdefault(f, [0, 0])[i % 3 == 0] += 1
    ratio = {f: np.log(((b + 1) / (n[1] + 2)) / ((a + 1) / (n[0] + 2))) for f, (a, b) in counts.items() if a + b > 2}
    assert set(np.flatnonzero(model.weights)) <= set(ratio) and len(ratio) < toxicity.FEATURES
    # Over the scaled features the fitted weights are a minimum of the penalised loss.
    feature = sorted(ratio)
    place = {f: k for k, f in enumerate(feature)}
    x, y = np.zeros((len(known), len(feature))), np.array([i % 3 == 0 for i in known], float)
    for row, i in enumerate(known):
        for f in brute_grams(texts[i]) & place.keys():
            x[row, place[f]] = ratio[f]
    r = np.array([ratio[f] for f in feature])
    w = np.divide(model.weights[feature], r, out=np.zeros(len(r)), where=r != 0)

    def loss(w, b):
        z = x @ w + b
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (w**2).sum()

    b = model.intercept  # both classes are whole, so the intercept isn't moved
    for _ in range(20):
        assert loss(w, b) <= loss(w + np.random.default_rng(_).normal(0, 0.02, len(w)), b + rng.uniform(-0.05, 0.05)) + 1e-3
    want = {i: 1 / (1 + np.exp(-(b + sum(float(model.weights[f]) for f in brute_grams(t))))) for i, t in texts.items()}
    for part in (1 << 19, 16):  # and part by part
        monkeypatch.setattr(toxicity, "PART", part)
        for i, t in texts.items():
            assert model.score(t) == pytest.approx(want[i], abs=1e-5)
    for d in toxicity.score(docs, model).collect():
        if d.doc_id is not None:
            assert d.score == pytest.approx(want[d.doc_id], abs=1e-5) and d.predicted == int(d.score >= 0.3)


def brute_word_grams(word):
    """The hashed three- and four-letter n-grams of a word, its ends included."""
    m, found = 0xFFFFFFFF, []
    s = [0, *map(ord, word), 0]
    for k in range(1, len(s) - 1):
        pair = (s[k - 1] * 0x85EBCA6B & m) ^ (s[k] * 0xC2B2AE35 & m) ^ (s[k] >> 7)
        h3 = ((pair ^ (s[k + 1] * 0x27D4EB2F & m)) * 0x9E3779B1) & m
        found.append(h3 >> 16)
        if k + 1 < len(s) - 1:
            h4 = (((h3 ^ (s[k + 2] * 0x165667B1 & m)) * 0x9E3779B1) & m) ^ 0x5BD1E995
            found.append(h4 >> 16)
    return found


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_language_counts_and_scores_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(language, "PART", part)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice([["Kato", "miru", "o"], ["schön", "Übel", "und"], ["да", "нет", "ко1да"]][k]) for _ in range(rng.randint(1, 30))), ["xx", "yy", "zz"][k], "a", 1) for i in range(60) for k in [i % 3]]
    model = language.train(spark.createDataFrame([*rows, (99, "kato", None, "a", 1), (98, None, "xx", None, None)], SCHEMA).repartition(3))
    assert model.languages == ["xx", "yy", "zz"]
    counts = np.full((3, language.BUCKETS), 0.5)
    for _, t, lang, *_ in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for g in brute_word_grams(w):
                counts[model.languages.index(lang), g] += 1
    want = np.log(counts / counts.sum(axis=1, keepdims=True))
    np.testing.assert_allclose(model.log_p, want.T, rtol=1e-5)
    for d in language.identify(spark.createDataFrame(rows, SCHEMA), model).collect():
        letters = dict.fromkeys(model.languages, 0)
        found = list(re.finditer(r"[^\W\d_]+", d.text))
        for w in found:
            inside = [s.lang for s in d.spans if s.start <= w.start() and w.end() <= s.end]
            assert len(inside) == 1
            letters[inside[0]] += len(w[0])
        assert d.lang_pred == d.lang and d.score == pytest.approx(letters[d.lang_pred] / sum(letters.values()))


def test_language_labels_spans(spark, none):
    rng = random.Random(7)
    kinds = {"xx": ("ka", "to", "mi", "ru"), "yy": ("sch", "ein", "ung", "ver"), "zz": ("да", "не", "ко", "ва")}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, 40), k, "a", 1) for i, k in enumerate(["xx", "yy", "zz"] * 40)]
    model = language.train(spark.createDataFrame([*rows, (500, "abc", None, "a", 1)], SCHEMA))
    assert model.languages == ["xx", "yy", "zz"]
    first, second = text("xx", 30), text("yy", 10)
    tests = [(0, f"{first}. {second}", None, None, 1), (1, text("zz", 5), None, None, 1), *EMPTY, (2, "123 ...", None, None, 1), (3, "漢字", None, None, 1), (4, text("yy", 20_000), None, None, 1), (4, "ka", None, None, 1)]
    got = language.identify(spark.createDataFrame(tests, SCHEMA).withColumn("score", F.lit("clash")), model).collect()
    by = {r.doc_id: r for r in got if r.doc_id != 4}
    assert by[0].lang_pred == "xx" and 0.5 < by[0].score < 1 and [s.lang for s in by[0].spans] == ["xx", "yy"]
    assert abs(by[0].spans[0].end - len(first)) <= 12 and by[0].spans[-1].end == len(first) + 2 + len(second)
    assert by[1].lang_pred == "zz" and by[3].lang_pred in model.languages
    for i in (900, 901, 902, 2):
        assert (by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, [])
    assert sorted(r.lang_pred for r in got if r.doc_id == 4) == ["xx", "yy"]
    assert language.identify(none, model).count() == 0
    assert language.identify(spark.createDataFrame(tests, SCHEMA), language.train(none)).where("lang_pred <> 'und'").count() == 0


def test_viterbi_matches_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], rng.normal(0, 2, (language.BUCKETS, 3)).astype(np.float32), np.ones((language.N_SCRIPTS, 3), bool))
    w, _ = language.words(["ab cd efg hij", "", "kl mn opq rst uvw", "x"])
    score = model.scores(w)
    label = model.label(score, w.doc, 4, switch=1.5)
    for d in range(4):
        at = np.flatnonzero(w.doc == d)
        value = lambda path: sum(score[i, l] for i, l in zip(at, path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        if len(at):
            assert value(tuple(label[at])) == pytest.approx(max(map(value, product(range(3), repeat=len(at)))))


def test_masked_lm_matches_brute_force(docs):
    model = masked_lm.train(docs)
    net = masked_lm.Network(model.flat)
    for r in masked_lm.score(docs.where("doc_id < 8 OR doc_id >= 900"), model).collect():
        found, counts = masked_lm.buckets(__import__("pyarrow").array([r.text]))
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        assert r.n_tokens == len(words) == counts[0]
        ids, total = model.unit[found].astype(int), 0.0
        for k, unit in enumerate(ids):
            around = [ids[k + o] if 0 <= k + o < len(ids) else masked_lm.UNITS for o in (-2, -1, 1, 2)]
            h = np.tanh(net.e[around].ravel() @ net.w + net.b)
            z, y = h @ net.wc + net.bc, h @ net.wd[unit // 64] + net.bd[unit // 64]
            total += z[unit // 64] - np.log(np.exp(z).sum()) + y[unit % 64] - np.log(np.exp(y).sum())
        assert r.log_prob == pytest.approx(total, rel=1e-4, abs=1e-4)
        assert (r.mean_log_prob is None) == (not words)


def test_masked_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 800)
    monkeypatch.setattr(masked_lm, "ROUND", 300)
    docs = spark.createDataFrame([*make_rows(most=40), *[(1, "a b c", "en", "a", 1)] * 30], SCHEMA)
    found = []
    for k in (3, 7, 32):
        dealt = docs.repartition(k)
        model = masked_lm.train(dealt)
        found.append(sorted((r.doc_id or -1, r.text or "", r.log_prob) for r in masked_lm.score(dealt, model, by_word=True).collect()))
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        np.testing.assert_allclose([r[2] for r in other], [r[2] for r in found[0]], rtol=1e-5, atol=1e-4)


def test_masked_lm_words_of_long_texts_and_packing(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(word(rng) for _ in range(n)) + rng.choice(["", " ", "\n"]) for n in (0, 1, 3, 50, 400)] + ["x" * 500, None]
    whole = masked_lm.buckets(pa.array(texts))
    monkeypatch.setattr(masked_lm, "PART", 64)
    pieces = masked_lm.buckets(pa.array(texts))
    assert whole[1].tolist() == pieces[1].tolist() == [len((t or "").split()) for t in texts]
    assert (whole[0] == pieces[0]).all()
    assert (masked_lm.unpacked(masked_lm.packed(whole[0])) == whole[0]).all()


def test_byte_parts_end_where_words_end():
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choice("aB é\t\n 字🙂") for _ in range(rng.randint(0, 60)))
        for most in (1, 3, 10, 100):
            got = [w for part in common.byte_parts(text, most) for w in re.findall(rb"[^\x20\x09-\x0D]+", part)]
            assert got == re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())


def test_long_texts_take_bounded_memory():
    """A text of 40 MB: what each operator takes beside it, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from lakeloom.llm import language, masked_lm, simhash, toxicity
text = "lorem ipsum dolor sit amet " * (40_000_000 // 27)
model = language.Model(["a", "b"], np.zeros((language.BUCKETS, 2), np.float32), np.ones((language.N_SCRIPTS, 2), bool))
language.tables()
mlm = masked_lm.Model(np.zeros(1 << 20, np.int16), np.zeros(1 << 20, np.float32), np.zeros(masked_lm._SIZE, np.float32))
runs = {
    "simhash": lambda: simhash.fingerprint(text),
    "toxicity": lambda: toxicity.features(text, np.zeros(1 << 20, bool)),
    "language": lambda: [model.scores(language.words(p)[0]) for p, _, _ in language.parts([text])],
    "masked_lm": lambda: masked_lm.buckets(pa.array([text])),
}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
runs[sys.argv[1]]()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for name in ("simhash", "toxicity", "language", "masked_lm"):
        done = subprocess.run([sys.executable, "-c", code, name], capture_output=True, text=True, timeout=300, check=True)
        assert int(done.stdout) < 300, (name, done.stdout)


def test_gradient_for_any_mix_of_classes():
    """Classes of many, few and no rows, in each order, give the gradient of plain formulas, whatever ``out`` held before."""
    rng = np.random.default_rng(3)
    net = masked_lm.Network(rng.normal(0, 0.3, masked_lm._SIZE).astype(np.float32))
    out = np.full(masked_lm._SIZE, 7, np.float32)
    every = np.arange(64)
    for classes in (np.zeros(50), np.full(50, 63), np.array([5]), np.repeat(every, 20), np.repeat(every[::-1], 2), np.r_[np.zeros(30), 3, 3, np.full(9, 40), 62], np.r_[1, np.full(40, 2)]):
        of = classes.astype(np.int64)
        ids = of * 64 + rng.integers(0, 64, len(of))
        ctx = rng.integers(0, masked_lm.UNITS + 1, (len(of), 4))
        g, e = masked_lm.Network(net.gradient(ids, ctx, out)), {k: getattr(net, k).astype(float) for k in ("e", "w", "b", "wc", "bc", "wd", "bd")}
        x = e["e"][ctx].reshape(len(of), -1)
        h, rows = np.tanh(x @ e["w"] + e["b"]), np.arange(len(of))
        p, q = h @ e["wc"] + e["bc"], np.einsum("nh,nhs->ns", h, e["wd"][of]) + e["bd"][of]
        p, q = (np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) for z in (p, q))
        np.testing.assert_allclose(net.log_prob(ids, ctx), np.log(p[rows, of] * q[rows, ids % 64]), rtol=1e-4, atol=1e-5)
        p[rows, of] -= 1
        q[rows, ids % 64] -= 1
        p, q = p / len(of), q / len(of)
        wd, bd, ge = np.zeros((64, 32, 64)), np.zeros((64, 64)), np.zeros((masked_lm.UNITS + 1, 12))
        np.add.at(wd, of, h[:, :, None] * q[:, None])
        np.add.at(bd, of, q)
        dz = (p @ e["wc"].T + np.einsum("ns,nhs->nh", q, e["wd"][of])) * (1 - h * h)
        np.add.at(ge, ctx.ravel(), (dz @ e["w"].T).reshape(-1, 12))
        for name, want in (("wd", wd), ("bd", bd), ("wc", h.T @ p), ("bc", p.sum(axis=0)), ("w", x.T @ dz), ("b", dz.sum(axis=0)), ("e", ge)):
            np.testing.assert_allclose(getattr(g, name), want, rtol=1e-3, atol=1e-6)


def test_masked_lm_gradient_and_word_hashes():
    import pyarrow as pa

    a, n = masked_lm.buckets(pa.array(["The cat  THE", None, "", "cat\tthe"]))
    assert n.tolist() == [3, 0, 0, 2] and a[0] == a[2] == a[4] and a[1] == a[3] != a[0]
    net = masked_lm.Network.start(np.arange(masked_lm.UNITS)[::-1].astype(float))
    rng = np.random.default_rng(1)
    ids, ctx = rng.integers(0, masked_lm.UNITS, 40), rng.integers(0, masked_lm.UNITS + 1, (40, 4))
    g = net.gradient(ids, ctx)
    loss = lambda flat: -masked_lm.Network(flat).log_prob(ids, ctx).mean()
    for k in np.argsort(-np.abs(g))[:15]:
        up, down = net.flat.astype(np.float64), net.flat.astype(np.float64)
        up[k] += 1e-4
        down[k] -= 1e-4
        assert g[k] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=2e-2, abs=1e-5)


def test_masked_lm_learns_both_sides(spark, none):
    rng = random.Random(8)
    rows = []
    for i in range(1500):  # the word in the middle follows from its two neighbours together
        words = []
        for _ in range(12):
            a, b = rng.randint(0, 3), rng.randint(0, 3)
            words += [f"l{a}", f"m{(a + b) % 4}", f"r{b}"]
        rows.append((i, " ".join(words), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = masked_lm.train(docs)
    good = masked_lm.score(docs.limit(50), model).agg(F.avg("mean_log_prob")).first()[0]
    shuffled = spark.createDataFrame([(i, " ".join(sorted(t.split(), key=lambda w: hash((w, i)) % 97)), *r) for i, t, *r in rows[:50]], SCHEMA)
    assert good > masked_lm.score(shuffled, model).agg(F.avg("mean_log_prob")).first()[0] + 0.5
    assert masked_lm.score(none, model).count() == 0 and masked_lm.score(none, masked_lm.train(none)).count() == 0


def test_masked_lm_splits_shared_units_among_words(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9000)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(9000)], k=400)), "en", "a", 1) for i in range(80)]
    rows += [(80 + i, " ".join(words[i::20]), "en", "a", 1) for i in range(20)] + [(100, "qzx" * 9, "en", "a", 1)]
    spark.createDataFrame(rows[:100], SCHEMA).write.parquet(f"{tmp_path}/train.parquet")
    model = masked_lm.train(spark.read.parquet(f"{tmp_path}/train.parquet"))
    unit, share = model.unit.astype(int), np.exp(model.share.astype(np.float64))
    own = np.flatnonzero(np.bincount(unit, minlength=masked_lm.UNITS) == 1)
    np.testing.assert_allclose(np.bincount(unit, share, masked_lm.UNITS)[np.unique(unit)], 1, rtol=1e-4)  # so the probabilities of all buckets sum to 1
    assert len(own) and (share[np.isin(unit, own)] == 1).all() and share.min() > 0
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_prob for r in queries.op1_masked_lm(spark, str(tmp_path)).where("doc_id IN (0, 100)").collect()}
    fresh = masked_lm.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    by_unit = {r.doc_id: r.log_prob for r in masked_lm.score(spark.createDataFrame([rows[0], rows[100]], SCHEMA), fresh).collect()}
    assert got[100] < by_unit[100] - 3 and got[0] < by_unit[0]
    garbled, known = (masked_lm.score(spark.createDataFrame([(1, t, "en", "a", 1)], SCHEMA), model, by_word=True).first().log_prob for t in ("zzqqxx", "w300"))
    assert garbled < known


def test_masked_lm_trains_on_every_word(spark):
    adam = masked_lm.Adam(masked_lm.Network.start(np.ones(masked_lm.UNITS)))
    for n in (0, 1, 31, 5000, 70_000):
        dealt = []
        for at in masked_lm.deals(n, adam):
            dealt += at.tolist()
            adam.t += 1
        assert sorted(dealt) == list(range(n))
    # Texts of two words: no multiple of 8 lies in 2..3, so none of them was ever a target.
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i in range(4000) for t in [("a b", "c d")[i % 2]]], SCHEMA)
    model = masked_lm.train(docs)
    good, bad = (masked_lm.score(spark.createDataFrame([(1, t, "en", "a", 1)], SCHEMA), model).first().log_prob for t in ("a b", "a d"))
    assert good > bad + 1


def test_decontamination_keeps_the_benchmark_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 4000)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(12))) for i in range(200)]
    benchmark = spark.createDataFrame(items * 2, "item_id long, text string")
    parts = decontaminate.parts_of(benchmark, "item_id", "text")
    held = [decontaminate._items(p) for p in parts]
    assert len(parts) > 2 and all(isinstance(p, str) for p in parts)
    assert sorted(x for h in held for x in h) == sorted((str(i), t) for i, t in items)
    assert all(sum(len(t) for _, t in h) <= 4000 + 200 for h in held)
