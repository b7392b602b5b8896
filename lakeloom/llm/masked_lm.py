"""LM scoring by masked pseudo-likelihood with a bidirectional window network.

A word is masked and predicted from the ``WINDOW`` words on either side: their
embeddings, joined, feed a hidden layer, which predicts the word's class and, in the
class, the word (two softmaxes of 64). The sum of the log-probabilities of all words
of a document, each given both sides, is its pseudo-log-likelihood.

Words (between ASCII white space, A-Z lower-cased) are hashed into ``HASHED``
buckets; those of the most frequent buckets are units of their own, and the rest
share ``RARE`` units. Frequencies are counted over all documents. A word of a shared
unit has its bucket's share of the unit's probability: (count + SMOOTH) / (unit's count +
SMOOTH * unit's buckets), so unseen buckets have a share too and the shares of a unit
sum to 1. ``score`` splits units among words with ``by_word``. Then the network
is trained over all documents, dealt by hash into shards of about ``SHARD_WORDS`` words: a
task masks every word of its shard once, trains a copy of the network in numpy, and
returns its parameters in pieces; the pieces' means, weighted by words and taken in
levels of 64, are the network. A step takes ``FIRST_BATCH`` words at first and twice as
many after every ``DOUBLE`` steps, up to ``BATCH``, in every shard, so few words give
many steps. Scoring predicts every word. Neither shards nor scores depend on how the
table is partitioned.

Defined cases: a null or empty text has no words, log_prob 0 and a null mean;
repeated rows count each; a very long text is worked through in parts; an empty table gives an empty result; columns of ``docs``
that clash with the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import byte_parts, cut, map_batches, numbered, slices

HASH_BITS = 20
SIDE = 64
UNITS = SIDE * SIDE
RARE = 128
WINDOW = 2
WIDTH = 12
HIDDEN = 32
BATCH = 1024
FIRST_BATCH = 32
DOUBLE = 128
RATE = 0.003
PIECE = 4096
#: Parameters that a step changes at a time.
BLOCK = 1 << 15
#: Bytes of text whose words are hashed at a time.
PART = 1 << 19
#: Words that a copy of the network is trained on, and copies at most: beyond, they train on more.
SHARD_WORDS, SHARDS = 1 << 21, 1 << 16
#: Words that are dealt in random order at a time.
ROUND = 1 << 18
#: Added to the count of every bucket of a shared unit, seen or not.
SMOOTH = 0.5
ADDED = {"n_tokens": T.LongType(), "log_prob": T.DoubleType(), "mean_log_prob": T.DoubleType()}

#: ``d`` holds each class's matrix (``wd``) and, as its last row, its biases (``bd``).
_SHAPES = {"e": (UNITS + 1, WIDTH), "w": (2 * WINDOW * WIDTH, HIDDEN), "b": (HIDDEN,), "wc": (HIDDEN, SIDE), "bc": (SIDE,), "d": (SIDE, HIDDEN + 1, SIDE)}
_ENDS = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()]).tolist()
_SIZE = _ENDS[-1]

_AROUND = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])
#: The last classes, of at most so many rows each in a batch, are multiplied together.
FEW = 8
#: Places of each embedding's numbers in their table.
_CELLS = np.arange((UNITS + 1) * WIDTH).reshape(-1, WIDTH)

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One beyond the place where each word begins, and its hash bucket."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = _space[raw]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # A word's polynomial hash is a difference of prefix sums, moved back to exponent 0.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_lower[raw].astype(np.uint64) + np.uint64(1)) * _powers(_MULTIPLIER, len(raw)), dtype=np.uint64)])
    hashed = (sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return start, (hashed >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def buckets(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each word of all texts, and the number of words of each text.

    Short texts are hashed together, long ones part by part.
    """
    found, counts, some, size = [], np.zeros(len(batch), np.int64), [], 0

    def together() -> None:
        start, of = _buckets(b" ".join(data for _, data in some))
        begins = np.cumsum([1, *(len(data) + 1 for _, data in some)])
        for (k, _), n in zip(some, np.diff(np.searchsorted(start, begins)).tolist()):
            counts[k] += n
        found.append(of)
        some.clear()

    for k, t in enumerate(batch.to_pylist()):
        for data in byte_parts(t or "", PART):
            some.append((k, data))
            size += len(data)
            if size >= PART:
                together()
                size = 0
    if some:
        together()
    return np.concatenate([np.zeros(0, np.int32), *found]), counts


def packed(ids: np.ndarray) -> bytes:
    """Three bytes for each bucket."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, :3] = raw
    return out.view("<i4").ravel()


def lines(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids in a line, with WINDOW times UNITS before, between and after documents, and the place of each word in it."""
    place = np.arange(len(ids)) + WINDOW * (1 + np.repeat(np.arange(len(counts)), counts))
    line = np.full(len(ids) + WINDOW * (len(counts) + 1), UNITS, np.int16)
    line[place] = ids
    return line, place


def contexts(line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(places, 2 * WINDOW) ids on both sides of ``place``, UNITS beyond a document's ends."""
    return line.take(place[:, None] + _AROUND).astype(np.int64)


class Network:
    """The window network over a flat vector of parameters."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        for (name, shape), at, to in zip(_SHAPES.items(), [0, *_ENDS], _ENDS):
            setattr(self, name, flat[at:to].reshape(shape))
        self.wd, self.bd = self.d[:, :HIDDEN], self.d[:, HIDDEN]

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Network:
        """Small random weights; biases at the logarithms of the units' frequencies."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(_SIZE, np.float32))
        for name, scale in (("e", 0.3), ("w", 0.15), ("wc", 0.1), ("wd", 0.1)):
            part = getattr(net, name)
            part[...] = rng.normal(0, scale, part.shape)
        of = (counts + 0.5).reshape(SIDE, SIDE)
        net.bc[...] = np.log(of.sum(axis=1) / of.sum())
        net.bd[...] = np.log(of / of.sum(axis=1, keepdims=True))
        return net

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.e.take(ctx.ravel(), axis=0).reshape(len(ctx), -1)
        z = x @ self.w
        z += self.b
        return x, np.tanh(z, out=z)

    @staticmethod
    def _exp(z: np.ndarray) -> np.ndarray:
        """Each row's softmax, in the place of ``z`` and short of its division by the sums; returns the sums."""
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], z.dtype)

    @staticmethod
    def _bounded(z: np.ndarray) -> np.ndarray:
        if max(z.max(initial=0), -z.min(initial=0)) > 80:  # else no exponential leaves the numbers' range
            z -= z.max(axis=1, keepdims=True)
        return z

    def _inner(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], int, int, int, np.ndarray, np.ndarray]:
        """Rows by class, those of each of the last classes (the rarest) filled up to as many with zeros.

        Returns the place of each row there; the other classes with their places; the first of the last
        classes, their rows each, and where their blocks begin; and by place h, with 1 for the bias, and the logits in the class.
        """
        order, count = np.argsort(of.astype(np.int8), kind="stable"), np.bincount(of, minlength=SIDE)
        last = int(max(np.flatnonzero(count > FEW), default=-1)) + 1
        ends = np.cumsum(count)
        base = int(ends[last - 1]) if last else 0
        spans = list(zip(range(last), [0, *ends[:last].tolist()], ends[:last].tolist()))
        few = int(count[last:].max(initial=0))
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        shift = np.zeros(SIDE, np.int64)
        shift[last:] = base + few * np.arange(SIDE - last) - (ends - count)[last:]
        place += shift[of]
        rows = np.zeros((base + few * (SIDE - last), HIDDEN + 1), h.dtype)
        rows[:, :HIDDEN][place] = h
        rows[place, HIDDEN] = 1
        z = np.empty((len(rows), SIDE), np.result_type(h, self.d))
        for c, a, b in spans:
            np.matmul(rows[a:b], self.d[c], out=z[a:b])
        np.matmul(rows[base:].reshape(SIDE - last, few, HIDDEN + 1), self.d[last:], out=z[base:].reshape(SIDE - last, few, SIDE))
        return place, spans, last, few, base, rows, z

    def log_prob(self, ids: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability given its context."""
        _, h = self.hidden(ctx)
        of, inner = ids // SIDE, ids % SIDE
        z = self._bounded(h @ self.wc + self.bc)
        out = z[np.arange(len(z)), of].astype(np.float64)
        out -= np.log(self._exp(z))
        place, *_, z = self._inner(h, of)
        out += self._bounded(z)[place, inner]
        out -= np.log(self._exp(z))[place]
        return out

    def gradient(self, ids: np.ndarray, ctx: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Of the mean negative log-probability, as a flat vector (``out``, if given)."""
        g, n = Network(np.zeros(_SIZE, np.float32) if out is None else out), len(ids)
        x, h = self.hidden(ctx)
        of, inner = ids // SIDE, ids % SIDE
        p = h @ self.wc
        p += self.bc
        ones = np.ones(n, p.dtype)
        p *= (1 / (self._exp(self._bounded(p)) * n))[:, None]
        p[np.arange(n), of] -= 1 / n
        np.matmul(h.T, p, out=g.wc)
        np.matmul(ones, p, out=g.bc)
        place, spans, last, few, base, rows, q = self._inner(h, of)
        q *= (1 / (self._exp(self._bounded(q)) * n))[:, None]
        q[place, inner] -= 1 / n
        by_place = np.empty((len(rows), HIDDEN), h.dtype)
        for c, a, b in spans:
            np.matmul(rows[a:b].T, q[a:b], out=g.d[c])
            np.matmul(q[a:b], self.wd[c].T, out=by_place[a:b])
        together = q[base:].reshape(SIDE - last, few, SIDE)  # filled-up rows are 0 in ``rows``
        np.matmul(rows[base:].reshape(SIDE - last, few, HIDDEN + 1).transpose(0, 2, 1), together, out=g.d[last:])
        np.matmul(together, self.wd[last:].transpose(0, 2, 1), out=by_place[base:].reshape(SIDE - last, few, HIDDEN))
        dh = by_place[place]
        dh += p @ self.wc.T
        dh *= 1 - h * h
        np.matmul(x.T, dh, out=g.w)
        np.matmul(ones, dh, out=g.b)
        dx = dh @ self.w.T
        g.e[...] = 0
        np.add.at(g.e.reshape(-1), _CELLS.take(ctx.ravel(), axis=0).ravel(), dx.ravel())
        return g.flat


class Adam:
    """Adaptive steps on a network's parameters, block by block."""

    def __init__(self, net: Network, rate: float = RATE):
        self.net, self.rate, self.t = net, rate, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)  # sums of gradients and of their squares that decay
        self.kept = np.empty(BLOCK, np.float32)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        even = np.sqrt(0.001 / (1 - 0.999**self.t))
        rate, least = np.float32(self.rate * 0.1 / (1 - 0.9**self.t) / even), np.float32(1e-8 / even)
        for k in range(0, len(g), BLOCK):
            of = slice(k, k + BLOCK)
            m, v, x = self.m[of], self.v[of], g[of]
            kept = self.kept[: len(x)]
            m *= np.float32(0.9)
            m += x
            v *= np.float32(0.999)
            v += np.multiply(x, x, out=kept)
            np.add(np.sqrt(v, out=kept), least, out=kept)
            np.divide(m, kept, out=kept)
            kept *= rate
            self.net.flat[of] -= kept


def deals(n: int, adam: Adam) -> Iterator[np.ndarray]:
    """The places of ``n`` words in random order, each once, in batches that grow with the steps that ``adam`` has made."""
    order, k = np.random.default_rng(n).permutation(n), 0
    while k < n:
        size = min(BATCH, FIRST_BATCH << min(adam.t // DOUBLE, 16))
        yield order[k : k + size]
        k += size


class Model:
    """The units of hash buckets, the logarithm of each bucket's share of its unit, and the network's parameters."""

    def __init__(self, unit: np.ndarray, share: np.ndarray, flat: np.ndarray):
        self.unit, self.share, self.flat = unit, share, flat

    def score(self, batch: pa.Array, by_word: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and summed log-probability of each text, of its units or of the words' buckets."""
        net, total = Network(self.flat), np.zeros(len(batch))
        found, counts = buckets(batch)
        line, place = lines(self.unit[found], counts)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        for k in range(0, len(place), 8192):
            at = slice(k, k + 8192)
            each = net.log_prob(line[place[at]].astype(np.int64), contexts(line, place[at]))
            if by_word:
                each += self.share[found[at]]
            total += np.bincount(doc[at], each, len(batch))
        return counts, total


def encoded(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id") -> DataFrame:
    """(row, mark, n, ids): each document's words as packed buckets, written once for counting and training.

    ``mark`` is a hash of id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                found, counts = buckets(piece.column("text"))
                ends = np.cumsum(counts)
                ids = pa.array([packed(found[end - n : end]) for n, end in zip(counts.tolist(), ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("mark"), pa.array(counts), ids], names=["row", "mark", "n", "ids"])

    named = [F.col(doc_id)] if doc_id in docs.columns else []
    rows = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(*named, F.xxhash64(F.col(text).cast("string"))).alias("mark"), F.monotonically_increasing_id().alias("row"))
    return cut(map_batches(rows, run, "row long, mark long, n long, ids binary"), "encoded")


def units(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit of each hash bucket, the logarithm of its share of it, and the count of each unit, over all encoded documents.

    Units are numbered by falling frequency, so that a class holds similar ones. The
    driver gets one number a bucket, ``1 << HASH_BITS`` at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << HASH_BITS, np.int64)
        for batch in batches:
            n += np.bincount(unpacked(b"".join(batch.column("ids").to_pylist())), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["f", "n"])

    counted = map_batches(words.select("ids"), count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << HASH_BITS, np.int64)
    n[counted.column("f").to_numpy()] = counted.column("n").to_numpy()
    seen = np.flatnonzero(n)
    common = seen[np.argsort(-n[seen], kind="stable")][: UNITS - RARE]
    shared = np.ones(len(n), bool)
    shared[common] = False
    of_rare = np.arange(len(n)) % RARE
    rare = np.bincount(of_rare[shared], n[shared], RARE).astype(np.int64)
    names = sorted([(n[f], 0, f) for f in common.tolist()] + [(rare[k], 1, k) for k in range(RARE)] + [(0, 2, k) for k in range(UNITS - RARE - len(common))], key=lambda x: (-x[0], x[1:]))
    unit, counts, unit_of_rare = np.zeros(len(n), np.int16), np.zeros(UNITS), np.zeros(RARE, np.int16)
    for u, (total, kind, f) in enumerate(names):
        counts[u] = total
        if kind == 0:
            unit[f] = u
        elif kind == 1:
            unit_of_rare[f] = u
    unit[shared] = unit_of_rare[of_rare[shared]]
    share = np.zeros(len(n), np.float32)
    all_ = rare + SMOOTH * np.bincount(of_rare[shared], minlength=RARE)
    share[shared] = np.log((n[shared] + SMOOTH) / all_[of_rare[shared]])
    return unit, share, counts


def _mean(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The weighted mean of one piece's copies."""
    n = table.column("n").to_numpy().astype(np.float64)
    total = np.zeros(len(table.column("x")[0].as_buffer()) // 4)
    for weight, x in zip(n, table.column("x")):
        total += weight * np.frombuffer(x.as_buffer(), np.float32)
    return pa.table({"piece": pa.array([keys[0].as_py()], pa.int32()), "part": pa.array([keys[1].as_py() // 64], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "x": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id") -> Model:
    """Counts and trains over all documents.

    A document's shard follows from its id and text (equal rows are told apart by a
    number), the number of shards from the words counted, and the order in a shard from
    the same hash, so the network doesn't depend on how ``docs`` is partitioned.
    """
    words = encoded(docs, text, doc_id)
    unit, share, counts = units(words)
    first = Network.start(counts).flat
    shards = int(min(SHARDS, max(1, -(-counts.sum() // SHARD_WORDS))))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total, held, n, shard = Network(first.copy()), 0, [], 0, None
        adam, g = Adam(net), np.zeros_like(first)

        def practise() -> None:
            line, place = lines(unit[np.concatenate(held)], np.array([len(x) for x in held]))
            for at in deals(len(place), adam):
                adam.step(net.gradient(line[place[at]].astype(np.int64), contexts(line, place[at]), g))

        for batch in batches:
            for of, x in zip(batch.column("shard").to_pylist(), batch.column("ids")):
                shard = of
                held.append(unpacked(x.as_buffer()))
                n += len(held[-1])
                if n >= ROUND:
                    practise()
                    total, held, n = total + n, [], 0
        if n:
            practise()
        total += n
        if total:
            parts = [net.flat[k : k + PIECE].tobytes() for k in range(0, _SIZE, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([shard // 64] * len(parts), pa.int32()), pa.array([total] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["piece", "part", "n", "x"])

    schema = "piece int, part int, n long, x binary"
    order = F.xxhash64("mark", "nth", F.lit("order"))
    dealt = numbered(words, "mark", "row", "nth").where("n > 0").select("ids", order.alias("at"), F.pmod(F.xxhash64("mark", "nth"), F.lit(shards)).cast("int").alias("shard"))
    pieces = map_batches(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "at"), learn, schema)
    for _ in range(3):  # 64 copies at a time: up to 64 ** 3 shards meet in tasks of 64
        pieces = pieces.groupBy("piece", "part").applyInArrow(_mean, schema)
    flat = first.copy()
    for r in cut(pieces, "network").orderBy("part").collect():
        x = np.frombuffer(r["x"], np.float32)
        flat[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] = x
    return Model(unit, share, flat)


def score(docs: DataFrame, model: Model, text: str = "text", by_word: bool = False) -> DataFrame:
    """Rows and columns of ``docs`` with n_tokens, log_prob and mean_log_prob.

    ``by_word`` gives each word its bucket's share of a shared unit's probability;
    without it a word counts as its unit.
    """
    base = docs.drop(*ADDED)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, t) for c, t in ADDED.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text, 2 << 20):
                n, total = model.score(piece.column(text), by_word)
                mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(n, pa.int64()), pa.array(total), pa.array(mean, mask=n == 0)], names=[*piece.schema.names, *ADDED])

    return map_batches(base, run, schema)
