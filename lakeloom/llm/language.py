"""Language identification of spans: script ranges, per-word scores, Viterbi.

Words are runs of letters. The script of a word's first letter narrows the languages
to those that use it; each remaining language scores the word by the log-probabilities
of its hashed three- and four-character n-grams (word ends included); and Viterbi,
with a penalty for each change of language, labels the words. Runs of one label are
spans; the document's language is that of most letters.

Training counts n-grams and scripts by language over all given documents, in the
tasks that read them; only the counts are shuffled, and a table of languages by
``BUCKETS`` reaches the driver.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and no
spans; a very long text is cut beside a letter into parts for its n-grams, not for
Viterbi; a script that no learned language uses leaves all languages as candidates;
null languages teach nothing; without any learned language all is ``und``; repeated
rows are labelled each; columns of ``docs`` that clash with the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import map_batches, slices, texts

BUCKETS = 1 << 16
SWITCH = 10.0
#: Bytes of text whose n-grams are in memory at a time.
PART = 1 << 20
#: Languages whose counts a task holds at a time.
HELD = 64
#: Least share of a language's letters for a script to be one of its own.
LEAST_SHARE = 0.01
UNKNOWN = "und"
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
ADDED = {"lang_pred": T.StringType(), "score": T.DoubleType(), "spans": SPAN}

#: First and last code points of the blocks of scripts; others are script 0.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x1000, 0x109F, "Myanmar"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"), (0x1200, 0x137F, "Ethiopic"),
    (0x1780, 0x17FF, "Khmer"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
)
N_SCRIPTS = len({name for *_, name in SCRIPTS}) + 1

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its script's number."""
    if not _tables:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        names = sorted({name for *_, name in SCRIPTS})
        for first, last, name in SCRIPTS:
            script[first : last + 1] = names.index(name) + 1
        _tables.extend((letter, script))
    return _tables[0], _tables[1]


@dataclass
class Words:
    """The words of a batch of texts, and their n-grams."""

    start: np.ndarray  # place in all characters
    end: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    gram: np.ndarray  # hashed n-grams
    word: np.ndarray  # the word of each


def words(batch: list[str]) -> tuple[Words, np.ndarray]:
    """Words of all texts joined, and the place where each text begins."""
    letter, script = tables()
    low = [x if len(x := t.lower()) == len(t) else t for t in batch]  # places must stay those of the text
    chars = np.frombuffer(("\n" + "\n\n".join(low) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([1, *(len(t) + 2 for t in low)])[:-1]
    is_letter = letter[chars]
    start = np.flatnonzero(is_letter[1:] & ~is_letter[:-1]) + 1
    end = np.flatnonzero(~is_letter[1:] & is_letter[:-1]) + 1
    nth = np.zeros(len(chars), np.int64)
    nth[start] = 1
    nth = np.cumsum(nth) - 1
    s = np.where(is_letter, chars, 0).astype(np.uint32)
    three = np.flatnonzero(is_letter[1:-2]) + 1  # the middle letter
    pair = s[three - 1] * np.uint32(0x85EBCA6B) ^ s[three] * np.uint32(0xC2B2AE35) ^ (s[three] >> np.uint32(7))
    h3 = (pair ^ s[three + 1] * np.uint32(0x27D4EB2F)) * np.uint32(0x9E3779B1)
    four = is_letter[three + 1]
    h4 = (h3[four] ^ s[three[four] + 2] * np.uint32(0x165667B1)) * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)
    gram = (np.concatenate([h3, h4]) >> np.uint32(16)).astype(np.int64)
    word = np.concatenate([nth[three], nth[three[four]]])
    return Words(start, end, np.searchsorted(begins, start, "right") - 1, script[chars[start]], gram, word), begins


def parts(batch: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts in groups of about ``PART`` characters, long ones cut beside a letter; of each piece its text's number and its place there."""
    letter, _ = tables()
    pieces, docs, places, size = [], [], [], 0
    for d, t in enumerate(batch):
        at = 0
        while at < len(t) or not t and not at:
            end = min(len(t), at + PART)
            if end < len(t):
                back = end
                while back > at and letter[ord(t[back])] and letter[ord(t[back - 1])]:
                    back -= 1
                end = back if back > at else next((k for k in range(end, len(t)) if not letter[ord(t[k])]), len(t))
            pieces.append(t[at:end])
            docs.append(d)
            places.append(at)
            size += end - at
            at = end or 1
            if size >= PART:
                yield pieces, np.array(docs, np.int32), np.array(places, np.int32)
                pieces, docs, places, size = [], [], [], 0
    if pieces:
        yield pieces, np.array(docs, np.int32), np.array(places, np.int32)


@dataclass
class Model:
    """Languages, log-probabilities by n-gram and language, and the scripts of each."""

    languages: list[str]
    log_p: np.ndarray
    allowed: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """Of each word and language: the log-probability of the word's n-grams."""
        n = len(w.start)
        score = np.stack([np.bincount(w.word, self.log_p[w.gram, j], n) for j in range(len(self.languages))], axis=1).astype(np.float32)
        score[~self.allowed[w.script]] -= 1000.0
        return score

    def label(self, score: np.ndarray, doc: np.ndarray, n_docs: int, switch: float = SWITCH) -> np.ndarray:
        """The language number of each word: Viterbi over all documents in step."""
        n, k = score.shape
        count = np.bincount(doc, minlength=n_docs)
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        count, first = count[order], first[order]
        active = np.searchsorted(-count, -np.arange(1, (count[0] if n_docs else 0) + 1), "right")  # documents with a t-th word
        best, changed = np.zeros(n, np.int16), np.zeros((n, k), bool)
        value = np.zeros((n_docs, k))
        for t, a in enumerate(active.tolist()):
            at, v = first[:a] + t, value[:a]
            if t:
                arg = v.argmax(axis=1)
                other = v[np.arange(a), arg][:, None] - switch
                best[at], change = arg, other > v
                changed[at] = change
                v = np.where(change, other, v)
            value[:a] = v + score[at]
        now, out = value.argmax(axis=1), np.zeros(n, np.int16)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            at, cur = first[:a] + t, now[:a]
            out[at] = cur
            now[:a] = np.where(changed[at, cur], best[at], cur)
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts n-grams and scripts by language over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for name, n in seen.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "f", "n"])
            seen.clear()

        for batch in batches:
            for piece in slices(batch, "text", PART):
                langs, all_ = np.array(piece.column("lang").to_pylist()), np.array(texts(piece.column("text")), object)
                for name in np.unique(langs):
                    n = seen.setdefault(str(name), np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    for some, _, _ in parts(all_[langs == name].tolist()):
                        w, _ = words(some)
                        n[:BUCKETS] += np.bincount(w.gram, minlength=BUCKETS)
                        n[BUCKETS:] += np.bincount(w.script, w.end - w.start, N_SCRIPTS).astype(np.int64)
                    if len(seen) >= HELD:
                        yield from counted()
        yield from counted()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    found = map_batches(rows, count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    n = np.zeros((len(names), BUCKETS + N_SCRIPTS))
    n[found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), found["f"].to_numpy(int)] = found["n"].to_numpy(float)
    grams, letters = n[:, :BUCKETS] + 0.5, n[:, BUCKETS:]
    allowed = (letters >= LEAST_SHARE * letters.sum(axis=1, keepdims=True)) & (letters > 0)
    allowed |= ~allowed.any(axis=0)
    return Model(names, np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32), allowed.T)


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Rows and columns of ``docs`` with lang_pred, score (its share of all letters) and spans.

    Spans hold the places of characters in the text: start, end (after the last), lang.
    """
    base = docs.drop(*ADDED)
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, t) for c, t in ADDED.items())])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                n = piece.num_rows
                pred, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                start, end, doc, scored = [], [], [], []
                for some, of, place in parts(texts(piece.column(text))) if model.languages else ():  # n-grams take much more room than words
                    w, begins = words(some)
                    shift = place - begins
                    start.append((w.start + shift[w.doc]).astype(np.int32))
                    end.append((w.end + shift[w.doc]).astype(np.int32))
                    doc.append(of[w.doc])
                    scored.append(model.scores(w))
                if sum(map(len, start)):
                    first, after, of = map(np.concatenate, (start, end, doc))
                    label = model.label(np.concatenate(scored), of, n, switch)
                    letters = np.bincount(of.astype(np.int64) * len(model.languages) + label, after - first, n * len(model.languages)).reshape(n, -1)
                    total = letters.sum(axis=1)
                    for d in np.flatnonzero(total):
                        pred[d] = model.languages[int(letters[d].argmax())]
                    score = np.divide(letters.max(axis=1), total, out=score, where=total > 0)
                    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (label[1:] != label[:-1])]))
                    last = np.append(new[1:], len(label)) - 1
                    for d, a, b, k in zip(of[new].tolist(), first[new].tolist(), after[last].tolist(), label[new].tolist()):
                        spans[d].append({"start": a, "end": b, "lang": model.languages[k]})
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(spans, span)], names=[*piece.schema.names, *ADDED])

    return map_batches(base, run, schema)
