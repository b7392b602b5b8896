"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; a document's expected number of copies
is target / source size. Its whole part is taken as it is. The fractional parts
are rounded by weighted pivotal steps: two documents exchange word mass, in a
random direction that keeps both expectations, until one of them has a whole
number of copies; so a source's words never leave its target by more than one
document. Documents are dealt by hash into leaves of about ``LEAF`` rows of one
source, however large the source; each leaf leaves one open document, and these
meet in a tree of fan-in ``FAN`` until one is left, which is rounded by its
probability. All draws come from hashes of the rows (id, source and text, and a number
among rows that agree in these), so reruns agree however rows are dealt.

Defined cases: a null text has size 0 and a document without words takes nothing;
a null source is a source of its own, last in order; repeated rows, rows that share an
id and rows without one are documents of their own, rounded apart (which of several
equal rows is taken more often isn't told); an empty table gives an empty result;
columns of ``docs`` that clash with the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import WORD, cut, map_batches, numbered, with_rank

LEAF = 2048
FAN = 256
#: Sources up to which their table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Targets of (source, source_size, n_docs): adds rank and target.

    Weights repeat over the sources in code point order, null last. The shares
    make up 100 % of all sizes; a share stops at ``most`` times its source's size
    and what is over is shared again by weight until none is above. Only sums
    reach the driver.
    """
    ranked = with_rank(sizes, [F.col("source").asc_nulls_last()], "rank")
    weighted = cut(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "weights")
    cap, level, capped_before = F.col("source_size") * most, 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        r = weighted.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == capped_before or not r["open"]:
            break
        capped_before, level = r["n"], (float(r["all"] or 0) - float(r["full"] or 0)) / r["open"]
    return weighted.withColumn("target", F.least(F.col("weight") * level, cap))


def _uniform(x: int) -> float:
    """A number in [0, 1) from a 64-bit integer (splitmix64)."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 9007199254740992.0


def pivot(p: float, w: float, q: float, v: float, u: float) -> tuple[float, float]:
    """One step between probabilities p and q of documents with w and v words.

    Keeps p * w + q * v, and both expectations over u; one of them becomes 0 or 1.
    """
    up, down = min((1 - p) * w, q * v), min(p * w, (1 - q) * v)
    if u * (up + down) < down:
        if (1 - p) * w <= q * v:
            return 1.0, min(1.0, max(0.0, q - up / v))
        return min(1.0, max(0.0, p + up / w)), 0.0
    if p * w <= (1 - q) * v:
        return 0.0, min(1.0, max(0.0, q + down / v))
    return min(1.0, max(0.0, p - down / w)), 1.0


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; sets __p to 0 or 1 for all but one row a group at most.

    The group's open row may have to wait for a later batch; it is then held
    back and put before that batch.
    """
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        groups = list(zip(batch.column("__rank").to_pylist(), batch.column("__leaf").to_pylist()))
        p, w, keys = (batch.column(c).to_pylist() for c in ("__p", "__w", "__key"))
        at, group = -1, None
        for k, of in enumerate(groups):
            if of != group:
                at, group = -1, of
            if p[k] in (0.0, 1.0):
                continue
            if at < 0:
                at = k
                continue
            p[at], p[k] = pivot(p[at], w[at], p[k], w[k], _uniform(keys[k]))
            if p[at] in (0.0, 1.0):
                at = -1 if p[k] in (0.0, 1.0) else k
        out = batch.set_column(batch.schema.get_field_index("__p"), "__p", pa.array(p, pa.float64()))
        held = out.slice(at, 1) if at >= 0 else None
        if held is not None:
            out = out.filter(pc.not_equal(pa.array(range(out.num_rows)), at))
        if out.num_rows:
            yield out
    if held is not None:
        yield held


def _rounded(rows: DataFrame, name: str) -> DataFrame:
    dealt = rows.repartition("__rank", "__leaf").sortWithinPartitions("__rank", "__leaf", "__key")
    return cut(map_batches(dealt, _round, rows.schema), name)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source", columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, with ``columns`` (all if None), size, source_size, target, copies and taken.

    ``copies`` is how often the mix repeats the document, ``taken`` its words times
    that. Only sizes and numbers of rows are rounded; the columns named are written
    once with the rows' numbers, and joined with the copies at the end.
    """
    base = docs.drop(*ADDED)
    kept = base.columns if columns is None else [c for c in columns if c not in ADDED]
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.xxhash64(F.col(text)))
    sized = cut(base.select(*dict.fromkeys([*kept, source]), size.alias("size"), mark.alias("__mark"), F.monotonically_increasing_id().alias("__row")), "sized")
    stats = cut(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    targets = cut(source_targets(stats, weights, most), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    near = F.broadcast if few else (lambda t: t)
    facts = targets.select(F.col("source").alias("__source"), F.col("rank").alias("__rank"), F.ceil(F.col("n_docs") / LEAF).alias("__leaves"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"))
    slim = numbered(sized.select("__row", "__mark", "size", F.col(source).alias("source")), "__mark", "__row", "__nth")
    rows = (
        slim.join(near(facts), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__key", F.xxhash64("__mark", "__nth"))
        .withColumn("__leaf", F.pmod(F.xxhash64("__key", F.lit("leaf")), F.col("__leaves")))
        .withColumn("__p", F.when(F.col("size") > 0, F.col("__rate") - F.floor("__rate")).otherwise(0.0))
        .select("__row", "__rank", "__leaf", "__key", F.col("size").cast("double").alias("__w"), "__p", F.floor("__rate").cast("long").alias("copies"))
    )
    dealt = _rounded(rows, "leaves")
    closed = F.col("__p").isin(0.0, 1.0)
    nodes = dealt.where(~closed).select("__rank", "__row", "__leaf", "__key", "__w", "__p", "copies")
    leaves = int(facts.agg(F.max("__leaves")).first()[0] or 0)
    decided = [dealt.where(closed)]
    while leaves > 1:
        nodes = _rounded(nodes.withColumn("__leaf", F.floor(F.col("__leaf") / FAN)), "nodes")
        decided.append(nodes.where(closed))
        nodes, leaves = nodes.where(~closed), -(-leaves // FAN)
    draw = F.pmod(F.xxhash64("__key", F.lit("last")), F.lit(1 << 53)) / float(1 << 53)
    copies = nodes.select("__row", (F.col("copies") + (draw < F.col("__p")).cast("long")).alias("copies"))
    for part in decided:
        copies = copies.unionByName(part.select("__row", (F.col("copies") + F.col("__p").cast("long")).alias("copies")))
    of = targets.select(F.col("source").alias("__source"), "source_size", "target")
    named = sized.withColumn("__of", F.col(source)).join(copies, "__row").join(near(of), F.col("__of").eqNullSafe(F.col("__source")))
    return named.withColumn("taken", F.col("size") * F.col("copies")).select(*kept, *ADDED)
