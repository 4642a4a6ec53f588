"""SimHash near-duplicates, linked through covering locality-sensitive hashing.

Fingerprints that differ in at most ``RADIUS`` = 3 bits are linked. Bit i gets the
non-zero vector m(i) in GF(2)^4; table v (any non-zero vector) hashes the bits with
<m(i), v> = 1. For any three differing bits some v is orthogonal to all their vectors, so
the pair agrees on every bit that table v looks at (Pagh, "CoveringLSH", 2016): no pair
within the radius is missed, whatever its bits. 15 tables, 32 to 35 bits each.

Equal fingerprints are one node, so groups of copies cost one row. A bucket of at most
``SPLIT`` nodes is searched in place. A larger one is split by 15 masks of the same kind
over the bits that its table left out: its buckets agree on about 48 bits, so they hold
at most 2^16 nodes however large the group is, and again no pair is missed. A bucket
gives a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import apart, connected_components, cut, drop, free, map_arrow, named

RADIUS = 3
SHINGLE_WORDS = 3
SPLIT = 512
_SEED = 42
_CHUNK = 1 << 16


def covering_masks(bits: list[int]) -> list[int]:
    """The 15 masks over these bit numbers that cover every set of three of them."""
    size = 1 << (RADIUS + 1)
    vector = {bit: 1 + k % (size - 1) for k, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, size)]


MASKS = covering_masks(list(range(64)))
#: For each table, the masks over the bits that it leaves out.
INNER_MASKS = [covering_masks([b for b in range(64) if not mask >> b & 1]) for mask in MASKS]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one UTF-8 text; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, len(shingles), _CHUNK):
        part = shingles[start : start + _CHUNK]
        hashes = np.array([digest(s, _SEED) for s in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(shingles))
    return sum(1 << int(b) for b in bits)


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp) of every row; whole texts, null like an empty one. fp is a signed long,
    th a hash of the text."""
    rows = docs.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("th"), named(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["id", "th", "fp"])

    return map_arrow(rows, run, f"id {kind}, th long, fp long")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (value, another) that span the components of distinct signed values."""
    left, links = values.view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            if near.any():
                met = left[near]
                links += [(int(at.view(np.int64)), int(x)) for x in met.view(np.int64)]
                queue += list(met)
                left = left[~near]
    return links


def _links(batches):
    """Rows come sorted by bucket (t, s, k); a bucket may go over several batches."""
    held: list[pa.RecordBatch] = []

    def search(part: pa.Table):
        if not part.num_rows:
            return None
        t, s, k, fp = (part.column(c).to_numpy() for c in ("t", "s", "k", "fp"))
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
        links = [x for a, b in zip(starts, np.r_[starts[1:], len(t)]) if b - a > 1 for x in forest(np.unique(fp[a:b]))]
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        t, s, k = (rows.column(c).to_numpy() for c in ("t", "s", "k"))
        change = np.flatnonzero((t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1]))
        if len(change):
            end = int(change[-1]) + 1
            yield search(rows.slice(0, end))
            held = rows.slice(end).combine_chunks().to_batches()
    if held:
        if (last := search(pa.Table.from_batches(held))) is not None:
            yield last


def _tables(nodes: DataFrame, masks: list[list[int]], outer: Column | None = None) -> DataFrame:
    """One row per node and mask: t is the outer table, s the inner one (0: none)."""
    if outer is None:
        rows = [F.struct(F.lit(t).alias("t"), F.lit(0).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks[0])]
        return nodes.select("fp", F.inline(F.array(*rows)))
    inner = F.array(*[F.array(*[F.lit(_signed(m | MASKS[t])) for m in part]) for t, part in enumerate(masks)])
    return nodes.select("fp", "t", F.posexplode(F.get(inner, outer)).alias("s", "mask")).select("fp", "t", (F.col("s") + 1).alias("s"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"))


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that give all their components."""
    buckets = _tables(nodes, [MASKS])
    sizes = buckets.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    sizes = cut(sizes, "buckets")
    pairs = sizes.filter("n = 2").filter(F.expr(f"bit_count(a ^ b) <= {RADIUS}")).select("a", "b")
    members = buckets.join(sizes.filter("n > 2").select("t", "k", "n"), ["t", "k"])
    members = cut(members.select("fp", "t", "s", "k", "n"), "members")
    small = members.filter(f"n <= {SPLIT}").drop("n")
    large = _tables(members.filter(f"n > {SPLIT}"), INNER_MASKS, F.col("t"))
    rows = small.unionByName(large).select("t", "s", "k", "fp")
    found = map_arrow(rows.repartition("t", "s", "k").sortWithinPartitions("t", "s", "k", "fp"), _links, "a long, b long")
    links = cut(pairs.union(found), "links")
    drop(sizes)
    drop(members)
    return links


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, component) of the fingerprints whose component has several rows of ``prints``;
    component is the least (id, th) in it."""
    nodes = cut(prints.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("least"), F.min("id").alias("least_id"), F.count("*").alias("n")), "nodes")
    links = fingerprint_links(nodes.select("fp"))
    found = connected_components(links)
    drop(links)
    roots = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = roots.groupBy("root").agg(F.min("least").alias("first"), F.min("least_id").alias("component"), F.sum("n").alias("total")).filter("total > 1")
    classes = cut(roots.select("fp", "root").join(groups, "root").select("fp", "first", "component"), "classes")
    drop(found)
    drop(nodes)
    return classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like any
    other. component_id is the least id reachable over links; rows with equal ids keep
    their own fingerprints, a null id never is a component's id unless all of it are null.
    Whole texts are read, whatever their length. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    prints = cut(with_fingerprint(docs, id_col, text_col), "prints")
    out = prints.join(_classes(prints).select("fp", "component"), "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "id").cast(kind).alias("component_id"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the
    least id (null first) stays; of rows that repeat its id and text, the one whose other
    columns hash least (maps are not looked at).

    Whole texts are read, null and blank ones like empty ones, which are linked like any
    other. All columns stay as they are, whatever their names; an empty table gives no rows.
    """
    prints = cut(with_fingerprint(docs, id_col, text_col), "prints")
    id_, th, own_id, own_th, place = free(docs, "id", "th", "own_id", "own_th", "place")
    same = F.col(id_).eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th))
    gone = prints.join(_classes(prints).select("fp", "first"), "fp").filter(~F.struct("id", "th").eqNullSafe(F.col("first")))
    gone = cut(gone.select("id", "th").distinct(), "duplicates")
    columns = [named(c) for c in docs.columns]
    rows = docs.select(*columns, named(id_col).alias(id_), F.xxhash64(named(text_col)).alias(th))
    may, clear = apart(rows, gone.toDF(id_, th), [id_, th])
    left = may.join(gone.toDF(own_id, own_th), same, "left_anti").unionByName(clear)
    again = cut(prints.groupBy("id", "th").count().filter("count > 1").select("id", "th").toDF(own_id, own_th), "repeated")
    if again.isEmpty():
        return left.select(columns)
    hashed = F.xxhash64(*[named(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    order = Window.partitionBy(id_, th).orderBy(hashed)
    once = left.join(again, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return left.join(again, same, "left_anti").select(columns).union(once.select(columns))
