"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of the training texts: one row per segment of about
``SEGMENT_WORDS`` words of whole documents, with the positions of every term in it. A segment
answers a query alone, so postings never move, and the index can be searched again with other
items. ``search`` takes every window of an item: in each segment its terms are ordered by
their number of postings, the rarest term's list, less the term's offset, gives the starts,
and each further list, shifted the same way, is intersected until the whole phrase is left.

Proximity matches are windows whose words occur in their order with at most ``slop`` other
words among them. They too start at the rarest term: from each of its postings the nearest
postings of the following and of the preceding words are taken, which gives the shortest
match around it. Matches that hold another match of the same window are left out.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z become lower case. A null text has
none, and an item without words has no window; one of fewer than ``WINDOW`` words is one
window. Items are searched in pieces of at most ``PIECE_WORDS`` windows, so none is too long;
pieces are broadcast in blocks of about ``BLOCK_BYTES`` bytes of text at most, each block
one pass over the stored index. A block takes some ten times its text in the driver's memory.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import cut, drop, map_arrow

WINDOW = 10
SLOP = 2
SEGMENT_WORDS = 1 << 19
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 4096
_CANDIDATES = 1 << 20
_SLICE = 1 << 20
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def _word_slices(text: bytes):
    """The words of a text, in lists of bounded size."""
    plain, at = text.translate(_LETTERS), 0
    while at < len(plain):
        end = plain.find(b" ", at + _SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The segments of an index over whole texts: ids, numbers of words, terms and postings.

    ``n`` is each term's number of postings. Positions count all words of a segment, are
    stored term by term, and each as its difference from the one before.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def segment(ids: list, counts: list[int], parts: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        term = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        position = np.argsort(term, kind="stable").astype(np.int32)
        held = [pa.concat_arrays(ids), pa.array(counts, pa.int32()), pa.array(names, pa.binary()), pa.array(np.bincount(term, minlength=len(names)).astype(np.int32))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held]
        steps = np.diff(position, prepend=np.int32(0)).astype(np.int32)
        columns = [pa.array([uuid.uuid4().hex]), *lists, pa.array([steps.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["segment", "ids", "n_words", "terms", "n", "positions"])

    def run(batches):
        number: dict[bytes, int] = {}
        ids, counts, parts, size = [], [], [], 0
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                n = 0
                for some in _word_slices(text.as_py() or b""):
                    for w in set(some):
                        if w not in number:
                            number[w] = len(number)
                    parts.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
                    n += len(some)
                ids.append(batch.column(0).slice(k, 1))
                counts.append(n)
                size += n
                if size >= SEGMENT_WORDS:
                    yield segment(ids, counts, parts, list(number))
                    number, ids, counts, parts, size = {}, [], [], [], 0
        if ids:
            yield segment(ids, counts, parts, list(number))

    return map_arrow(rows, run, f"segment string, ids array<{kind}>, n_words array<int>, terms array<binary>, n array<int>, positions binary")


class Windows:
    """The distinct windows of a block of items, by length, as places in one array of terms."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        self.number: dict[bytes, int] = {}
        names: dict[str, int] = {}
        texts = [np.fromiter((self.number.setdefault(w, len(self.number)) for w in words(text)), np.int32) for _, text in items]
        owner = [names.setdefault(i, len(names)) for i, _ in items]
        self.items = list(names)
        self.flat = np.concatenate([np.zeros(0, np.int32), *texts])
        first = np.cumsum([0, *map(len, texts)])
        #: length, where each distinct window begins in ``flat``, and its items as a range of a list
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(width, len(t)) for t in texts if len(t)}):
            at = [np.arange(first[k], first[k + 1] - length + 1) for k, t in enumerate(texts) if min(width, len(t)) == length]
            own = np.repeat([owner[k] for k, t in enumerate(texts) if min(width, len(t)) == length], [len(x) for x in at])
            at = np.concatenate(at)
            rows = np.ascontiguousarray(self.flat[at[:, None] + np.arange(length)]).view(np.dtype((np.void, 4 * length))).ravel()
            _, one, which = np.unique(rows, return_index=True, return_inverse=True)
            pairs = np.unique(which.ravel().astype(np.int64) * len(self.items) + own)
            bounds = np.searchsorted(pairs, np.arange(len(one) + 1) * len(self.items))
            self.by_length.append((length, at[one], bounds, (pairs % len(self.items)).astype(np.int32)))


class Postings:
    """A segment's postings of a block's terms, as sorted numbers: term first, then position."""

    def __init__(self, terms: list[bytes], n: np.ndarray, positions: bytes, total: int, block: Windows):
        position = np.cumsum(np.frombuffer(positions, np.int32), dtype=np.int64)
        bounds = np.r_[0, np.cumsum(n)]
        here = sorted((t, k) for k, name in enumerate(terms) if (t := block.number.get(name)) is not None)
        self.width = total + 1
        self.size = np.zeros(len(block.number), np.int64)
        for t, k in here:
            self.size[t] = n[k]
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        lists = [position[bounds[k] : bounds[k + 1]] for _, k in here]
        self.key = np.concatenate([np.zeros(0, np.int64), *lists]) + np.repeat(np.arange(len(self.size)), self.size) * self.width

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of the postings of the term of each row."""
        n = self.size[term]
        row = np.repeat(np.arange(len(term)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term], n)
        return row, self.key[at] - term[row] * self.width

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term * self.width + position
        at = np.searchsorted(self.key, want)
        return (at < self.end[term]) & (self.key[np.minimum(at, len(self.key) - 1)] == want)

    def after(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The term's next position behind each; -1 where there is none."""
        at = np.searchsorted(self.key, term * self.width + position, "right")
        return np.where(at < self.end[term], self.key[np.minimum(at, len(self.key) - 1)] - term * self.width, -1)

    def before(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, term * self.width + position) - 1
        return np.where(at >= self.start[term], self.key[np.maximum(at, 0)] - term * self.width, -1)


def _candidates(postings: Postings, flat: np.ndarray, at: np.ndarray, length: int):
    """Blocks of (windows that may occur, their terms, the rank of each by rarity) of bounded size."""
    gone = np.r_[0, np.cumsum(postings.size[flat] == 0)]
    alive = np.flatnonzero(gone[at + length] == gone[at])
    if not len(alive):
        return
    rarest = np.full(len(alive), np.iinfo(np.int64).max)
    for k in range(length):
        rarest = np.minimum(rarest, postings.size[flat[at[alive] + k]])
    block = np.cumsum(rarest) // _CANDIDATES
    for part in np.split(alive, np.flatnonzero(np.diff(block)) + 1):
        terms = flat[at[part][:, None] + np.arange(length)].astype(np.int64)
        yield part, terms, np.argsort(postings.size[terms], axis=1, kind="stable")


def _phrases(postings: Postings, flat: np.ndarray, at: np.ndarray, length: int, doc_of: np.ndarray):
    """(window, start) of every exact occurrence within one document."""
    for part, terms, rank in _candidates(postings, flat, at, length):
        rows = np.arange(len(part))
        which, start = postings.of(terms[rows, rank[:, 0]])
        start = start - rank[which, 0]
        fits = (start >= 0) & (start + length <= len(doc_of))
        which, start = which[fits], start[fits]
        for k in range(1, length):
            offset = rank[which, k]
            hit = postings.holds(terms[which, offset], start + offset)
            which, start = which[hit], start[hit]
        same = doc_of[start] == doc_of[start + length - 1]
        yield part[which[same]], start[same]


def _near(postings: Postings, flat: np.ndarray, at: np.ndarray, length: int, doc_of: np.ndarray, slop: int):
    """(window, start, span) of the shortest matches, in order, with at most ``slop`` other words."""
    for part, terms, rank in _candidates(postings, flat, at, length):
        anchor = rank[:, 0]
        which, place = postings.of(terms[np.arange(len(part)), anchor])
        start, end, gaps = place.copy(), place.copy(), np.zeros(len(place), np.int64)
        for step in range(1, length):
            for forward in (True, False):
                offset = anchor[which] + (step if forward else -step)
                rows = np.flatnonzero((offset >= 0) & (offset < length))
                term = terms[which[rows], offset[rows]]
                if forward:
                    met = postings.after(term, end[rows])
                    gap, end[rows] = met - end[rows] - 1, met
                else:
                    met = postings.before(term, start[rows])
                    gap, start[rows] = start[rows] - met - 1, met
                gaps[rows] += np.where(met < 0, slop + 1, gap)
                left = gaps <= slop
                which, start, end, gaps = which[left], start[left], end[left], gaps[left]
        same = doc_of[start] == doc_of[end]
        which, start, end = which[same], start[same], end[same]
        # Of the matches of a window, from the last start on: those that end before all others so far.
        order = np.lexsort((end, -start, -which))
        which, start, end = which[order], start[order], end[order]
        least = np.minimum.accumulate(np.r_[np.iinfo(np.int64).max, which * (len(doc_of) + 1) + end])[:-1]
        shortest = which * (len(doc_of) + 1) + end < least
        yield part[which[shortest]], start[shortest], (end - start + 1)[shortest]


def _open(row: dict, block: Windows):
    """The documents' bounds in a segment, the document at each position, and the block's postings."""
    counts = np.array(row["n_words"], np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return counts, ends, np.repeat(np.arange(len(counts)), counts), Postings(row["terms"], np.array(row["n"], np.int64), row["positions"], total, block)


def pieces(items: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(id, text) of the items in pieces that hold all their windows. Ids are text from here on."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null and id is not null")

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words(text.as_py())
                for at in range(0, max(1, len(own) - width + 1), PIECE_WORDS):
                    ids.append(i)
                    texts.append(b" ".join(own[at : at + PIECE_WORDS + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["id", "text"])

    return map_arrow(rows, run, "id string, text binary").filter(F.octet_length("text") > 0).distinct()


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int):
    """The pieces of the items in lists that may be broadcast."""
    kept = cut(pieces(items, id_col, text_col, width), "items")
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    for part in range(parts):
        some = kept.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield [(r[0], bytes(r[1])) for r in some.select("id", "text").collect()]
    drop(kept)


def matches(index: DataFrame, items: list[tuple[str, bytes]], slop: int = 0, width: int = WINDOW) -> DataFrame:
    """(id, item_id, kind, start, span): exact ("phrase") and, with slop, "proximity" matches.

    start is a word's number in its document. A proximity match holds no other match of
    its window, exact or not.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(Windows(items, width))

    def run(batches):
        block = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                counts, ends, doc_of, postings = _open(row, block)
                starts, out = ends - counts, []
                for length, at, bounds, owners in block.by_length:
                    found = [(w, s, np.full(len(s), length)) for w, s in _phrases(postings, block.flat, at, length, doc_of)]
                    if slop:
                        found += [(w[span > length], s[span > length], span[span > length]) for w, s, span in _near(postings, block.flat, at, length, doc_of, slop)]
                    for w, s, span in ((w, s, span) for ws, ss, spans in found for w, s, span in zip(ws.tolist(), ss.tolist(), spans.tolist())):
                        d = doc_of[s]
                        out += [(row["ids"][d], block.items[i], "phrase" if span == length else "proximity", int(s - starts[d]), span) for i in owners[bounds[w] : bounds[w + 1]]]
                columns = list(zip(*out)) or [()] * 5
                types = [batch.schema.field("ids").type.value_type, pa.string(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "item_id", "kind", "start", "span"])

    return map_arrow(index.select("ids", "n_words", "terms", "n", "positions"), run, f"id {kind}, item_id string, kind string, start long, span int")


def _names(block: Windows, pairs: list[np.ndarray], documents: int) -> pa.Array:
    """The sorted ids of the items of each document, from (document, item) numbers."""
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
    n = max(1, len(block.items))
    bounds = np.searchsorted(pairs, np.arange(documents + 1) * n)
    return pa.array([sorted(block.items[i] for i in pairs[a:b] % n) for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.string()))


def _hits(index: DataFrame, items: list[tuple[str, bytes]], width: int, slop: int) -> DataFrame:
    """(segment, ordinal, id, n_words, hits, items, near) of every indexed row.

    hits are its hit words as runs: start, end, start, end, ...; items those that occur,
    near those with an exact or a proximity match.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(Windows(items, width))

    def run(batches):
        block = shared.value

        def owned(which: np.ndarray, start: np.ndarray, bounds: np.ndarray, owners: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
            """The (document, item) numbers of these matches."""
            met = np.unique(doc_of[start] * np.int64(len(bounds)) + which)
            doc, which = met // len(bounds), met % len(bounds)
            n = bounds[which + 1] - bounds[which]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[which], n)
            return np.repeat(doc, n) * len(block.items) + owners[at]

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("segment", "n_words", "terms", "n", "positions")}
                counts, ends, doc_of, postings = _open(row, block)
                edge = np.zeros(len(doc_of) + 1, np.int32)
                exact, near = [], []
                for length, at, bounds, owners in block.by_length:
                    for which, start in _phrases(postings, block.flat, at, length, doc_of):
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + length, -1)
                        exact.append(owned(which, start, bounds, owners, doc_of))
                    for which, start, _ in _near(postings, block.flat, at, length, doc_of, slop) if slop else ():
                        near.append(owned(which, start, bounds, owners, doc_of))
                hit = np.cumsum(edge[:-1]) > 0
                runs: list[list[int]] = [[] for _ in counts]
                for d in set(doc_of[np.flatnonzero(hit)].tolist()):
                    own = hit[ends[d] - counts[d] : ends[d]]
                    runs[d] = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).tolist()
                columns = [pa.array([row["segment"]] * len(counts)), pa.array(range(len(counts)), pa.int32()), batch.column("ids")[k].values, pa.array(counts, pa.int64())]
                columns += [pa.array(runs, pa.list_(pa.int64())), _names(block, exact, len(counts)), _names(block, exact + near, len(counts))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "id", "n_words", "hits", "items", "near"])

    rows = index.select("segment", "ids", "n_words", "terms", "n", "positions")
    return map_arrow(rows, run, f"segment string, ordinal int, id {kind}, n_words long, hits array<long>, items array<string>, near array<string>")


def _merged(parts: DataFrame) -> DataFrame:
    """One row per document from those of several blocks: runs and items are united."""
    united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")]
    grouped = parts.groupBy("segment", "ordinal").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), *united)

    def run(batches):
        for batch in batches:
            out = []
            for lists in batch.column("hits").to_pylist():
                runs: list[list[int]] = []
                for a, b in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                out.append([x for r in runs for x in r])
            yield batch.set_column(batch.schema.get_field_index("hits"), "hits", pa.array(out, pa.list_(pa.int64())))

    return map_arrow(grouped, run, parts.schema)


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = 0) -> DataFrame:
    """(segment, ordinal, id, n_words, hits, items, near) of every row of a stored index."""
    found, n = None, 0
    for block in _blocks(items, item_id, item_text, width):
        one = _hits(index, block, width, slop)
        if n:
            found = (cut(found, "hits") if n == 1 else found).unionByName(cut(one, "hits"))
        else:
            found = one
        n += 1
    return found if n == 1 else _merged(found)


def contaminated_words(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = 0) -> DataFrame:
    """(segment, ordinal, id, n_words, hits, items, near) of every row of ``docs``."""
    return search(cut(build_index(docs, id_col, text_col), "index"), items, item_id, item_text, width, slop)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) of every row of ``docs``.

    n_hit counts the words inside any occurrence of a window of any item; items_sha256 is
    of the ids, as text, sorted and joined by commas, of the n_items that occur. n_near_items
    counts the items with an exact or a proximity match; the other columns are of exact ones.

    A null or empty text has no words and is clean. Items with a null id or text are none;
    items that share an id count once. Rows that repeat an id, a null one too, each give
    their own row. Whole texts and items are read, whatever their length. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    found = contaminated_words(docs, items, id_col, text_col, item_id, item_text, width, slop)
    n_hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
    )


def _near_steps() -> str:
    """DuckDB SQL that walks from each first word to the nearest next ones, ``SLOP`` other words at most in all."""
    steps = ["s1 AS (SELECT nw.*, p.doc_id, p.pos AS start, p.pos AS cur FROM nw JOIN p ON p.word = nw.w[1])"]
    for k in range(2, WINDOW + 1):
        steps.append(
            f"s{k} AS (SELECT s.* REPLACE (p.pos AS cur) FROM s{k - 1} s ASOF JOIN p ON p.doc_id = s.doc_id AND p.word = s.w[{k}] AND s.cur < p.pos"
            f" WHERE s.n >= {k} AND p.pos - s.start + 1 <= {k + SLOP} UNION ALL SELECT * FROM s{k - 1} WHERE n < {k})"
        )
    return ",\n".join(steps)


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
       FROM (SELECT d.*, l.n, unnest(range(1, len(w) - l.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= l.n)),
hit AS (SELECT dw.doc_id, dw.n, dw.k, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
nw AS (SELECT item_id, n, string_split(phrase, ' ') AS w FROM bw),
{_near_steps()},
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM s{WINDOW} GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nears USING (doc_id)"""
