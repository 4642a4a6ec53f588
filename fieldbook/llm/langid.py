"""Language identification by prediction by partial matching (PPM) over bytes.

Every language has a variable-order context tree: the counts of the byte that followed
each context of up to ``ORDER`` bytes. A context seen T times with D different next bytes
gives a seen byte n/(T+D) and escapes with D/(T+D) (method C) to the context one byte
shorter; bytes that the longer context has seen are excluded there and the rest is
renormalised, so each context's probabilities add up to one. Below the empty context all
256 bytes are equally likely. Statistics are frozen after training, so the code length of
a text is the plain sum of its bytes' code lengths.

A tree is kept as what was seen: the code length of each (context, byte) and each context's
escape, in sorted arrays, so that a model's size is that of its languages' samples. A byte's
code lengths depend on it and the ``ORDER`` bytes before; a table of fixed size holds those
of such grams that were met before, the others are worked out.

The trees are learned from a bounded sample: at most ``ROWS`` rows a language, the first
by a hash of the id, of at most ``ROW_BYTES`` bytes each, whole, and about ``SAMPLE_BYTES`` of
all languages together, shared equally. A language whose rows are all longer is learned
from the first bytes of as many. Any number of languages can be learned. Scoring covers
all bytes of all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldbook.llm.common import cut, drop, free, map_arrow, named, require_free, slices

ORDER = 3
ROWS = 256
ROW_BYTES = 1 << 16
SAMPLE_BYTES = 8 << 20
MARGIN = 0.5  # bits a byte
EXCESS = 64  # bits in all
UNKNOWN = "und"
_FEW = 1 << 16  # rows of keys that may be broadcast
_BREAK = 0xFF  # not a byte of UTF-8; contexts do not reach over it
_WINDOW = 1 << 19
_TABLE = 1 << 23  # code lengths that are held, of all languages together


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def _places(within: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is in a sorted array, and whether it is there."""
    if not len(within):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(within, wanted), len(within) - 1)
    return at, within[at] == wanted


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """Each run of so many bytes as a big-endian number."""
    found = np.zeros(max(0, len(data) - length + 1), np.uint64)
    for k in range(length):
        found = found << np.uint64(8) | data[k : k + len(found)]
    return found


@dataclass
class Tree:
    """One language: for each order, its (context, byte) grams and its contexts."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """The bits of the last byte of each gram of ``ORDER`` + 1 bytes, given the others."""
        total, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(len(self.grams) - 1, -1, -1):
            gram = grams[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, seen = _places(self.grams[k], gram)
            total[left[seen]] += self.bits[k][at[seen]]
            left, gram = left[~seen], gram[~seen]
            at, known = _places(self.contexts[k], gram >> np.uint64(8))
            total[left[known]] += self.escapes[k][at[known]]
        total[left] += 8
        return total


def tree(texts: list[bytes], order: int) -> Tree:
    """The frozen tree of a language's sample."""
    data = np.frombuffer(bytes([_BREAK]).join(texts), np.uint8)
    out = Tree([], [], [], [])
    for k in range(order + 1):
        found = _grams(data, k + 1)
        broken = np.flatnonzero(data == _BREAK)
        whole = np.ones(len(found), bool)
        for back in range(k + 1):
            at = broken - back
            whole[at[(at >= 0) & (at < len(found))]] = False
        gram, n = np.unique(found[whole], return_counts=True)
        context, first = np.unique(gram >> np.uint64(8), return_index=True)
        total = np.add.reduceat(n, first) if len(n) else np.zeros(0, np.int64)
        distinct = np.diff(np.r_[first, len(gram)])
        each = np.repeat(total + distinct, distinct)
        p = n / each
        # What the shorter context gives to the bytes seen here; it has seen them all.
        shorter = below[np.searchsorted(out.grams[-1], gram & np.uint64((1 << 8 * k) - 1))] if k else np.full(len(gram), 1 / 256)
        excluded = np.add.reduceat(shorter, first) if len(n) else np.zeros(0)
        out.grams.append(gram)
        out.bits.append((-np.log2(p)).astype(np.float32))
        out.contexts.append(context)
        out.escapes.append((-np.log2(distinct / (total + distinct) / np.maximum(1 - excluded, 1e-12))).astype(np.float32))
        below = p
    return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    order: int
    plain: np.ndarray  # bits of each byte without context, over all languages together

    def __post_init__(self):
        slots = 1
        while slots * 2 * max(1, len(self.langs)) <= _TABLE:
            slots *= 2
        self._slots = slots
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def _worked_out(self, grams: np.ndarray) -> np.ndarray:
        """(grams, langs): the code lengths of grams; the break costs nothing."""
        lengths = np.stack([t.code_lengths(grams) for t in self.trees], 1).astype(np.float32)
        lengths[(grams & np.uint64(255)) == _BREAK] = 0
        return lengths

    def _lengths(self, grams: np.ndarray) -> np.ndarray:
        """The same, through the table of grams met before."""
        if self._table is None:  # no text gives this number: it ends without the break's byte
            self._table = np.full(self._slots, (1 << 64) - 2, np.uint64), np.zeros((self._slots, len(self.langs)), np.float32)
        owner, held = self._table
        slot = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (self._slots - 1)
        new = np.unique(grams[owner[slot] != grams])
        if len(new):
            into = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (self._slots - 1)
            lengths = self._worked_out(new)
            _, last = np.unique(into[::-1], return_index=True)  # one gram a slot
            last = len(into) - 1 - last
            owner[into[last]], held[into[last]] = new[last], lengths[last]
        found = held[slot]
        lost = np.flatnonzero(owner[slot] != grams)
        if len(lost):  # its slot went to another gram of these
            some, which = np.unique(grams[lost], return_inverse=True)
            found[lost] = self._worked_out(some)[which.ravel()]
        return found

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, langs): bits of every whole text."""
        data = np.frombuffer(bytes([_BREAK] * self.order) + bytes([_BREAK]).join(texts) + bytes([_BREAK]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        total = np.zeros((len(texts), len(self.langs)))
        length = len(data) - self.order
        for a in range(0, length, _WINDOW):
            n = min(_WINDOW, length - a)
            cost = self._lengths(_grams(data[a : a + n + self.order], self.order + 1))
            first, last = np.searchsorted(ends, [a, a + n - 1], "right")
            starts = np.maximum(np.r_[0, ends][first : last + 1], a) - a
            total[first : last + 1] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return total

    def plain_lengths(self, texts: list[bytes]) -> np.ndarray:
        """The bits of every whole text without context: by the bytes' frequencies, or 8 a byte."""
        sums = [np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ self.plain for t in texts]
        return np.minimum(sums, [8.0 * len(t) for t in texts])


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """The frozen trees of all languages."""
    langs = sorted(samples)
    counts = np.zeros(256)
    for texts in samples.values():
        for text in texts:
            counts += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total, distinct = counts.sum(), (counts > 0).sum()
    unseen = distinct / max(1, total + distinct) / max(1, 256 - distinct)
    share = np.where(counts > 0, counts / max(1, total + distinct), unseen)
    return Model(langs, [tree(samples[lang], order) for lang in langs], order, -np.log2(np.maximum(share, 2.0**-64)))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the labelled rows that the trees are learned from.

    They are chosen by small keys first; texts are only read for the chosen ones.
    """
    sized = F.octet_length(text_col)
    rows = docs.filter((fold(id_col) != 0) & F.col(lang_col).isNotNull() & (sized > 0))
    keys = [F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("th")]
    place = Window.partitionBy("lang").orderBy("long", "h", "th")
    first = rows.select(*keys, sized.alias("size"), (sized > ROW_BYTES).alias("long")).withColumn("r", F.row_number().over(place)).filter(F.col("r") <= ROWS).drop("r")
    first = cut(first.distinct(), "training-rows")
    share = SAMPLE_BYTES // max(1, first.select("lang").distinct().count())
    most = max(1, min(ROW_BYTES, share))
    # Windows over ROWS rows of a language at most.
    before = F.sum(F.least("size", F.lit(most))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    only_long = F.min("long").over(Window.partitionBy("lang"))
    chosen = first.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("only_long", only_long)
    chosen = cut(chosen.filter((F.col("before") < share) & (F.col("long") == F.col("only_long"))).select("lang", "h", "th"), "chosen-rows")
    drop(first)
    rows = rows.select(*keys, F.substring(F.col(text_col).cast("binary"), 1, most).alias("text"))
    wanted = F.broadcast(chosen) if chosen.count() <= _FEW else chosen
    return rows.join(wanted, ["lang", "h", "th"], "left_semi").select("lang", "text").distinct()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the sample; one without languages where nothing is labelled."""
    samples: dict[str, list[bytes]] = {}
    for row in sorted(training_rows(docs, id_col, text_col, lang_col).collect()):
        samples.setdefault(row[0], []).append(bytes(row[1]))
    return train(samples)


ADDED = {"lang_pred": "string", "score": "double", "bits_per_byte": "double", "plain_bits_per_byte": "double"}


def identify(docs: DataFrame, model: Model, text_col: str = "text", added: list[str] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score, bits_per_byte and plain_bits_per_byte.

    lang_pred has the shortest code; score is its share of 2^-bits over all languages.
    plain_bits_per_byte is what the text takes without context: by the frequencies of bytes
    in all languages together, or as equally likely bytes, whichever is less. A null text,
    one without a letter, or a model without languages gives ``und``, 0 and nulls. Whole
    texts are read. ``added`` gives the four columns other names; a name that ``docs`` has raises.
    """
    names = list(added or ADDED)
    require_free(docs, names)
    kept = docs.columns
    text = named(text_col)
    letters, data = free(docs, "letters", "bytes")
    rows = docs.select(*map(named, kept), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(letters), text.cast("binary").alias(data))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            letters = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            pred = np.full(len(texts), UNKNOWN, object)
            score, rate, plain = np.zeros(len(texts)), np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            rows = np.flatnonzero(letters) if model.langs else np.zeros(0, int)
            if len(rows):
                own = [texts[i] for i in rows]
                bits, size = model.code_lengths(own), np.array([len(t) for t in own])
                best = bits.argmin(1)
                least = bits[np.arange(len(rows)), best]
                pred[rows] = np.array(model.langs, object)[best]
                score[rows] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                rate[rows], plain[rows] = least / size, model.plain_lengths(own) / size
            extra = [pa.array(pred, pa.string()), pa.array(score), pa.array(rate, from_pandas=True), pa.array(plain, from_pandas=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *extra], [*kept, *names])

    schema = StructType(list(docs.schema))
    for name, kind in zip(names, ADDED.values()):
        schema = schema.add(name, kind)
    return map_arrow(rows, run, schema)


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, their columns as they are, whose text is in one of the model's languages.

    A text is in none if it is null or has no letter, or if its shortest code by the trees is
    longer than one without context, by more than ``MARGIN`` bits a byte and ``EXCESS`` in all:
    what precedes a byte then says nothing about it, as in random letters or in a script that
    no language of the model uses, and the text is long enough to tell (a key or a name in a
    short one is not). Where nothing could be learned no text with a letter is rejected.
    Repeated rows are treated alike.
    """
    if not model.langs:
        return docs.filter(named(text_col).rlike(r"\p{L}"))
    lang, score, rate, plain = free(docs, *ADDED)
    found = identify(docs, model, text_col, [lang, score, rate, plain])
    size = F.octet_length(named(text_col))
    excess = (F.col(rate) - F.col(plain)) * size
    return found.filter((F.col(lang) != UNKNOWN) & (excess <= F.greatest(MARGIN * size, F.lit(EXCESS)))).select([named(c) for c in docs.columns])


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, bits_per_byte) of every row; learned from the other
    fold's labels.

    A null id is in no fold: not held out and not learned from. Rows with a null language or
    text are scored, not learned from. Ties of code lengths go to the first language by name;
    repeated rows score alike; texts of any length are scored whole. Other columns are
    ignored, whatever their names. An empty table gives no rows, unlabelled tables only ``und``.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(named(id_col).alias("id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), named(text_col).alias("text"))
    return identify(rows, model, "text").select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "bits_per_byte")
