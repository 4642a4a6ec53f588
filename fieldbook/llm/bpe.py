"""Byte-level BPE encoding and decoding by tree concatenation.

The vocabulary file's own merge model encodes leaves: words that the split pattern cuts
out, and pieces of at most ``LEAF`` bytes of a longer unsplit run. The halves of such a run
are encoded apart and joined: the last w tokens of the left and the first w of the right
are decoded, encoded as one, and accepted if the outermost tokens come out as they were
on both sides; otherwise w doubles, up to the whole halves. An encoding is right where
every adjacent pair of tokens is, so a join that agrees is the encoding of the whole.

A text of more than ``SEGMENT`` characters is cut into rows that any task can encode. Cuts
are made where the pattern always ends a word (after a letter or digit that another kind
of character follows, before white space); a run without such a place is cut into leaves
that are joined when its rows come together. Texts are encoded whole, and the tokens of
one text are streamed: only an unsplit run is held at once.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import cut, map_arrow

SEGMENT = 1 << 16
LEAF = 4096
AGREE = 2
_CACHED = 1 << 16
TEXT, SPECIAL, PIECE, WORDS = range(4)
_BETWEEN = b"\xff"  # not a byte of UTF-8

#: Fixed value: the split pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between these characters a word always ends. Beyond U+0557 Unicode versions differ in
#: what is a letter, so there only white space counts.
SAFE = r"(?V1)(?<=[\p{L}&&[\x00-\u0557]])(?=[\P{L}&&[\x00-\u0557]])|(?<=[\p{N}&&[\x00-\u0557]])(?=[\P{N}&&[\x00-\u0557]])|(?<=\S)(?=\s)"
LATER = r"[^\x00-\u0557]"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Whole-text encoding and decoding with one vocabulary, given as the file's text."""

    def __init__(self, vocabulary: str, leaf: int = LEAF):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model, self.leaf = self.tokenizer.model, leaf
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        self._words, self._later = regex.compile(PATTERN).findall, regex.compile(LATER).search
        self.safe = regex.compile(SAFE)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.cache: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        """What the split pattern cuts; the library's own cut where Unicode versions may differ."""
        if self._later(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self._words(text)

    def bpe(self, data: bytes) -> list[int]:
        """One word, by the merge model."""
        return [t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, data)))]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring pieces of one word, from theirs."""
        w = 2 * AGREE
        while True:
            a, b = left[-w:], right[:w]
            new = self.bpe(self.raw(a) + self.raw(b))
            if (w >= len(left) or new[:AGREE] == a[:AGREE]) and (w >= len(right) or new[-AGREE:] == b[-AGREE:]):
                return left[: max(0, len(left) - w)] + new + right[w:]
            w *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Neighbours are joined pairwise until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        if len(data) > self.leaf:
            return tuple(self.join_all([self.bpe(x) for x in self.leaves(data)]))
        found = tuple(self.bpe(data))
        if len(self.cache) >= _CACHED:
            self.cache.clear()
        self.cache[word] = found
        return found

    def leaves(self, data: bytes) -> list[bytes]:
        """Halves of halves of an unsplit run, of at most a leaf's size."""
        if len(data) <= self.leaf:
            return [data]
        half = len(data) // 2
        return self.leaves(data[:half]) + self.leaves(data[half:])

    def plain(self, text: str) -> list[int]:
        """A text in which the strings of special tokens count for nothing."""
        words = self.words(text)
        known = self.cache
        return list(chain.from_iterable([known.get(w) or self.word(w) for w in words]))

    def encode(self, text: str) -> list[int]:
        parts = self.specials(text)
        if len(parts) == 1:
            return self.plain(text)
        return list(chain.from_iterable([self.special[p]] if k % 2 else self.plain(p) for k, p in enumerate(parts)))

    def segment(self, kind: int, data: bytes) -> list[int]:
        """The tokens of one row."""
        if kind == PIECE:
            return self.bpe(data)
        if kind == SPECIAL:
            return [self.special[data.decode()]]
        if kind == WORDS:
            return list(chain.from_iterable(self.cache.get(w) or self.word(w) for w in data.decode("utf-8", "surrogateescape").split(_BETWEEN.decode("utf-8", "surrogateescape"))))
        return self.plain(data.decode())

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def segments(self, text: str, size: int):
        """(glued, kind, data): rows that give the text's tokens; a glued one is a leaf that
        continues the row before. Words that are not cut at a safe place stay apart."""
        for k, part in enumerate(self.specials(text)):
            if k % 2:
                yield False, SPECIAL, part.encode()
                continue
            at = 0
            while len(part) - at > size:
                found = self.safe.search(part, at + size)
                end = found.start() if found else len(part)
                if end - at <= size + self.leaf:
                    yield False, TEXT, part[at:end].encode()
                    at = end
                    continue
                held, length = [], 0
                for word in self.words(part[at:end]):
                    data = word.encode()
                    if held and (len(data) > self.leaf or length > size):
                        yield False, WORDS, _BETWEEN.join(held)
                        held, length = [], 0
                    if len(data) > self.leaf:
                        yield from ((j > 0, PIECE, leaf) for j, leaf in enumerate(self.leaves(data)))
                    else:
                        held.append(data)
                        length += len(word)
                if held:
                    yield False, WORDS, _BETWEEN.join(held)
                at = end
            if at < len(part):
                yield False, TEXT, part[at:].encode()


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """This process's encoder for the vocabulary; tasks share its word cache."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


class _Digest:
    """Digests of a text's tokens, fed in parts."""

    def __init__(self, own: Encoder):
        self.own, self.n, self.ids, self.text = own, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update((("," if self.n else "") + ",".join(map(self.own.digits.__getitem__, ids))).encode())
            self.text.update(self.own.raw(ids))
            self.n += len(ids)

    def row(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


class _Tokens:
    """All tokens of a text."""

    def __init__(self, own: Encoder):
        self.all: list[int] = []
        self.add = self.all.extend

    def row(self) -> tuple:
        return (self.all,)


_OUT = {_Digest: (("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")), _Tokens: (("ids", pa.list_(pa.int32()), "array<int>"),)}


def _texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def _run(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, kind: type, size: int) -> DataFrame:
    """One row of ``kind`` for every row of ``docs``, after its id."""
    spark = docs.sparkSession
    if not (fixed := len(vocabulary)) <= 1 << 26:
        raise ValueError(f"a vocabulary file of {fixed} characters is not broadcast")
    shared, out = spark.sparkContext.broadcast(vocabulary), _OUT[kind]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, " + ", ".join(f"{name} {sql}" for name, _, sql in out)

    def batch_of(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * len(out)
        return pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, (_, t, _) in zip(columns, out)]], ["id", *[name for name, _, _ in out]])

    def whole(batches):
        own = encoder(shared.value)
        for batch in batches:
            found = []
            for text in _texts(batch.column(1)):
                one = kind(own)
                one.add(own.encode(text))
                found.append(one.row())
            yield batch_of(batch.column(0), found)

    short = map_arrow(rows.filter(F.col("n") <= size).select("id", "text"), whole, schema)
    long = rows.filter(F.col("n") > size).select("id", "text")

    def split(batches):
        own = encoder(shared.value)
        for batch in batches:
            for k, text in enumerate(_texts(batch.column(1))):
                glued, kinds, data = zip(*own.segments(text, size))
                n = len(data)
                ids = pa.concat_arrays([batch.column(0).slice(k, 1)] * n)
                yield pa.RecordBatch.from_arrays([ids, pa.array([uuid.uuid4().hex] * n), pa.array(range(n), pa.int64()), pa.array(glued), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["id", "tag", "seg", "glued", "kind", "data"])

    def encode(batches):
        own = encoder(shared.value)
        for batch in batches:
            found = []
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist()):
                found.append(own.segment(kind, data))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int32()))], ["id", "tag", "seg", "glued", "ids"])

    def merge(batches):
        own = encoder(shared.value)
        tag, one, run, at = None, None, [], None
        for batch in batches:
            for k, (key, glued, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tag", "glued", "ids")))):
                if not glued and one is not None:
                    one.add(own.join_all(run))
                    run = []
                if key != tag:
                    if one is not None:
                        yield batch_of(at, [one.row()])
                    tag, one, at = key, kind(own), batch.column("id").slice(k, 1)
                run.append(ids)
        if one is not None:
            one.add(own.join_all(run))
            yield batch_of(at, [one.row()])

    # A written table: the tags of a text's rows are made once, whatever is lost later.
    segments = cut(map_arrow(long, split, f"id {id_type}, tag string, seg long, glued boolean, kind int, data binary"), "segments")
    tokens = map_arrow(segments.repartition("tag", "seg"), encode, f"id {id_type}, tag string, seg long, glued boolean, ids array<int>")
    merged = map_arrow(tokens.repartition("tag").sortWithinPartitions("tag", "seg"), merge, schema)
    return short.union(merged).withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """(id, ids) of every row; a null or empty text has no tokens."""
    return _run(docs, id_col, text_col, vocabulary, _Tokens, size)


def decode_ids(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """All columns with decoded: the text of each row's ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        own = encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    return map_arrow(rows.select(*kept), run, rows.select(*kept).schema.add("decoded", "string"))


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: of the ids in decimal,
    joined by commas, and of the text that they decode to.

    Null counts as empty. Rows that repeat an id, a null one too, each give their own row.
    Other columns are ignored; an empty table gives no rows.
    """
    return _run(docs, id_col, text_col, vocabulary, _Digest, size)
