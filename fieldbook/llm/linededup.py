"""Duplicate lines over a corpus, in DataFrame operations only.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z in lower case; its hash
is the key's MD5. Hashes are counted per salt first, so a line that most documents share
is a few rows before it is range-partitioned by hash. There the rows are sorted by hash,
document and position, and a streaming window takes each hash's first occurrence and its
number of documents. What comes back for a document that loses lines is its keep bitmap,
compressed to runs of kept lines, never its text; the text is put together from the runs.

Only documents that may lose lines meet their bitmaps in a shuffle (``common.apart``).

Rows are documents: a repeated row counts again. A null or empty text is one empty line;
empty keys are never dropped. Rows are told apart by id and text hash, which decide
their lines; null ids are ids like others. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import apart, cut, free, named, require_free

MIN_DOCS = 10
BLANKS = " \t\n\x0b\x0c\r"
_SALTS = 16


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _hash(line: Column) -> Column:
    key = line_key(line)
    return F.when(key != "", F.md5(key))


def frequent_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h, n_docs, id, th, pos) of the hashes in at least ``min_docs`` rows of ``keys``.

    id, th and pos are those of the first occurrence.
    """
    # Read from a table, so that the lambda looks at a stored array: one pass a row.
    first_in_row = F.expr("filter(lines, (x, j) -> x.h is not null and (j = 0 or not (get(lines, j - 1).h <=> x.h)))")
    held = keys.select("id", "th", F.inline(first_in_row))
    salt = F.pmod(F.xxhash64("id", "th"), F.lit(_SALTS)).alias("salt")
    salted = held.groupBy("h", salt).agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first"))
    ranged = salted.repartitionByRange("h").sortWithinPartitions("h", "first")
    by_hash = Window.partitionBy("h")
    stream = ranged.withColumn("r", F.row_number().over(by_hash.orderBy("first"))).withColumn("n_docs", F.sum("n").over(by_hash))
    return stream.filter((F.col("r") == 1) & (F.col("n_docs") >= min_docs)).select("h", "n_docs", "first.*")


def keep_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(id, th, n_lines, keep) of the rows that lose lines.

    Lines whose key is in at least ``min_docs`` documents go: all of them, or all but the
    first occurrence with ``keep_first``. ``keep`` is the bitmap of the others, compressed
    to its runs of ones: (start, length) each, from line 0.
    """
    hashes = F.transform(text_lines(F.col(text_col)), lambda line, pos: F.struct(_hash(line).alias("h"), pos.alias("pos")))
    keys = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.array_sort(hashes).alias("lines")), "line-keys")
    frequent = cut(frequent_lines(keys, min_docs), "frequent-lines")
    lines = keys.select("id", "th", F.size("lines").alias("n_lines"), F.inline("lines"))
    hits = lines.join(frequent.select("h", *[F.col(c).alias(f"first_{c}") for c in ("id", "th", "pos")]), "h")
    if keep_first:
        hits = hits.filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")) & (F.col("pos") == F.col("first_pos"))))
    gone = hits.groupBy("id", "th", "n_lines").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    runs = """filter(transform(sequence(0, size(gone)), i -> named_struct(
        'start', if(i = 0, 0, get(gone, i - 1) + 1),
        'length', if(i = size(gone), n_lines, get(gone, i)) - if(i = 0, 0, get(gone, i - 1) + 1))), r -> r.length > 0)"""
    return gone.select("id", "th", "n_lines", F.expr(runs).alias("keep"))


ADDED = ("n_lines", "n_dropped", "keep")


def with_kept_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int = MIN_DOCS, keep_first: bool = False, added: tuple[str, ...] = ADDED) -> DataFrame:
    """All rows and columns of ``docs``, the text without the lines that go, and three more.

    ``added`` names the numbers of lines and of dropped lines and the compressed bitmap; a
    name that ``docs`` has raises. A null text stays null.
    """
    require_free(docs, added)
    bitmaps = cut(keep_bitmaps(docs, id_col, text_col, min_docs, keep_first), "bitmaps")
    id_, th, null, lines, own_id, own_th, keep = free(docs, "id", "th", "null", "lines", "own_id", "own_th", "keep")
    rows = docs.select(*map(named, docs.columns), named(id_col).alias(id_), F.xxhash64(named(text_col)).alias(th))
    losing, others = apart(rows, bitmaps.select("id", "th").toDF(id_, th), [id_, th])
    text = named(text_col)
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1))
    everything = lambda n: F.array(F.struct(F.lit(0).alias("start"), n.alias("length")))
    untouched = others.select(*map(named, docs.columns), *[x.alias(c) for x, c in zip((n_lines.cast("long"), F.lit(0).cast("long"), everything(n_lines)), added)])
    # The lines are made below the join: above it the lambda would split the text once a run.
    moved = losing.select(*[named(c) for c in docs.columns if c != text_col], id_, th, text.isNull().alias(null), text_lines(text).alias(lines))
    found = bitmaps.select("id", "th", "keep").toDF(own_id, own_th, keep)
    moved = moved.join(found, F.col(id_).eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th)), "left")
    kept = F.flatten(F.transform(keep, lambda run: F.slice(lines, run["start"] + 1, run["length"])))
    text = F.when(~F.col(null), F.array_join(F.when(F.col(keep).isNull(), F.col(lines)).otherwise(kept), "\n"))
    left = F.aggregate(keep, F.lit(0), lambda total, run: total + run["length"])
    n = F.size(lines)
    values = n.cast("long"), F.coalesce(n - left, F.lit(0)).cast("long"), F.coalesce(keep, everything(n))
    moved = moved.select(*[text.alias(c) if c == text_col else named(c) for c in docs.columns], *[x.alias(c) for x, c in zip(values, added)])
    return untouched.union(moved)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every row.

    Where all lines go, or the text is null, the digest is that of the empty text. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = with_kept_lines(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), "id", "text", min_docs)
    return rows.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id"""
