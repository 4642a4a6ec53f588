"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that the one before it kept, and its decisions take effect.
All but the last return the columns of ``documents`` as they are, whatever else is among
them and whatever its name. Rows are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.llm import bpe, decontam, langid, linededup, simhash
from fieldbook.llm.common import apart, cut, free, named
from fieldbook.llm.queries import public_vocabulary


def language(spark, docs, sf_dir):
    """Documents in no language of the corpus go.

    The trees of the languages are learned from the labelled documents. A document goes if
    its text is null or has no letter, or if its shortest code is clearly longer than one
    that looks at no context (``langid.recognised``); without any label, only the former.
    Texts are read whole; repeated rows stay or go together; an empty table stays empty.
    """
    return langid.recognised(docs, langid.fit(docs, "doc_id", "text", "lang"), "text")


def line_dedup(spark, docs, sf_dir):
    """Lines that ten documents share go from all of them; every document stays.

    A null text stays null; one whose lines all go becomes empty. n_chars, where there is
    one, is counted anew. Repeated rows are documents of their own.
    """
    left = linededup.with_kept_lines(docs, "doc_id", "text", added=tuple(free(docs, *linededup.ADDED)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select([named(c) for c in docs.columns])


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: the one with the least id.

    Links are those of op2: 3-word shingles, at most 3 of 64 bits apart. Null, empty and
    blank texts are one group; of rows that repeat an id and text one stays.
    """
    return simhash.deduplicate(docs, "doc_id", "text")


def decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go.

    A null or empty text has no words and stays. Rows of equal text stay or go together, so
    they are matched by the SHA-256 of their texts, whatever their ids or other columns.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    value, digest = F.unhex(F.sha2("text", 256)), free(docs, "digest")[0]
    texts = docs.select(value.alias("digest"), "text").filter(F.length("text") > 0)
    found = decontam.contaminated_words(texts, items, "digest", "text", "item_id", "text")
    hit = cut(found.filter(F.size("hits") > 0).select(F.col("id").alias(digest)).distinct(), "contaminated")
    may, clear = apart(docs.withColumn(digest, value), hit, [digest])
    return may.join(hit, digest, "left_anti").unionByName(clear).select([named(c) for c in docs.columns])


def tokens(spark, docs, sf_dir):
    """The token counts and digests of what is left: a row for each document, repeated ones
    and empty texts too; a null text counts as empty."""
    return bpe.token_digests(docs, public_vocabulary(), "doc_id", "text")


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", tokens),
]
#: Fingerprints, PPM and BPE are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage. Each stage's output is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{k}")
    return docs
