"""The pipeline's rows against its stages in plain Python, over whole tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldbook.llm import langid
from fieldbook.llm.common import cut
from tests.llm.test_decontam import plain as contaminated
from tests.llm.test_linededup import keyed
from tests.llm.test_simhash import components, plain_fingerprint


def plain_rows(rows, items, model):
    from collections import Counter

    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    held = Counter(k for _, t in rows for k in set(keyed(t)) if k)
    rows = [(i, "\n".join(x for x, k in zip(t.split("\n"), keyed(t)) if not k or held[k] < 10)) for i, t in rows]
    root = components([plain_fingerprint(t) for _, t in rows])
    first = {}
    for (i, _), r in zip(rows, root):
        first[r] = min(i, first.get(r, i))
    rows = [(i, t) for (i, t), r in zip(rows, root) if first[r] == i]
    rows = [(i, t) for i, t in rows if not contaminated(t, items)[4]]
    out = []
    for i, t in rows:
        ids = model.encode(t, add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_against_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = plain_rows([(r.doc_id, r.text) for r in docs.collect()], items, model)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want
    assert len(got) < docs.count()


def test_stages_keep_the_columns_and_take_hard_cases(spark, sf, docs, no_docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split()[0] for n in names] == ["language", "line", "SimHash", "benchmark", "BPE"]
    whole = {(r.doc_id, r.source, r.key): r.asDict() for r in docs.collect()}
    changed = {"text", "n_chars"}
    for start in (docs, no_docs):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = cut(stage(spark, rows, sf), "stage")
            assert rows.columns == start.columns and rows.dtypes == start.dtypes
            found = [r.asDict() for r in rows.collect()]
            assert start is no_docs or len(found) > 10
            for r in found:
                before = whole[r["doc_id"], r["source"], r["key"]]
                assert {k: v for k, v in r.items() if k not in changed} == {k: v for k, v in before.items() if k not in changed}, name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, sf).count() == rows.count()


def test_repeated_rows_leave_a_defined_one(spark):
    rows = [(1, "some words here", s, k) for k, s in enumerate("zyxw")] + [(2, "other text of its own", "v", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key long")
    got = [{tuple(r) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n).orderBy(F.desc("source") if n % 2 else "source"), "").collect()} for n in (1, 2)]
    assert len(got[0]) == 2 and got[0] == got[1] and got[0] <= set(rows)


def test_rejected_languages(spark, sf, docs):
    noise = "".join(chr(97 + (k * k * 7 + k * 3 + (k >> 3) * 11) * 2654435761 % 2**32 % 26) for k in range(600))
    more = spark.createDataFrame([(900, noise), (901, "Ωμέγα και άλφα και βήτα"), (902, "zzzz")], "doc_id long, text string")
    real = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.language(spark, docs.unionByName(more, allowMissingColumns=True).unionByName(real, allowMissingColumns=True), sf).collect()}
    assert (4, "word") in kept and not {(0, None), (1, ""), (3, "12 34 !!"), (900, noise)} & kept
    assert not {i for i, _ in kept} & {900, 901}
    assert {(r.doc_id, r.text) for r in real.collect()} <= kept
    assert langid.UNKNOWN == "und"


def test_a_corpus_without_labels_is_kept(spark, sf, docs):
    want = sorted((r.doc_id or -1, r.text) for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect())
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.language(spark, bare, sf).collect())
    assert got == want and len(got) > 20


def test_a_language_of_long_rows_is_learned(spark):
    rows = [(i, "the cat and the dog " * 5000, "en") for i in range(10)] + [(20 + i, "der hund und die katze " * 9, "de") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    assert {(r.lang, r.lang_pred) for r in langid.identify(docs, model).collect()} == {("de", "de"), ("en", "en")}
