"""The pipeline against a step-by-step version that shares no Spark code with it."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import langid, mixing
from tests.llm.test_operators import DOC, base_spans, documents
from tests.llm.test_similar import kept_places


def test_stages_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "redact_pii", "mix_sources", "encode_tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_equals_brute_force(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    from foliospark.llm import bpe_trie

    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.doc_id, r.lang, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    model = langid.fit(table.select("doc_id", "text", "lang"))
    scorer = langid.Scorer(model)
    rows = [(r.doc_id, r.text, p["lang_pred"], r.source) for r, p in ((r, scorer.predict([r.text])[0]) for r in table.orderBy("doc_id").collect()) if p["lang_pred"] != "und"]
    rows = [rows[k] for k in kept_places([r[1] for r in rows])[0]]

    def masked(t):
        out, at = [], 0
        for s in base_spans(t):
            kind, a, b = s.split(":")
            if int(a) >= at:
                out += [t[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        return "".join(out) + t[at:]

    rows = [(i, masked(t), lang, s) for i, t, lang, s in rows]
    df = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], DOC)
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(df, F.col("tokens"), max_epochs=corpus_pipeline.MAX_EPOCHS).collect()}
    lib = Tokenizer.from_file(bpe_trie.default_path())
    want = []
    for i, t, lang, _ in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want += [(i, lang, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * copies[i]
    assert got == sorted(want)


def test_odd_rows_pass_all_stages(spark, sf):
    texts = [None, "", "plain words of a text " * 30, "plain words of a text " * 30, "mail me@x.org now please and thanks", "123"]
    docs = documents(spark, texts).unionByName(spark.createDataFrame([(None, "text without a name", "en", None, 3)], DOC))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        if name == "near_dedup":
            assert sum(r.text == texts[2] for r in rows) == 1 and any(r.doc_id is None for r in rows)
            again = docs.unionByName(docs.select(F.lit(2).cast("long").alias("doc_id"), F.lit("other text under a known name").alias("text"), "lang", "source", "n_chars").limit(1))
            assert stage(spark, again, sf).filter("text = 'other text under a known name'").count() == 1
        if name == "redact_pii":
            assert not any(re.search("me@x", r.text) for r in rows)
    empty = documents(spark, ["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
