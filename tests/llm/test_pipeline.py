"""The stages, each against a plain version on its own input."""

from __future__ import annotations

import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from kpiweave.llm import decontaminate, near_copies, pieces, secrets
from tests.llm.test_exact import plain_groups, plain_hits, plain_spans


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["languages", "near copies", "decontamination", "secrets", "pieces"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after_frame = stage(spark, docs, data)
        after = {r["doc_id"]: r for r in after_frame.collect()}
        if name == "languages":
            assert all(re.search(r"[^\W\d_]", r["text"]) for r in after.values()) and len(after) >= 0.99 * len(before)
        if name == "near copies":
            groups = plain_groups([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(after) == {i for _, i, _, c in groups if i == c}
        if name == "decontamination":
            hits = plain_hits([(i, r["text"]) for i, r in before.items()], bench)
            assert set(after) == {i for _, i, _, n, _ in hits if not n}
        if name == "secrets":
            for i, r in before.items():
                text = r["text"]
                masked = after[i]["text"]
                assert (masked == text) == (not plain_spans(text)) and not plain_spans(masked)
                assert after[i]["n_chars"] == (len(masked) if masked != text else r["n_chars"])
        if name == "pieces":
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(after[i]["ids"] == sp.encode(r["text"]) and after[i]["n_tokens"] == len(after[i]["ids"]) for i, r in before.items())
        else:
            assert after_frame.columns == docs.columns
        kept[name] = len(after)
        docs = after_frame
    assert corpus_pipeline.run(spark, data).count() == kept["pieces"]
    assert decontaminate.SPAN == 10


@pytest.mark.parametrize("names", [["de", "en", "es", "fr"], ["en", "fr"], ["de", "en", "es"]])
def test_short_texts_in_several_languages_stay(spark, data, names):
    docs = spark.read.parquet(f"{data}/documents.parquet").where(F.col("lang").isin(names))
    short = ["A.", "Re.", "De.", "e", "漢字 かな", "α", "xqzj kvwp zzqk jjxv qpwz", "Это русский текст о погоде", "1 2.", None]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(short)], "doc_id bigint, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    after = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, both, data).select("doc_id").collect()}
    lettered = {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert after == lettered | {-1, -2, -3, -4}


def test_stages_on_odd_rows(spark, odd_docs, data):
    docs = odd_docs.withColumnRenamed("words", "source").selectExpr("doc_id", "text", "lang", "source", "10 as n_chars", "key", "score")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() >= 0
        assert stage(spark, docs.where("false"), data).count() == 0


def test_one_python_worker_a_task(spark, data):
    """Idle workers keep their memory, so a task of the last two stages starts one, not two."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for stage in (corpus_pipeline.mask_secrets, corpus_pipeline.encode_pieces):
        plan = stage(spark, docs, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_one_pass_like_two(odd_docs):
    key = "password = 'abcdefgh12' token: zyxwvu9876 "
    docs = odd_docs.withColumn("text", F.when(F.col("key") % 2 == 0, F.concat(F.lit("é "), F.lit(key), "text", F.lit(key))).otherwise(F.col("text")))
    rows = lambda df: sorted(map(str, df.collect()))
    found = secrets.find_secrets(docs, spans="spans")
    two = found.select("doc_id", secrets.masked(F.col("text"), F.col("spans")).alias("text"), (F.size("spans") > 0).alias("changed"))
    one = secrets.mask_secrets(docs).select("doc_id", "text", "changed")
    assert rows(one) == rows(two) and one.where("changed").count() > 3
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.withColumn("text", F.when(F.col("key") == 3, F.lit("ﬁ ① \u2581 x\u0000")).otherwise(F.col("text")))
    decoded = pieces.decode_ids(pieces.encode_texts(docs, model), model)
    two = decoded.select("doc_id", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))
    assert rows(pieces.encode_checked(docs, model).select("doc_id", "ids", "same")) == rows(two)


def test_buckets_in_turns(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text")

    def found():
        packed = near_copies._index(docs, near_copies.Bands(80, {}), 5, 3).repartition(3, "part")
        return sorted(map(tuple, near_copies._buckets(packed).collect()))

    whole = found()
    assert whole and all(n > 1 for _, _, n in whole)
    monkeypatch.setattr(near_copies, "SORTED_ENTRIES", 1000)
    assert found() == whole
