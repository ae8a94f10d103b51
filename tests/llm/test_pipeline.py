import struct

import pytest
from pyspark.sql import functions as F

from quarrylog.llm import decontaminate, jaccard_join, line_dedup, toxicity

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def kept_by_models(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.scores(spark, docs, toxicity.fit(spark, docs, labels))
    return {r.doc_id for r in scored.collect() if r.score < 0.3}


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        out[i] = (len(ids), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False))
    return out


def test_run_equals_all_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = kept_by_models(spark, docs)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(clean) > 0.8 * len(texts) and len(toxic - clean) >= 0.6 * len(toxic & set(texts))
    texts = {i: x for i, x in texts.items() if i in clean}
    texts = {i: x for i, (n, x) in line_dedup.brute_force(texts, line_dedup.MIN_WORDS).items() if not n or x.strip()}
    texts = {i: texts[i] for i, (_, c) in jaccard_join.brute_force(texts, 5, 8, 10).items() if c == i}
    texts = {i: x for i, x in texts.items() if not decontaminate.brute_force(x, bench)[1]}
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in pipeline.run(spark, SF).collect()}
    assert got == encoded(texts) and len(got) > 50


ODD = [(None, None), (None, "plain words here"), (7_000_001, ""), (7_000_002, " \t\n"), (7_000_003, "twice the same row"), (7_000_003, "twice the same row"), (7_000_004, "z" * 70_000 + " end")]
CLASHES = ["gone", "_gone", "__removed", "__d", "__t", "score", "label", "h", "component_id", "start"]


def odd(spark, rows):
    base = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    stage = dict(pipeline.STAGES)[name]
    order = lambda rows: sorted(rows, key=str)
    for rows in ([], ODD):
        docs = odd(spark, rows)
        got = stage(spark, docs, SF)
        if name == "bpe":
            want = encoded({k: t for k, (_, t) in enumerate(rows)})
            assert order((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got.collect()) == order((i, want[k][0], want[k][1]) for k, (i, _) in enumerate(rows))
        else:
            assert got.columns == docs.columns
            assert order(map(tuple, got.collect())) == order(map(tuple, docs.collect()))


def test_groups_keep_their_smallest_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (5, text), (4, text + " x"), (9, text), (None, text), (6, "other words")]
    got = dict(pipeline.STAGES)["near_duplicates"](spark, odd(spark, rows), SF)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("4", text + " x"), ("None", text), ("6", "other words")])


def test_only_repeated_lines_change(spark):
    long = " ".join(f"w{k}" for k in range(45))
    rows = [(1, f"a b\n{long}\nc"), (2, f"x\n{long}\ny"), (3, long), (4, f"{long}\n")]
    got = dict(pipeline.STAGES)["line_dedup"](spark, odd(spark, rows), SF)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, rows[0][1], len(rows[0][1])), (2, "x\ny", 3)]
