"""Texts longer than what a worker handles at once (2 MB): every operator takes them whole."""

import hashlib
import random
import struct
import zlib

import pytest

from quarrylog.llm import ans, bpe, common, decontaminate, exact_dedup, jaccard_join, licenses, line_dedup, sharding, suffix_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def half():
    rnd = random.Random(21)
    out, size = [], 0
    while size < common.SLICE_BYTES * 2 // 3:
        out.append(" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(12)))
        size += len(out[-1]) + 1
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def docs(spark, half):
    assert 2 * len(half) > common.SLICE_BYTES
    rows = [(1, half + half), (2, "short text of its own"), (3, half + half.replace(" ", "  ")), (4, half + "this is released under the MIT License\n")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_tokens(spark, docs, half):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(ans.read_tokens(spark, ans.write_tokens(spark, docs, path, parts=2)))
    texts, at = by_id(docs), 0
    for i in sorted(texts):
        ids = t.encode(texts[i].text, add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode(half + half, add_special_tokens=False).ids
    assert by_id(bpe.encode_digests(docs, path))[1].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_copies_and_repeats(spark, docs, half):
    n = len(half)
    sizes = by_id(sharding.shards(spark, docs, k=2))
    assert sizes[1]["size"] == 2 * n + 16
    exact = by_id(exact_dedup.exact_groups(docs))
    assert exact[1].keep_id == exact[3].keep_id == 3 and exact[1].group_size == 2 and exact[2].keep_id == 2
    near = by_id(jaccard_join.near_duplicates(spark, docs, 3, 90, 100))
    assert near[1].component_id == near[3].component_id == near[4].component_id == 1 and near[2].component_id == 2
    got = by_id(suffix_dedup.remove_repeats(spark, docs))
    assert got[1].spans == [[n, 2 * n]] and got[2].spans == [] and got[4].spans == [[0, n]]
    more = len(half.split(" ")[0]) + 1  # after the first half, both texts go on with the same word and a blank
    assert got[3].spans[0] == [0, n + more]
    lines = by_id(line_dedup.summary(line_dedup.remove_repeated_lines(spark, docs)))
    assert lines[1].n_removed_lines >= half.count("\n") and lines[2].n_removed_lines == 0 and lines[4].n_removed_lines == half.count("\n")


def test_scans(spark, docs, half):
    last = half.split("\n")[-2]
    bench = spark.createDataFrame([(7, last), (8, "words that stand nowhere in these texts at all, not once")], "item_id long, text string")
    found = by_id(decontaminate.contamination(docs, bench))
    # the words of two copies in one text, and the window of ten words across the line is no item's
    assert found[1].spans[-1][1] == found[1].n_words == 2 * len(half.split()) and found[1]["items"] == ["7"] and found[2]["items"] == []
    assert [(m.template, m.start) for m in by_id(licenses.license_matches(docs))[4].matches] == [("mit-notice", len(half.split()) + 2)]  # `this is` lacks the word between
    scorer = toxicity.Scorer(toxicity.Evidence(toxicity.ORDER, {"zzz": 1.0}, {}), [0.0, 1.0, 0.0, 0.0])
    assert set(by_id(toxicity.scores(spark, docs, scorer))) == {1, 2, 3, 4}
