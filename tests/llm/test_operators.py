import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.llm import ans, bpe, common, decontaminate, exact_dedup, jaccard_join, licenses, line_dedup, queries, sharding, suffix_dedup, toxicity
from tests.compare import connect, difference

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, t string, n string, slice string, bucket string, keep_id string, removed string, score string, gram string, first string, label string, part string, word string"
CLASH = ("x",) * 13
POOL = "abcdefghijklmnopqrstuvwxyzABCDEÀÉßäöüñ 's't'll0123456789.,!?-_\n\t'\"#$%&\xa0\x85\x1c\x1f²½ªİıſΣςΑ中文あア한국🙂́ ﬁ\x00<|endoftext|>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None, None, *CLASH) for k, (i, t) in enumerate(rows)], SCHEMA)


def words(rnd, n, pool="abcdefghij"):
    return " ".join("".join(rnd.choice(pool) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    base = [words(rnd, n) for n in (3, 12, 40, 80, 200)]
    rows = {i: words(rnd, rnd.randint(1, 60)) for i in range(40)}
    for i in range(40, 70):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "zz"
        rows[i] = (" " if i % 2 else "\n").join(w)
    rows |= {70: None, 71: "", 72: " \t\n", 73: "one", 74: "One", 75: "ü" * 300, 76: "a" * 5000, -3: rows[41], 77: rows[41] + "\n\n" + rows[41], 78: "<|endoftext|> MIT License"}
    return rows


def by_id(df):
    out = {}
    for r in df.collect():
        out[r["doc_id"]] = r
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_every_operator_takes_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    path = public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        ans.read_tokens(spark, ans.write_tokens(spark, empty, public_tokenizers.path("byte_bpe_50k.json"))),
        sharding.shards(spark, empty),
        bpe.encode_digests(empty, path),
        licenses.summary(licenses.license_matches(empty)),
        decontaminate.summary(decontaminate.contamination(empty, bench)),
        suffix_dedup.remove_repeats(spark, empty, digest=True),
        jaccard_join.near_duplicates(spark, empty),
        toxicity.scores(spark, empty, toxicity.fit(spark, empty, labels)),
        exact_dedup.exact_groups(empty),
        line_dedup.remove_repeated_lines(spark, empty),
    ):
        assert df.count() == 0


def test_rans_round_trip_and_damage():
    rnd = np.random.RandomState(1)
    for alphabet in (1, 2, 300, 50_000):
        ids = np.minimum(rnd.zipf(1.3, 90_000), alphabet) - 1
        table = ans.Frequencies(np.bincount(ids))
        assert int(table.freq.sum()) == 1 << table.bits
        parts = [ids[:0], ids[:1], ids[:77], ids[:20_000], ids]
        coded = ans.encode_blocks(parts, table)
        assert all(np.array_equal(a, b) for a, b in zip(parts, ans.decode_blocks(coded, table), strict=True))
    bad = bytearray(coded[-1])
    bad[-5] ^= 1
    with pytest.raises(ValueError):
        ans.decode_blocks([bytes(bad)], table)


def test_token_files(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(5)
    rows = dict(texts) | {1000 + i: "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for i in range(400)} | {5000: "ab é " * 70_000}
    for parts in (1, 5):
        to = ans.write_tokens(spark, frame(spark, rows.items()), path, end_id=0, parts=parts, to=f"file://{tmp_path}/{parts}")
        got, at = by_id(ans.read_tokens(spark.newSession(), to)), 0  # the folder is all that is needed
        for i in sorted(rows):
            ids = t.encode(rows[i] or "", add_special_tokens=False).ids + [0]
            raw = struct.pack(f"<{len(ids)}I", *ids)
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (at, len(ids), zlib.crc32(raw), raw)
            at += len(ids)
    again = ans.read_tokens(spark, ans.write_tokens(spark, frame(spark, [(7, "a b"), (7, "a b"), (None, "c")]), path)).collect()
    assert sorted((r.doc_id is not None, r.start) for r in again) == [(False, 0), (True, 2), (True, 5)]


def test_token_blocks_know_their_table():
    block = ans.pack_block([3, None], [1, 4], b"rest", 77)
    assert ans.unpack_block(block, 77) == ([3, None], [1, 4], b"rest")
    with pytest.raises(ValueError, match="another table"):
        ans.unpack_block(block, 78)
    with pytest.raises(ValueError, match="damaged"):
        ans.unpack_block(block[:22] + bytes([block[22] ^ 1]) + block[23:], 77)


def test_karmarkar_karp():
    assert sorted(sharding.difference_groups(np.array([8, 7, 6, 5, 4]), 2)[0].tolist()) == [14, 16]
    rnd = np.random.RandomState(2)
    sizes = rnd.randint(1, 1000, 500)
    sums, part = sharding.difference_groups(sizes, 7)
    assert np.array_equal(np.bincount(part, sizes, 7).astype(int)[np.argsort(-np.bincount(part, sizes, 7))], np.sort(sums)[::-1]) and sums.max() - sums.min() < 10
    base = np.array([0, 5000, 100, 0, 0, 0, 3000])
    sums, part = sharding.difference_groups(sizes[:60], 7, base)
    assert np.array_equal(np.bincount(part, sizes[:60], 7).astype(int) + base, sums) and sums.max() - sums.min() < 200
    assert sharding.difference_groups(np.zeros(0, np.int64), 3, np.array([3, 1, 2]))[0].tolist() == [3, 1, 2]


def test_shards(spark, texts):
    rows = [*texts.items(), (500, texts[41]), (500, texts[41]), (None, "x")]
    got = sharding.shards(spark, frame(spark, rows), k=4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    groups: dict = {}
    for r in got:
        if r.doc_id is not None:
            assert r["size"] == len((texts.get(r.doc_id, texts[41]) or "").encode()) + 16
            groups.setdefault(texts.get(r.doc_id, texts[41]) or "", set()).add(r.shard)
    assert all(len(v) == 1 for v in groups.values())


@pytest.mark.parametrize("copies", [50, 4000])
def test_shards_are_even(spark, copies):
    rnd = random.Random(8)
    rows = [(i, "w" * rnd.randint(0, 400) + str(i)) for i in range(3000)] + [(5000 + i, "a copy " * 40) for i in range(copies)]
    text = dict(rows)
    got = sharding.shards(spark, frame(spark, rows), k=6, unit_groups=150).collect()
    hot = {r.shard for r in got if r.doc_id >= 5000}
    assert len(got) == len(rows) and len(hot) == 1
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(6)]
    if copies == 4000:  # larger than a fair share: alone, and the others share the rest
        assert {r.shard for r in got if r.doc_id < 5000} == set(range(6)) - hot
        sizes = [n for s, n in enumerate(sizes) if s not in hot]
    assert max(sizes) - min(sizes) < 40
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(3)
    rows = dict(texts) | {1000 + i: "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for i in range(300)}
    got = by_id(bpe.encode(frame(spark, rows.items()), path))
    digests = by_id(bpe.encode_digests(frame(spark, rows.items()), path))
    for i, x in rows.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (bytes(got[i].ids), got[i].decoded) == (raw, t.decode(ids, skip_special_tokens=False))
        assert digests[i].ids_sha256 == hashlib.sha256(raw).hexdigest()


def test_licenses(spark):
    auto = licenses.TokenAutomaton("a <<beginOptional>>b <<beginOptional>>c <<endOptional>><<endOptional>>d <<var;name=x;min=1;max=2>> e")
    ok = lambda s: auto.accepts_at(s.split(), 0)
    assert [ok(s) for s in ("a d x e", "a b d x e", "a b c d x y e z", "a c d x e", "a d e", "a d x y z e", "a d x")] == [4, 5, 7, None, None, None, None]
    with pytest.raises(ValueError):
        licenses.TokenAutomaton("<<beginOptional>>a<<endOptional>>")
    rows = {1: "MIT license, mit  LICENSE", 2: None, 3: "General public\nlicense", 4: "Released under the terms of the MIT License", 5: "mit x license", 6: "licensed under the apache license version 2.0"}
    got = by_id(licenses.summary(licenses.license_matches(frame(spark, rows.items()))))
    assert [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels, got[i].score) for i in rows] == [(4, 2, 0, 2, "mit", "mit", 0.5), (0, 0, None, None, "", "", 0.0), (3, 1, 0, 0, "gpl", "gpl", 0.5), (8, 1, 6, 6, "mit", "mit,mit-notice", 1.0), (3, 0, None, None, "", "", 0.0), (8, 1, 3, 3, "apache", "apache,apache-2.0-notice", 1.0)]


@pytest.mark.parametrize("block", [1 << 25, 200])
def test_decontamination(spark, texts, block):
    rnd = random.Random(7)
    items = {1: " ".join(texts[60].split()[:15]), 2: "One", 3: None, 4: "", 5: "a b c", 6: words(rnd, 30), 7: "a b c", 8: words(rnd, 11)}
    rows = dict(texts) | {300: "x A b, C b c " + items[6], 301: items[8] + " " + items[8]}
    bench = spark.createDataFrame([*items.items()], "item_id long, text string")
    got = by_id(decontaminate.contamination(frame(spark, rows.items()), bench, block_bytes=block))
    for i, x in rows.items():
        n, hit, found = decontaminate.brute_force(x, items)
        assert (got[i].n_words, sum(b - a for a, b in got[i].spans), sorted(got[i]["items"])) == (n, hit, found)
    kept = decontaminate.remove_contaminated(frame(spark, rows.items()), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in rows.items() if not decontaminate.brute_force(x, items)[1]}


def test_decontamination_tells_rows_apart(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "nothing"), (None, "two three"), (None, None), (2, "four"), (None, "two three")]
    bench = spark.createDataFrame([(1, "two three"), (1, "four"), (2, "three"), (None, "one")], "item_id long, text string")
    seen = []
    for block in (4, 1 << 25):
        got = decontaminate.contamination(frame(spark, rows), bench, block_bytes=block).collect()
        seen.append(sorted((r.doc_id or 0, r.n_words, str(r.spans), str(r["items"])) for r in got))
        kept = decontaminate.remove_contaminated(frame(spark, rows), bench, block_bytes=block)
        assert sorted(r.text or "" for r in kept.collect()) == ["", "nothing"]
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    assert seen[0].count((1, 3, "[[0, 3]]", "['1', '2']")) == 2 and seen[0].count((0, 2, "[[0, 2]]", "['1', '2']")) == 2


def test_suffix_dedup_of_repeated_rows(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(5, long), (5, long), (5, long), (6, long), (4, "x" * 99), (4, "x" * 99), (None, "y" * 120)]
    for parts in (1, 2, 5):
        got = suffix_dedup.remove_repeats(spark, frame(spark, rows).repartition(parts), window=100).collect()
        n = len(long)
        assert sorted(sum(b - a for a, b in r.spans) for r in got) == sorted([0, n, n, n, 0, 0, 119])


def test_suffix_dedup(spark, texts):
    for window, k, hot in ((100, 40, 8192), (20, 8, 2)):
        got = by_id(suffix_dedup.remove_repeats(spark, frame(spark, texts.items()).repartition(3), window=window, k=k, hot=hot))
        want = suffix_dedup.brute_force(texts, window)
        assert all((sum(b - a for a, b in got[i].spans), len(got[i].spans), bytes(got[i].kept)) == want[i] for i in texts)


def test_jaccard_join(spark, texts):
    for width, num, den in ((3, 90, 100), (5, 8, 10), (1, 1, 2)):
        got = by_id(jaccard_join.near_duplicates(spark, frame(spark, texts.items()), width, num, den, range_bytes=2000))
        want = jaccard_join.brute_force(texts, width, num, den)
        assert {i: (got[i].n_shingles, got[i].component_id) for i in texts} == want


def test_jaccard_join_of_many_near_copies(spark, monkeypatch):
    """A group's pairs follow its size, not its square, and no link of it is lost."""
    rnd = random.Random(12)
    base = words(rnd, 120).split(" ")
    rows = {}
    for i in range(1500):
        w = list(base)
        if i % 3:
            w[rnd.randrange(len(w))] = f"own{i}"
        rows[i] = " ".join(w)
    rows |= {2000 + i: words(rnd, 40) for i in range(20)} | {3000: " ".join(base[:60]), 3001: " ".join(base[:59])}
    made = []
    verified = jaccard_join._Pairs.verified
    monkeypatch.setattr(jaccard_join._Pairs, "verified", lambda self, pairs, name: made.append(pairs.count()) or verified(self, pairs, name))
    got = by_id(jaccard_join.near_duplicates(spark, frame(spark, rows.items()), 3, 90, 100))
    assert sum(made) < 6 * 1000, made
    want = jaccard_join.brute_force({i: rows[i] for i in [*range(0, 1500, 7), *range(2000, 2020), 3000, 3001]}, 3, 90, 100)
    assert {got[i].component_id for i in range(1500)} == {0} and all(got[i].component_id == i for i in range(2000, 2020))
    assert {got[i].n_shingles for i in want} == {n for n, _ in want.values()} and got[3001].component_id == got[3000].component_id == 3000


def test_jaccard_join_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "x y z q"), (None, "a b c d"), (None, "n o p"), (None, None), (3, "A b c  d"), (7, ""), (8, "u" * 200_000 + " v w x")]
    got = jaccard_join.near_duplicates(spark, frame(spark, rows), 3, 90, 100).collect()
    seen = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)
    assert seen == sorted([(5, 2, 3), (5, 2, 3), (5, 2, 5), (None, 2, 3), (None, 1, None), (None, 0, None), (3, 2, 3), (7, 0, 7), (8, 2, 8)], key=str)


def test_slices_of_fewer_words_than_a_shingle(spark):
    for rows in ([(1, "a b")], [(1, "a"), (2, "A")], [(1, "a b c"), (2, None)]):
        got = jaccard_join.near_duplicates(spark, frame(spark, rows), 5, 8, 10).collect()
        assert {(r.n_shingles, r.component_id) for r in got if r.n_shingles} == {(1, 1)}


def test_bitmaps_bound_the_difference():
    rnd = np.random.RandomState(3)
    for _ in range(200):
        a, b = (np.unique(rnd.randint(0, 1 << 62, rnd.randint(1, 300)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: rnd.randint(0, len(a) + 1)], b]))
        bits = jaccard_join.bitmaps(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))


def test_toxicity(spark):
    rnd = random.Random(9)
    plain = ["".join(rnd.choice(["ka", "lo", "mi", "ne", "ru"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    rows, labels = {}, []
    for i in range(600):
        bad = i % 5 == 0
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vexgrot", "hagspew" + rnd.choice(plain)]))
        rows[i] = " ".join(w)
        labels.append((i, int(bad)))
    rows |= {1000: None, 1001: "", 1002: "123 !!"}
    docs = frame(spark, rows.items())
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(spark, docs, table.where(~toxicity.held_out(F.col("doc_id")) | F.col("doc_id").isNull()))
    got = by_id(toxicity.scores(spark, docs, scorer))
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= 0.3) == (y == 1) for i, y in held)
    assert right / len(held) > 0.95 and got[1000].score == got[1001].score == got[1002].score and 0 <= got[1000].score < 0.3
    kept = {r.doc_id for r in toxicity.reject_toxic(spark, docs, scorer).collect()}
    assert kept == {i for i in rows if got[i].score < 0.3}
    assert toxicity.fit(spark, docs, table.where("toxic = 1")).score("vexgrot") == 0.0


def test_exact_dedup(spark, texts):
    rows = dict(texts) | {200: "a b", 201: " ab", 202: "a\tb\n", 203: "a\xa0b"}
    got = by_id(exact_dedup.exact_groups(frame(spark, rows.items()).repartition(5)))
    groups: dict = {}
    for i, x in rows.items():
        groups.setdefault("".join(c for c in x or "" if c not in " \t\n\x0b\x0c\r"), []).append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(rows[i] or ""), i))
        assert all((got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids)


def test_patricia_trie():
    rnd = random.Random(4)
    keys = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    trie, want = exact_dedup.PatriciaOwners(), {}
    for i, k in enumerate(keys):
        trie.insert(k, (i,), 1)
        want[k] = (min(want.get(k, ((i,),))[0], (i,)), want.get(k, (0, 0))[1] + 1)
    assert {k: (o, n) for k, o, n in trie.items()} == want


def test_line_dedup(spark, texts):
    for least in (1, 4, 40):
        df = line_dedup.remove_repeated_lines(spark, frame(spark, [*texts.items(), (41, texts[41])]), least)
        assert df.count() == len(texts) + 1 and set(frame(spark, list(texts.items())[:1]).columns) < set(df.columns)
        got, want = by_id(line_dedup.summary(df)), line_dedup.brute_force(texts, least)
        assert all((got[i].n_removed_lines, got[i].kept_sha256) == (want[i][0], hashlib.sha256(want[i][1].encode()).hexdigest()) for i in texts)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["id"]: r.component for r in common.components(spark, common.Stage(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got.get(v, v) == find(v) for v in list(up))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    columns, stage = docs.columns, dict(pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = line_dedup.brute_force(texts, line_dedup.MIN_WORDS)
    got = stage["line_dedup"](spark, docs, SF)
    assert got.columns == columns and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (x, len(x)) for i, (n, x) in want.items() if not n or x.strip()}
    got = stage["near_duplicates"](spark, docs, SF)
    assert got.columns == columns and {r.doc_id for r in got.collect()} == {i for i, (_, c) in jaccard_join.brute_force(texts, 5, 8, 10).items() if c == i}
    got = stage["decontamination"](spark, docs, SF)
    assert got.columns == columns and {r.doc_id for r in got.collect()} == {i for i, x in texts.items() if not decontaminate.brute_force(x, bench)[1]}
