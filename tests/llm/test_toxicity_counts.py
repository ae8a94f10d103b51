import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarrylog.llm import bpe, common, toxicity


def test_expressions_outside_the_sample_are_known(spark):
    """Class counts come from all training rows, whatever the sample of the logistic weights holds."""
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    bad = ["".join(rnd.choice("qrstuvwxyz") for _ in range(7)) for _ in range(40)]
    docs = [(i, " ".join([*rnd.sample(plain, 12), *(rnd.sample(bad, 3) if i % 3 == 0 else [])])) for i in range(900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    scorer = toxicity.fit(spark, frame, labels, max_toxic=12, max_ordinary=24)
    assert all(scorer.model.word(w) > toxicity.EVIDENCE for w in bad)


def test_pruning_keeps_what_tells_most(spark):
    docs = [(i, "calm river stone" if i % 2 else "calm river zyxwv") for i in range(200)]
    docs = [(i, f"{t} n{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}") for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in docs], "doc_id long, toxic int")
    scorer = toxicity.fit(spark, frame, labels, max_grams=20)
    assert len(scorer.model.grams) <= 20 and scorer.model.word("zyxwv") > toxicity.EVIDENCE > scorer.model.word("calm")


def counted(docs):
    """Class counts of grams, and what stands before each suffix, from the definition."""
    grams, before = {}, {}
    for label, text in docs:
        for w in set(text.split()):
            for g in toxicity.word_grams(w):
                grams.setdefault(g, [0, 0])[label] += 1
    suffixes = {g[k:] for g in grams for k in range(len(g))}
    for s in suffixes:
        if len(s) > 1:
            before[s[1:]] = before.get(s[1:], 0) + 1
    return grams, before


def shares(counts, of, discounts):
    """Total and rest of each context, over counts of its grams."""
    total, rest = {}, {}
    for g, n in counts.items():
        total[g[:-1]] = total.get(g[:-1], 0) + n
        rest[g[:-1]] = rest.get(g[:-1], 0) + (toxicity.discount(n, discounts) if of(g) else n)
    return total, rest


def test_models_equal_their_definition_and_sum_to_one(spark):
    rnd = random.Random(4)
    syllables = ["ka", "lo", "mi", "ne", "ru", "zo"]
    docs = [(i % 2, " ".join("".join(rnd.choice(syllables[i % 2 :]) for _ in range(rnd.randint(1, 4))) for _ in range(8))) for i in range(120)]
    grams, before = counted(docs)
    table = spark.createDataFrame([(g, *n) for g, n in grams.items()], "gram string, n0 long, n1 long")
    model = toxicity._model(toxicity.Stage(spark, "test"), table, 1_000_000)
    kept = {g for g, n in grams.items() if max(n) > 1}
    assert model.kept == {g: tuple(grams[g]) for g in kept}
    times = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    wanted = (*(toxicity.estimated(times([n[k] for n in grams.values()])) for k in (0, 1)), toxicity.estimated(times(before.values())))
    assert model.discounts == wanted
    total, rest = shares(before, lambda g: True, wanted[2])
    for s, (n, t, r) in model.shared.items():
        assert (n, t) == (before[s], total[s[:-1]]) and abs(r - rest[s[:-1]]) < 1e-9
    for k in (0, 1):
        t, r = shares({g: n[k] for g, n in grams.items()}, kept.__contains__, wanted[k])
        assert all(c[k] == t[h] and abs(c[2 + k] - r[h]) < 1e-9 for h, c in model.contexts.items())
    # with all suffixes known, each class's probabilities of what may follow a context sum to 1
    whole = toxicity.KneserNey({s: (n, total[s[:-1]], rest[s[:-1]]) for s, n in before.items()}, model.kept, model.contexts, model.alphabet, discounts=wanted)
    letters = sorted({s for s in before if len(s) == 1})
    unseen = [chr(0x4E00 + k) for k in range(whole.alphabet - len(letters))]
    for h in rnd.sample(sorted(model.contexts), 40):
        for s in {h[k:] for k in range(1, len(h))}:  # contexts of which some follower was never asked for
            for c in letters:
                whole.shared.setdefault(s + c, (0, total.get(s, 0), rest.get(s, 0.0)))
            for c in unseen:
                whole.shared.setdefault(s + c, (0, total.get(s, 0), rest.get(s, 0.0)))
        for c in unseen:
            whole.shared.setdefault(c, (0, total[""], rest[""]))
        for label in (0, 1):
            assert abs(sum(whole.probability(h + c, label) for c in [*letters, *unseen]) - 1) < 1e-6


def test_grams_of_words_and_the_label_filter(spark):
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abcé🙂") for _ in range(rnd.randint(1, 12))): (rnd.randint(0, 3), rnd.randint(0, 3)) for _ in range(200)}
    want = {}
    for w, n in words.items():
        for g in toxicity.word_grams(w):
            want[g] = tuple(a + b for a, b in zip(want.get(g, (0, 0)), n, strict=True))
    half = [(w, a // 2, b) for w, (a, b) in words.items()] + [(w, a - a // 2, 0) for w, (a, b) in words.items()]
    got = toxicity.gram_counts(spark.createDataFrame(half, "word string, n0 long, n1 long")).collect()
    assert {r.gram: (r.n0, r.n1) for r in got} == want and len(got) == len(want)
    ids = [rnd.randrange(-(1 << 60), 1 << 60) for _ in range(500)]
    docs = spark.createDataFrame([(i, "x") for i in [*ids, *range(1000), None]], "doc_id long, text string")
    labelled = spark.createDataFrame([(i,) for i in ids[:100]], "doc_id long").repartition(3)
    for bits, most in ((20, 105), (9, 2000)):  # a table that labels fill lets more pass, and loses none
        got = [r.doc_id for r in docs.mapInArrow(toxicity._maybe_labelled(spark, labelled, bits), docs.schema).collect()]
        assert set(ids[:100]) <= set(got) and len(got) <= most


def test_no_gram_that_occurs_twice_is_left_out(spark):
    """More of them than the 400,000 that were once kept at most."""
    rnd = random.Random(12)
    bad = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(80_000)})
    docs = [(i, "calm river stone " + (" ".join(rnd.sample(bad, len(bad))) if i % 2 else f"n{i}")) for i in range(24)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    scorer = toxicity.fit(spark, frame, labels)
    grams = {g for w in [*bad, "calm", "river", "stone"] for g in toxicity.word_grams(w)}
    assert len(grams) > 400_000 and grams <= {g for g in grams if scorer.model.grams.get(toxicity._keys(*key(g), toxicity.ORDER))[1][0]}


def key(gram):
    codes, n = toxicity._codes([gram])
    return codes, n - 1, n


def test_all_labelled_rows_of_their_third_are_fitted_on(spark):
    """More of them than the 3,000 and 6,000 that once were; weights equal a fit over all features at once."""
    rnd = random.Random(13)
    plain, bad = (["".join(rnd.choice(of) for _ in range(5)) for _ in range(60)] for of in ("abcdefghij", "ghijklmnop"))
    docs = [(i, " ".join([rnd.choice(plain), rnd.choice(bad if i % 3 == 0 and i % 7 else plain), *rnd.sample(plain, 2)]) + f" {i}") for i in range(36_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    scorer = toxicity.fit(spark, frame, labels)
    part = frame.where(F.pmod(F.xxhash64(F.unhex(F.sha2("text", 256))), F.lit(3)) == 0).collect()
    y = np.array([r.doc_id % 3 == 0 for r in part], float)
    assert y.sum() > 3000 and (1 - y).sum() > 6000
    x = np.column_stack([np.ones(len(y)), scorer.features([r.text for r in part])])
    shares, have = (24_000, 12_000), ((1 - y).sum(), y.sum())
    weight = np.where(y == 1, shares[1] / have[1], shares[0] / have[0]) * len(y) / 36_000
    want = toxicity.logistic(lambda w: toxicity._slopes(x, y, weight, w), 4)
    assert np.allclose(scorer.weights, want, rtol=1e-6, atol=1e-8)


def test_log_ratios_by_joins_equal_the_models(spark):
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcé🙂") for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    grams = {}
    for w in words:
        n = (rnd.choice([0, 1, 1, 2, 3, 9]), rnd.choice([0, 0, 1, 2, 5]))
        for g in toxicity.word_grams(w):
            grams[g] = tuple(a + b for a, b in zip(grams.get(g, (0, 0)), n, strict=True))
    table = spark.createDataFrame([(g, *n) for g, n in grams.items()], "gram string, n0 long, n1 long")
    stage = toxicity.Stage(spark, "test")
    model, found = toxicity._model(stage, table, None), toxicity._counts(stage, table, None)
    context = lambda h: math.log(math.prod(max(r / t, 1e-15) ** s if t else 1.0 for t, r, s in zip(model.contexts[h][:2], model.contexts[h][2:], (-1, 1), strict=True)))
    got = {(r.kind, r.s): r.v for r in toxicity._log_ratios(found).collect()}
    want = {(0, g): model.ratio(g) for g in model.kept} | {(1, h): context(h) for h in model.contexts}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    seen = toxicity._evidence(found)
    tests = [*words, "b", "zzz", "cab" * 9000, "🙂é"]
    for w, v in zip(tests, seen.words(tests), strict=True):
        total = sum(want.get((0, g), want.get((1, g[:-1]), 0.0)) for g in toxicity.word_grams(w))
        assert abs(v - total) < 1e-9 * max(1, len(w)) and v == seen.word(w)


def test_scoring_gives_back_what_other_operators_remember(spark):
    """In a worker that ran another operator before, as in a session that runs the pipeline again."""
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    scorer = toxicity.Scorer(toxicity.Evidence(toxicity.ORDER, {"^a$": 1.0}, {}), [0.0, 1.0, 0.0, 0.0])

    def run(batches):
        common.powers(10)
        bpe._tokenizers["x"] = None
        for batch in toxicity._score(Shared(scorer))(batches):
            assert not bpe._tokenizers and not common._powers
            yield batch
        assert len(common.powers(10)[0]) == 10

    assert docs.mapInArrow(run, "doc_id long, score double").count() == 1


class Shared:
    def __init__(self, value):
        self.value = value
