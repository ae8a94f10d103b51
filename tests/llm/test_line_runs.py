import hashlib
import random

from quarrylog.llm import line_dedup

SCHEMA = "doc_id long, text string"


def left_of(texts, least):
    """What is left of each text once every run that stands earlier too, each as long as it gets, is deleted."""
    lines = {i: (t.split("\n") if t else []) for i, t in texts.items()}
    words = {i: [len(x.split(" ")) if x.strip() else 0 for x in xs] for i, xs in lines.items()}
    seen, out = [], {}
    for i in sorted(texts):
        gone = set()
        for p, x in enumerate(lines[i]):
            far = 0
            for j, q in seen:
                k = 0
                while p + k < len(lines[i]) and q + k < len(lines[j]) and lines[i][p + k] == lines[j][q + k]:
                    k += 1
                far = max(far, k)
            if words[i][p] and sum(words[i][p : p + far]) >= least:
                gone.update(range(p, p + far))
            seen.append((i, p))
        out[i] = (len(gone), "\n".join(x for p, x in enumerate(lines[i]) if p not in gone))
    return out


def check(spark, texts, least):
    got = {r.doc_id: r for r in line_dedup.summary(line_dedup.remove_repeated_lines(spark, spark.createDataFrame(list(texts.items()), SCHEMA), least)).collect()}
    want = left_of(texts, least)
    assert {i: (r.n_removed_lines, r.kept_sha256) for i, r in got.items()} == {i: (n, hashlib.sha256(x.encode()).hexdigest()) for i, (n, x) in want.items()}
    return want


def test_runs_go_to_their_end(spark):
    long, short, other = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 10), ("c", 45)))
    texts = {
        1: f"{long}\nelse",
        2: f"{long}\n{short}",
        3: f"{long}\n{short}",  # a copy, whose first line stands in 1 too: all goes
        4: f"{long}\n{short}\n{other}",
        5: f"{short}\n{long}\n\n{short}\nend",
        6: f"{short}\n{long}\n\n{short}\n{short}\nlast",
    }
    want = check(spark, texts, 40)
    assert want[3] == (2, "") and want[4] == (2, other) and want[6] == (4, f"{short}\nlast")


def test_runs_of_random_lines(spark):
    rnd = random.Random(9)
    pool = ["", "a", "b c", "d e f", "g h i j k", "a b"]
    check(spark, {i: "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for i in range(40)}, 8)
