import random
import re

from quern.llm.jaccard import jaccard_components, keep_one_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k=5, percent=80):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return [(i, len(sets[a]), least.get(root(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def same(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def changed(rng, words, share):
    return [rng.choice("uvwxyz") + str(rng.random()) if rng.random() < share else w for w in words]


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for size in (1, 2, 3, 25, 60):
        for _ in range(6 if size < 5 else 1):
            base = [str(rng.randint(0, 3000)) for _ in range(rng.randint(1, 120))]
            for _ in range(size):
                rows.append((i, " ".join(changed(rng, base, rng.choice((0, 0.01, 0.02, 0.05))))))
                i += 1
    passage = " ".join(str(rng.random()) for _ in range(60))
    rows += [(i + k, passage + " " + " ".join(str(rng.random()) for _ in range(30))) for k in range(30)]
    rng.shuffle(rows)
    same(spark, rows)


def test_odd_rows(spark):
    same(spark, [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A\tb"), (6, "b a"), (7, "a b c d e"), (8, "a b c d E"), (8, "x y z"), (None, "x y z"), (None, None), (9, "é è"), (9, "é è"), (10, "É è"), (11, "w " * 50_000), (12, "w " * 40_000)])


def test_threshold_is_inclusive(spark):
    words = [str(k) for k in range(100)]
    rows = [(1, " ".join(words[:40])), (2, " ".join(words[:49])), (3, " ".join(words[:50])), (4, " ".join(words[:36]))]
    same(spark, rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string, key int, cls int")).count() == 0


def test_supplied_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    same(spark, rows)


def test_keep_one_each(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(3, text, 1), (2, text, 2), (2, text, 2), (5, "", 3), (6, None, 4), (7, "else " * 9, 5)], "doc_id long, text string, key int")
    assert sorted(r.doc_id for r in keep_one_each(docs).collect()) == [2, 5, 6, 7]


def test_keep_one_each_of_null_and_shared_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = f"{a} more"  # a near copy of a
    rows = [(None, a), (None, near), (None, b), (1, c), (1, d), (1, d), (2, c), (None, d), (4, "e f"), (4, "e g"), (None, ""), (None, " ")]
    got = [tuple(r) for r in keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    kept_a = [r for r in got if r[1] in (a, near)]
    assert len(kept_a) == 1 and kept_a[0][0] is None
    want = [(None, b), (1, c), (1, d), (4, "e f"), (4, "e g"), (None, ""), (None, " ")]
    assert sorted((r for r in got if r not in kept_a), key=str) == sorted(want, key=str)
    assert keep_one_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
