import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quern.llm.importance import PAIR, bits_for, importance, kth_largest, ratios, weigh
from quern.llm.shingles import mix, word_hashes


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(2).normal(size=500)] + [3.0] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 41, 250, 540):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", 541) is None and kth_largest(df, "x", 0) is None


def test_weights_are_sums_over_single_texts():
    ratio = np.random.default_rng(1).normal(size=1 << 16)
    texts = ["a b c", "", None, "d " * 9000, "É x"]
    n, w = weigh(pa.array(texts), ratio)
    for k, t in enumerate(texts):
        a, b = weigh(pa.array([t], pa.string()), ratio)
        assert n[k] == a[0] and abs(w[k] - b[0]) < 1e-6
    assert list(n) == [5, 0, 0, 17999, 3] and not ratios(np.zeros(4), np.ones(4)).any()


def bucket(h, bits):
    return int(h >> np.uint64(64 - bits))


def plain_grams(text, bits):
    """Buckets of a text's words and neighbours, one word hashed at a time."""
    words = [word_hashes(pa.array([w]))[0][0] for w in re.findall(r"[^ \t-\r]+", text or "")]
    pairs = [mix(np.array([a], np.uint64) * PAIR + b)[0] for a, b in zip(words, words[1:], strict=False)]
    return [bucket(h, bits) for h in [*words, *pairs]]


def test_weights_against_plain_counts(spark):
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 12)) + (" Good end" if i % 3 == 0 else "\n bad\tend É")) for i in range(80)]
    rows += [(90, None), (91, ""), (None, "no id"), (3, "another text of three"), (5, rows[5][1])]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(3, 1), (3, 0), (None, 1), (7, None), (1000, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    good = {i for i, y in labels if y == 1 and i is not None}
    bits = 16
    raw, target = Counter(), Counter()
    for _, t in rows:
        raw.update(plain_grams(t, bits))
    for i in good:
        if texts := [t or "" for j, t in rows if j == i]:
            target.update(plain_grams(min(texts), bits))
    n = 1 << bits
    ratio = lambda b: math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    want = sorted((str(i), str(t), len(plain_grams(t, bits)), round(sum(map(ratio, plain_grams(t, bits))), 3)) for i, t in rows)
    got = importance(docs, marks).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_grams, round(r.log_weight, 3)) for r in got) == want
    assert [r.gumbel_key for r in sorted(got, key=lambda r: -r.gumbel_key) if r.sampled] == sorted((r.gumbel_key for r in got), reverse=True)[: sum(r.sampled for r in got)]
    assert sum(r.sampled for r in got) >= math.ceil(len(rows) / 2)


def test_buckets_grow_with_the_documents():
    assert [bits_for(n) for n in (0, 1000, 50_000, 250_000, 10**6, 10**9)] == [16, 16, 16, 17, 18, 23] and bits_for(10**15) == 24


def test_clashing_columns_and_string_ids(spark):
    docs = spark.createDataFrame([("a", "x y", 1, 2), ("b", "z", 3, 4), (None, None, 5, 6)], "doc_id string, text string, score int, n int")
    got = importance(docs, spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int"))
    assert got.columns == ["doc_id", "text", "score", "n", "n_grams", "log_weight", "kept", "gumbel_key", "sampled"] and sorted(r.n for r in got.collect()) == [2, 4, 6]


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = importance(docs, labels).collect()
    assert sum(r.sampled for r in got) == math.ceil(len(got) / 2)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.kept, quality[r.doc_id] == 1) for r in got if r.doc_id in quality]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    low = min(r.gumbel_key for r in got if r.sampled)
    assert all(r.sampled == (r.gumbel_key >= low) for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "x y"), (3, "x y"), (4, "w " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = importance(docs, none).collect()
    assert len(got) == 6 and all(r.kept for r in got) and sum(r.sampled for r in got) >= 3
    assert len({r.sampled for r in got if r.doc_id == 3}) == 1
    assert importance(docs.limit(0), none).count() == 0
