import math
import random
import re
import zlib

from quern.llm.toxicity import EVENTS, SEEDS, Scorer, aimed, grammar, learn, toxicity


def run(classes):
    machine, out = grammar(), []
    state = machine.start
    for c in classes:
        state, event, weight = machine.step(state, c)
        if event in EVENTS:
            out.append((event, round(weight, 3)))
    return out


def test_composed_grammar():
    assert run(["insult"]) == [("insult", 0.0)]
    assert run(["negation", "other", "insult"]) == [("insult-not", -0.5)]
    assert run(["negation", "other", "other", "other", "insult"]) == [("insult", 0.0)]
    assert run(["report", "other", "insult"]) == [("insult-said", -0.3)]
    assert run(["target", "report", "negation", "threat"]) == [("threat-not-said-at", -0.5)]
    assert run(["target", "insult", "threat"]) == [("insult-at", 0.3), ("threat-at", 0.3)]


def test_targets_may_follow_and_breaks_end_a_reach():
    machine, out = aimed(), []
    state = machine.start
    for c in reversed(["insult", "other", "insult-not-said", "target", "threat"]):
        state, event, weight = machine.step(state, c)
        out.append((event, weight))
    assert out[::-1] == [("insult-at", 0.3), ("other", 0.0), ("insult-not-said-at", 0.3), ("target", 0.0), ("threat", 0.0)]
    assert run(["report", "break", "insult"]) == [("insult", 0.0)] and run(["negation", "break", "threat"]) == [("threat", 0.0)]


def plain_score(model, text):
    """The grammar's rules applied to each insult and threat by itself."""
    kinds = {w: (k, 1.0) for k, ws in SEEDS.items() for w in ws.split()}
    kinds |= {w: ("insult", v) for w, v in model["lexicon"].items() if w[-1] != "*"}
    stems = {w[:-1]: v for w, v in model["lexicon"].items() if w[-1] == "*"}

    def kind(w):
        return kinds.get(w) or next((("insult", stems[w[:n]]) for n in sorted({len(x) for x in stems}) if len(w) >= n and w[:n] in stems), ("other", 0.0))

    sums = dict.fromkeys(EVENTS, 0.0)
    low = (text or "").lower()
    for clause in re.split(r"[.!?:;|\n]+", low):
        tokens = [kind(w) for w in re.findall(r"[^\W\d_]+|,", clause)]
        for i, (name, weight) in enumerate(tokens):
            if name not in ("insult", "threat"):
                continue
            start = max([k + 1 for k in range(i) if tokens[k][0] == "break"], default=0)
            before = [k for k, _ in tokens[start:i]]
            event = name
            if "negation" in before[-3:]:
                event, weight = event + "-not", weight - 0.5
            if "report" in before:
                event, weight = event + "-said", weight - 0.3
            if any(k == "target" for k, _ in tokens):
                event, weight = event + "-at", weight + 0.3
            sums[event] += max(weight, 0.1)
    total = sum(sums.values())
    x = [math.log1p(sums[e]) for e in EVENTS] + [math.log1p(total), float(any(sums[e] for e in EVENTS[:8])), 100 * total / (100 + len(re.findall(r"[^\W\d_]+", low)))]
    return 1 / (1 + math.exp(-max(-30, min(30, model["bias"] + sum(a * b for a, b in zip(model["beta"], x, strict=True))))))


def test_scores_against_plain_rules():
    rng = random.Random(9)
    model = learn([(t, y) for _, t, y in corpus(300)])
    words = [w for ws in SEEDS.values() for w in ws.split()] + list(model["lexicon"])[:40] + ["plain", "word", "x1", ".", "!", "\n", ";", "Grubbelish"]
    scorer = Scorer(model)
    for _ in range(400):
        text = " ".join(rng.choice(words).rstrip("*") for _ in range(rng.randrange(40)))
        assert abs(scorer.score(text) - plain_score(model, text)) < 1e-9, text
    assert abs(scorer.score(None) - plain_score(model, None)) < 1e-9


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnrst"]
    bad = ["grubbel", "snarkish", "snarkel", "snarkom"]
    rows = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            for _ in range(2):
                text.insert(rng.randint(0, 30), rng.choice(bad))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_learned_insults_and_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    scores = [sorted((r.doc_id, r.score) for r in toxicity(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")).collect()) for f in (lambda i, y: y, flip)]
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "you idiot", "c"), (3, "you idiot", "d"), (3, "you idiot", "d"), (4, "ok " * 100_000, "e")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity(docs, none)
    assert out.columns == ["doc_id", "text", "score", "held_out", "predicted"]
    got = out.collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.text == "you idiot"} == {1} and {r.predicted for r in got if r.text in (None, "")} == {0}
    assert toxicity(docs.limit(0), none).count() == 0
    assert learn([])["lexicon"] == {}


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hits, found, said = sum(r.toxic and r.predicted for r in got), sum(r.predicted for r in got), sum(r.toxic for r in got)
    assert hits >= 0.85 * said and hits >= 0.95 * found
