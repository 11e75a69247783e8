import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm.common import Scratch
from quern.llm.mixing import mix
from quern.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """documents, then what each stage made of it, as rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, scratch, out = docs.columns, Scratch(spark, "test"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.put(stage(spark, out[-1], FOLDER), str(k)))
        assert k == 4 or out[-1].columns == columns
    return out


def test_toxic_documents_go(spark, stages):
    toxic, clean = ({r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where(f"toxic = {y}").collect()} for y in (1, 0))
    kept = {r.doc_id for r in stages[1].collect()}
    assert clean <= kept and len(toxic & kept) < len(toxic)


def test_lines_against_plain_dedup(stages):
    def key(line):
        return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    before = {r.doc_id: r.text or "" for r in stages[1].collect()}
    owner = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            owner.setdefault(key(line), i)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in before.items()}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_copies_against_plain_groups(stages):
    sets = {}
    for r in stages[2].collect():
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i in sets if not sets[i] or label[i] == i)


def test_mix_and_packing_against_plain_counts(spark, stages):
    taken = Counter({r.doc_id: r.taken for r in mix(stages[3]).collect()})
    rows = stages[4].collect()
    held = Counter()
    for r in rows:
        held[r.doc_id] += len(re.findall(r"[^ \t-\r]+", r.text))
    assert held == +taken and all(r.n_chars == len(r.text) for r in rows)
    tokenizer = Tokenizer.from_file(vocabulary())
    lengths = Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in rows)
    pieces = stages[5].collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == lengths
    assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in lengths.items())
    ends = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert ends.get(p.sequence_id, 0) == p.offset
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))


def test_run_is_the_stages_in_a_row(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, stages[5].collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, predicted string, n_lines string, score string, rank int, `a b` string"


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    text = "a line that is long enough\nand a second line of the text"
    rows = [(1, text, "en", "s", 0, "p", "n", "z", 7, "x"), (1, text, "en", "s", 0, "p", "n", "z", 7, "x"), (None, None, None, None, None, None, None, None, None, None), (None, "no id but words, five of them", None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "q", "m", "y", 8, "w"), (3, text.upper(), "en", "t", 0, "r", "l", "v", 9, "u"), (4, "w " * 30_000, "de", "t", 60_000, "r", "l", "v", 9, "u")]
    function = corpus_pipeline.STAGES[stage][1]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = function(spark, docs, FOLDER)
    held = got.collect()
    empty = function(spark, docs.limit(0), FOLDER)
    assert empty.count() == 0 and empty.columns == got.columns
    if stage == 4:
        assert sum(p.doc_id is None for p in held) == 2 and sum(p.doc_id == 1 for p in held) == 2
        return
    assert got.columns == docs.columns
    extra = {(r.doc_id, r.predicted, r.n_lines, r.score, r["rank"], r["a b"]) for r in held}
    assert extra <= {(r[0], r[5], r[6], r[7], r[8], r[9]) for r in rows}
    ids = sorted(str(r.doc_id) for r in held)
    if stage in (0, 1):
        assert ids == ["1", "1", "2", "3", "4", "None", "None"]
    if stage == 1:
        assert [r.text for r in held if r.doc_id in (2, 3)] == ["", ""]
    if stage == 2:
        assert ids == ["1", "2", "4", "None", "None"]
    if stage == 3:
        assert "2" not in ids and all(r.text for r in held)
