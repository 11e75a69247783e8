import random
import re
from collections import Counter

from quern.llm.quality import clean_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def same(docs):
    got = clean_lines(docs).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id
        assert not (r.base_failed and r.kept)
    return got


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in same(spark.read.parquet(f"{folder}/documents.parquet"))}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    assert all(r.kept for r in good if not r.base_failed)
    assert not any(got[r.doc_id].kept for r in labels if r.quality == 0)


def test_odd_rows_and_line_rules(spark):
    plain = " ".join(f"word{k} and{k} more, then{k}." for k in range(30))
    rows = [(1, None), (2, ""), (3, "a b c a b c"), (4, "x\n\nx\n \nx"), (5, "é# " * 60_000), (6, plain), (6, plain), (None, plain), (7, f"{plain}\nHome | News | About | Contact | Help\nread more of our privacy policy"), (8, "BUY!! " * 200 + plain)]
    got = same(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ls int"))
    by = {r.doc_id: r for r in got}
    assert by[6].kept and by[None].kept and by[7].kept and not by[8].kept
    assert by[7].n_failed_lines == 2 and by[7].cleaned == plain and by[1].cleaned == ""
    assert clean_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lines_are_not_judged_by_their_length(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(1500)]
    prose = " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(1500)], k=6000)) + "."
    passage = " ".join(f"p{k}" for k in range(90)) + ". "
    rows = [(1, prose), (2, "buy it now. " * 500), (3, passage * 40), (4, f"{prose}\n{passage * 10}")]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(prose.split())) * 3 <= 6000 and not got[1].base_failed
    assert got[1].kept and got[1].cleaned == prose and got[1].n_failed_lines == 0
    assert got[2].n_failed_lines == 1 and got[3].n_failed_lines == 1
    assert got[4].n_failed_lines == 1 and got[4].cleaned == prose and got[4].kept
