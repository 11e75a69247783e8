import re
from itertools import combinations

from quern.llm.licenses import NOTICES, PHRASES, scan_licenses
from quern.llm.queries import op7_license_scan

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_supplied_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in op7_license_scan(spark, "/root/testdata/sf0.01").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_notices_and_odd_rows(spark):
    rows = [(k, f"Some filler é words, then: {text.upper()}. And more.") for k, (_, text, _) in enumerate(NOTICES)]
    rows += [(50, None), (51, ""), (52, "MIT-License mit license; CC BY 4.0 mit licenses"), (53, "mit license " * 30_000), (54, "permission is hereby granted free of nothing"), (55, "software copyright license to of the and files"), (None, "cc by"), (56, "cc by"), (56, "cc by"), (57, "M\u0130T l\u0130cense, MIT \u0130 License"), (58, "\u212a MIT LICENSE wor\u212a of ÉÀ Mit-\u03a3 license")]
    got = scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")).collect()
    by = {r.doc_id: r for r in got}
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text)
    for k, (label, text, _) in enumerate(NOTICES):
        assert [tuple(n) for n in by[k].notices] == [(label, 5)] and by[k].score > 0.99, label
    assert by[52].labels == "cc-by,mit" and by[54].labels == "" and by[55].labels == "" and by[50].score == 0
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_several_notices_in_a_text(spark):
    sets = [*combinations(range(len(NOTICES)), 2), tuple(range(len(NOTICES)))]
    rows = [(k, " filler. ".join(NOTICES[i][1] for i in held)) for k, held in enumerate(sets)]
    # a long text with the words of all the other notices, each once and out of order, and one notice in the middle
    for k, (_, text, _) in enumerate(NOTICES):
        others = " ".join(sorted({w for _, t, _ in NOTICES for w in t.split()} - set(text.split()), reverse=True))
        sets.append((k,))
        rows.append((len(rows), f"{others} {'filler ' * 3000} {text} {'filler ' * 3000} {others}"))
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = []
        words = r.text.replace(".", "").split()
        for label, text, _ in (NOTICES[i] for i in sets[r.doc_id]):
            parts = text.split()
            want += [(label, i) for i in range(len(words)) if words[i : i + len(parts)] == parts]
        assert sorted(tuple(n) for n in r.notices) == sorted(want), r.doc_id
        assert r.labels == ",".join(sorted({label for label, _ in want})) and r.score > 0.99
