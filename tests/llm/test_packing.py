import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.packing import Encoder, encoder, pack, pattern_rows, shortest_pack_first
from quern.llm.queries import vocabulary

ODD = "a Bé.,!'s\t\n\x1c\x85\xa0 Σσςİı́̌J漢字१2<|endoftext|>\U0001f600ǅﬁ"


def plain(text):
    return np.array(encoder(vocabulary()).tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet=ODD, max_size=30)), max_size=4))
def test_ids_are_the_tokenizers(texts):
    assert encoder(vocabulary()).encode(texts) == [plain(t) for t in texts]


def test_words_with_marks_case_and_special_tokens() -> None:
    texts = ["ªº abc,'s don't a'b x'' '' 's, ''s, A,B Éa, ÉCOLE, İx ǅ.", "a<|endoftext|>b x<| |> <|endoftext|> foo.<|startoftext|> \x1ca\x1d", "1a, a1. ... - ab-cd, é, ß ẞ ſ. end.... e\u0301, \u03a3 ,a", ""]
    few = Encoder(vocabulary(), most=3)
    for _ in range(2):
        for t in texts:
            assert few.encode([t]) == [plain(t)]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_packs_hold_every_piece_once(histogram):
    packs = shortest_pack_first(dict(histogram), 64)
    left = dict.fromkeys(histogram, 0)
    for count, lengths in packs:
        assert sum(lengths) <= 64 and count > 0
        for x in lengths:
            left[x] += count
    assert left == histogram
    assert sum(high - low for _, low, high, *_ in pattern_rows(packs)) == sum(histogram.values())


def test_a_hot_length_fills_its_packs() -> None:
    assert sum(count for count, _ in shortest_pack_first({300: 1000}, 2048)) == 167  # six fit in one
    assert sum(count for count, _ in shortest_pack_first({1: 5000}, 2048)) == 3
    spread = {k: 3 for k in range(1, 2049)}
    for hot in (100, 200, 300, 500):
        histogram = {**spread, hot: 3000}
        packs = shortest_pack_first(histogram, 2048)
        assert sum(k * n for k, n in histogram.items()) > 0.98 * 2048 * sum(count for count, _ in packs), hot
        assert sum(high - low for _, low, high, *_ in pattern_rows(packs)) == sum(histogram.values())


def check(rows, got, size):
    want = []
    for i, text in rows:
        ids = plain(text or "") + np.array([1], "<u4").tobytes()
        want += [(i, a, min(size, len(ids) // 4 - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), len(ids) // 4) for a in range(0, len(ids) // 4, size)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "null id"), (3, "word " * 9000), (4, "Some Words, and. more!"), (4, "Some Words, and. more!")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int")
    check(rows, pack(docs, vocabulary(), size=256).collect(), 256)
    assert pack(docs.limit(0), vocabulary()).count() == 0


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = pack(docs, vocabulary()).collect()
    n = check(rows, got, 2048)
    assert sum(r.length for r in got) > 0.97 * 2048 * (n - 1)
