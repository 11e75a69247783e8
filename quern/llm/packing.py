"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents are cut at multiples of the sequence length; the pieces' lengths are
counted, patterns of lengths are built on the driver from those counts alone
(as many as there are lengths), and pieces join the patterns by their rank among
the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, column
from .shingles import settle

MARK = "<|startoftext|>"
#: ASCII characters that are neither letters, digits nor white space; without the apostrophe, which begins tokens of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer that keeps the ids of words it has met, in two generations of at most `most` words.

    The vocabulary drops white space and splits at it, so a text's ids are those
    of its words in a row.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.mark = self.tokenizer.token_to_id(MARK)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:  # the same model without the steps that leave a lower-case word of letters as it is
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of all words into the young generation.

        Words of letters, and those before a run of marks, are told apart by the
        tokens that end a word; others by a special token between them.
        """
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old, plain, odd, tails = self.young, self.old, set(), [], []
        for w in words.difference(young):
            if w in old:
                young[w] = old[w]
            elif "<|" in w or self.mark is None:
                young[w] = self.ids(w)
            elif not self.letters or not (base := w.rstrip(MARKS)).isalpha() or not base.islower() or not (base.isascii() or max(base) < "\u0250"):
                odd.append(w)
            elif base == w:
                plain.add(w)
            else:
                tails.append((w, base, w[len(base) :]))
        plain.update(base for _, base, _ in tails if base not in young)
        odd += {tail for _, _, tail in tails}.difference(young, odd)
        self._learn(self.letters, list(plain), " ")
        self._learn(self.tokenizer, odd, MARK)
        young.update((w, young[base] + young[tail]) for w, base, tail in tails)

    def _learn(self, tokenizer, words: list[str], between: str) -> None:
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            found = np.array(tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            if between == MARK:
                cuts = np.flatnonzero(found == self.mark)
                lows, highs = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(found)]
            else:
                highs = (np.flatnonzero(self.ends[found]) + 1).tolist()
                lows = [0, *highs[:-1]]
            data = found.tobytes()
            self.young.update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, lows, highs, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [_words(t) for t in texts]
        self.learn(set().union(*split))
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _words(text: str) -> list[str]:
    """Words between white space, lower-cased where that is sure to be what the vocabulary's own rules would do.

    Those compose characters, then lower-case each by itself: a text that is
    composed before and after lower-casing, without a sigma or special token,
    gives the same.  str.split also splits at 0x1C-0x1F, which the vocabulary
    holds as characters.
    """
    if "<|" not in text and "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low := text.lower()):
        text = low
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in text.translate(_ODD).split(" ") if w]
    return text.split()


_ODD = {k: " " for k in range(9, 14)}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), codec.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += last
                    n = len(ids) // 4
                    rows += [(key, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])
        codec.old = {}  # a worker keeps one generation for its next task
        settle()

    return run


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many packs, their lengths) from counts of lengths: longest first, each to the emptiest packs it fits in.

    Where none has room, new packs take as many pieces of the length as fit.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max((r for r in open_packs if open_packs[r]), default=0)
        while left:
            if room < length:
                each = size // length
                for count, held in ((left // each, each), (1, left % each)):
                    if count and held:
                        open_packs[size - held * length].append((count, [length] * held))
                break
            while left and open_packs[room]:
                count, pack = open_packs[room].pop()
                used = min(count, left)
                if count > used:
                    open_packs[room].append((count - used, pack))
                open_packs[room - length].append((used, [*pack, length]))
                left -= used
            room = max((r for r in open_packs if open_packs[r]), default=0)
    return [x for r in sorted(open_packs) for x in open_packs[r]]


def pattern_rows(packs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, pieces of the length in a sequence, offset of the first) of each pattern and length."""
    taken: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for count, pack in packs:
        at = 0
        for length in sorted(set(pack), reverse=True):
            each = pack.count(length)
            out.append((length, taken[length], taken[length] + count * each, base, each, at))
            taken[length] += count * each
            at += each * length
        base += count
    return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end: int = 1, rows_a_part: int = 100_000) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the vocabulary file, then the id `end`; it is cut
    every `size` ids.  Pieces of `size` fill sequences of their own, the others
    are packed.  Null counts as an empty text, whose one id is `end`.  Repeated
    rows are packed as often as they stand; ids may be null, and have to be
    integers or strings of them; other columns play no part; an empty table
    gives an empty table.  Ranks within a length are counted in parts of about
    `rows_a_part` pieces, 64 at least, so pieces of one length fill no task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    pieces = rows.mapInArrow(_pieces(vocabulary, size, end), "id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = scratch.put(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    table = pattern_rows(shortest_pack_first(histogram, size))
    patterns = spark.createDataFrame(table, "length long, low long, high long, base long, each long, at long")

    parts = max(64, sum(histogram.values()) // rows_a_part)
    h = F.xxhash64("id", "start", "ids_crc32")
    pieces = pieces.withColumns({"h": h, "part": F.pmod(h, F.lit(parts))})
    held = pieces.groupBy("length", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("length", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("h", "id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(held, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    met = ranked.join(F.broadcast(patterns), "length").where("low <= rank and rank < high")  # a few rows a length
    turn = F.col("rank") - F.col("low")
    return met.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(turn / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + turn % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
