"""N-gram Jaccard join by rare-first prefix filtering.

Shingles get a global order, rare first: counts of hash buckets over all
documents (2**18 to 2**20 buckets, four for each document between) rank the buckets, and a shingle's key is its bucket's rank followed by
the rest of its hash, a bijection of the hash.  Texts of similarity t or more
share one of their first n - ceil(t n) + 1 keys, so only those are shuffled.
Length, positional and suffix filters prune what meets there.

A bucket of the prefix index first offers each member its pivot and a neighbour
only, which joins groups of copies in a number of pairs linear in their size.
All other pairs of a bucket are then met only if its members are not yet in one
component; each pair is verified once, on its whole texts.  Only texts that
stand in a candidate pair are moved: a filter of bits tells most others in the
pass that reads them, and a join the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, column, components, meet, unfold, with_row
from .counts import packed, summed
from .shingles import mix, shingle_sets, small_batches
from .sift import held_in, key_filter, may_hold

LEAST_BITS, MOST_BITS = 18, 20
#: Rows of one prefix key that a task takes; keys of larger hash buckets are salted.
SALT_ROWS = 200_000


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    low, high = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
    return int(low), int(high)


def _profile(words: int, bits: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        schema = pa.schema([*[(c, pa.int64()) for c in ("id", "n", "d1", "d2", *carried)], ("slice", pa.int32()), ("counts", pa.binary())])
        for batch in small_batches(batches):
            sets = shingle_sets(batch.column(1), words)
            for shingles in sets:  # distinct, but two may share a bucket
                np.add.at(counts, (shingles >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            digests = [_digest(s) for s in sets]
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), *batch.columns[2:], *none], schema=schema)
        parts = packed(counts)
        gone = [pa.nulls(len(parts), pa.int64())] * (4 + len(carried))
        yield pa.RecordBatch.from_arrays([*gone, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def ordered_keys(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The keys of a text's shingles in the global order."""
    bits = len(rank).bit_length() - 1
    rest = np.uint64(64 - bits)
    return np.sort((rank[(shingles >> rest).astype(np.int64)].astype(np.uint64) << rest) | (shingles & np.uint64((1 << (64 - bits)) - 1)))


def _prefixes(words: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rank, fans = shared.value
        rest = np.uint64(64 - (len(rank).bit_length() - 1))
        for batch in small_batches(batches):
            keys, classes, places = [], [], []
            for shingles in shingle_sets(batch.column(0), words):
                if not len(shingles) or (digest := _digest(shingles)) in seen:
                    continue
                seen.add(digest)
                n, low = len(shingles), digest[0]
                first = ordered_keys(shingles, rank)[: n + (-n * percent) // 100 + 1]
                keys.append(first)
                classes.append(np.full(len(first), low, np.int64))
                places.append((np.int64(n) << np.int64(32)) + np.arange(len(first), dtype=np.int64))
            if keys:
                keys, classes = np.concatenate(keys), np.concatenate(classes)
                fan = fans[(keys >> rest).astype(np.int64)].astype(np.uint64)
                salt = (mix(classes.view(np.uint64)) % fan).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt), pa.array((fan > 1)), pa.array(classes), pa.array(np.concatenate(places))], names=["key", "salt", "salted", "cls", "place"])

    return run


def _suffix_bound(a: np.ndarray, b: np.ndarray, parts: int = 64) -> int:
    """At most how many shingles the two sets share, from their counts in ranges of the hash."""
    shift = np.uint64(64 - parts.bit_length() + 1)
    count = [np.bincount((x >> shift).astype(np.int64), minlength=parts) for x in (a, b)]
    return int(np.minimum(*count).sum())


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            a, b = (shingle_sets(batch.column(k), words) for k in ("ta", "tb"))
            good = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(a, b, strict=True)):
                both = len(x) + len(y)
                if (100 + percent) * _suffix_bound(x, y) >= percent * both:
                    good[k] = (100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) >= percent * both
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    return run


def _wanted_texts(words: int, shared, bits: int):
    """(key, text) rows -> digests and texts of those whose key is in the filter, each text once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small_batches(batches):
            texts = batch.column(1).filter(pa.array(held_in(batch.column(0).to_numpy(zero_copy_only=False), shared.value, bits)))
            found = [_digest(s) for s in shingle_sets(texts, words)]
            take = [k for k, d in enumerate(found) if not (d in seen or seen.add(d))]
            yield pa.RecordBatch.from_arrays([*[pa.array([found[k][c] for k in take], pa.int64()) for c in (0, 1)], texts.take(pa.array(take, pa.int64()))], names=["d1", "d2", "text"])

    return run


def _close(na: Column, ia: Column, nb: Column, ib: Column, percent: int) -> Column:
    """Length and positional filter for two texts whose first common key stands at ia and ib."""
    fits = F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)
    return fits & (F.lit(100 + percent) * (1 + F.least(na - ia, nb - ib) - 1) >= F.lit(percent) * (na + nb))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Group the documents whose sets of `words`-word shingles are `percent` per cent similar or more.

    Returns one row per input row: id, n_shingles, class (hex digest of the
    shingle set), n_links and component_id (smallest id reachable).  n_links
    counts the links of its class with other classes that were verified: they
    span its component; pairs that are in one component already are not verified
    again, for a group of m near copies has m * m / 2 of them.
    A text of fewer words has one shingle, its whole sequence; an empty or null
    text has none and links with nothing, not even its like.  Ids have to be
    integers, or strings of them, and may be null or repeat: rows are compared
    by text, and the smallest id that is not null names a component.  Other
    columns play no part; an empty table gives an empty table.
    """
    out = _grouped(docs, id_col, text_col, words, percent)
    name = F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), name.alias("class"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, **carried: Column) -> DataFrame:
    """id, n, d1, d2, the `carried` longs, links, component and label (the component's own key, whatever its ids) of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    more = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"), *[c.alias(k) for k, c in carried.items()])
    kind = "".join(f"{k} long, " for k in ("id", "n", "d1", "d2", *carried))
    bits = min(max(LEAST_BITS, docs.count().bit_length() + 2), MOST_BITS)
    profile = scratch.put(more.mapInArrow(_profile(words, bits, list(carried)), f"{kind}slice int, counts binary"), "profile")
    total = summed(profile.where("slice is not null").select("slice", "counts"), 1 << bits)
    rank = np.empty(1 << bits, np.uint32)
    rank[np.argsort(total, kind="stable")] = np.arange(1 << bits, dtype=np.uint32)
    spread = 4 * int(np.median(total)) + SALT_ROWS
    fans = np.ones(1 << bits, np.uint32)
    fans[rank.astype(np.int64)] = np.minimum(total // spread + 1, 1 << 20).astype(np.uint32)
    members = profile.where("slice is null").select("id", "n", "d1", "d2", *carried)

    prefixes = rows.select("text").mapInArrow(_prefixes(words, percent, spark.sparkContext.broadcast((rank, fans))), "key long, salt int, salted boolean, cls long, place long")
    met = Window.partitionBy("key", "salt")
    held = prefixes.withColumns({"low": F.min("cls").over(met), "high": F.max("cls").over(met), "size": F.count("*").over(met)})
    held = held.where((F.col("low") != F.col("high")) | F.col("salted")).drop("low", "high")
    shared = scratch.put(held, "shared")
    # a text near the middle of a group of copies shares most prefix keys with most of them: it is the pivot
    weights = shared.groupBy("cls").agg(F.sum("size").alias("weight"))
    line = met.orderBy(F.xxhash64("cls", F.pmod("key", F.lit(4))), "cls")
    best = met.orderBy(F.col("weight").desc(), "cls")
    index = shared.drop("size").join(weights, "cls").withColumns({"near": F.lag(F.struct("cls", "place")).over(line), "pivot": F.first(F.struct("weight", "cls", "place")).over(best)})
    index = scratch.put(index.drop("weight"), "index")
    scratch.drop("shared")

    def split(place: Column) -> tuple[Column, Column]:
        return F.shiftright(place, 32), place.bitwiseAND(F.lit(0xFFFFFFFF))

    def pairs(df: DataFrame, other: Column) -> DataFrame:
        near = _close(*split(F.col("place")), *split(other["place"]), percent)
        return df.where((F.col("cls") != other["cls"]) & near).select(F.least("cls", other["cls"]).alias("a"), F.greatest("cls", other["cls"]).alias("b"))

    tops = index.where("salted").groupBy("key", "salt").agg(F.first("pivot").alias("p")).groupBy("key").agg(F.max("p").alias("top"))
    salted = index.where("salted").join(tops, "key").select("cls", "place", "top")
    offered = pairs(index, F.col("near")).union(pairs(index, F.col("pivot"))).union(pairs(salted, F.col("top")))
    first = scratch.put(offered.distinct(), "first")

    reps = scratch.put(members.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "reps")

    def verified(candidates: DataFrame, name: str) -> DataFrame:
        """The links among candidates (a, b): the texts of their ends are fetched and each pair is judged once."""
        ends = candidates.select(F.explode(F.array("a", "b")).alias("d1")).distinct()
        ends = scratch.put(reps.join(ends, "d1", "left_semi").select("d1", "d2", "rep"), f"ends-{name}")
        bitmap, bits = key_filter(ends.select(F.xxhash64("rep")), ends.count())
        found = rows.select(F.xxhash64("id"), "text").mapInArrow(_wanted_texts(words, spark.sparkContext.broadcast(bitmap), bits), "d1 long, d2 long, text string")
        texts = found.join(ends.select("d1", "d2"), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
        texts = scratch.put(texts, f"texts-{name}")

        def end(c: str) -> DataFrame:
            return texts.select(F.col("d1").alias(f"{c}1"), F.struct("d1", "d2").alias(c), F.col("text").alias(f"t{c}"))

        ready = candidates.withColumnsRenamed({"a": "a1", "b": "b1"}).join(end("a"), "a1").join(end("b"), "b1").select("a", "b", "ta", "tb")
        kind = "struct<d1:bigint,d2:bigint>"
        out = scratch.put(ready.mapInArrow(_verify(words, percent), f"a {kind}, b {kind}"), name)
        scratch.drop(f"ends-{name}", f"texts-{name}")
        return out

    links = verified(first, "links-1")
    labels = components(links, scratch, "cc-1")
    known = labels.select(F.col("node.d1").alias("cls"), F.col("label.d1").alias("of"))
    placed = index.select("key", "cls", "place").distinct().join(known, "cls", "left").withColumn("of", F.coalesce("of", "cls"))
    placed = scratch.put(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("key")
    open_rows = placed.join(mixed, "key", "left_semi")
    a, b = (open_rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "place", "of")]) for s in "ab")
    near = _close(*split(F.col("place_a")), *split(F.col("place_b")), percent)
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("cls_a") < F.col("cls_b")) & (F.col("of_a") != F.col("of_b")) & near)
    rest = scratch.put(rest.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    scratch.drop("placed")
    if not rest.isEmpty() and not (more_links := verified(rest, "links-2")).isEmpty():
        links = links.union(more_links)
        labels = components(links, scratch, "cc-2")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    nodes = labels.join(degree, "node", "left").select("node.*", "label", F.col("count").alias("links"))
    classes = reps.withColumnRenamed("rep", "least").join(nodes, ["d1", "d2"], "left")
    classes = classes.withColumn("label", F.coalesce("label", F.struct("d1", "d2")))
    least = classes.groupBy("label").agg(F.min("least").alias("component"))
    classes = scratch.put(classes.join(least, "label").select("d1", "d2", "rows", "links", "component", "label"), "classes")
    scratch.drop("index", "first", "rest", "reps", "links-1", "links-2")
    return meet(members, classes, ["d1", "d2"], "rows", "left")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows, one of each group of near copies: the row of the smallest id.

    Rows without words all stay; of rows alike in id and text one stays, as of
    other copies.  Rows that share an id, or have none, are told apart by their
    texts; a group whose ids are all null keeps one row.
    """
    def key(text: Column) -> dict[str, Column]:
        return {"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit(1), text)}

    spark = docs.sparkSession
    scratch = Scratch(spark, "one-each")
    found = _grouped(docs, id_col, text_col, words, percent, **key(column(text_col))).where("n > 0").select("id", "__t1", "__t2", "label")
    found = scratch.put(found, "found")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__t1", "__t2"))
    groups = scratch.put(found.groupBy("label").agg(least.alias("m"), F.count("*").alias("size")), "groups")
    sized = scratch.put(meet(found, groups.select("label", "size", F.col("size").alias("rows")), ["label"], "rows").drop("label"), "sized")
    # a text stands in a group of several rows or in none; the filter lets few rows of the others through to the join
    several = sized.where("size > 1").select("__t1")
    maybe = may_hold(several, F.col("__t1"), several.count())
    ends = [F.col(c).alias(n) for c, n in (("id", "i"), ("__t1", "t1"), ("__t2", "t2"))]
    chosen = groups.where("size > 1").select("m.*").select(*ends).union(sized.where("size = 1").where(maybe).select(*ends))
    rows = with_row(docs, __id=id_col, __text=text_col).withColumns(key(F.col("__text")))
    bare = F.coalesce(F.btrim("__text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    met = F.col("__id").cast("long").eqNullSafe(F.col("i")) & (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2"))
    rows = rows.withColumn("__maybe", maybe & ~bare)
    stay = rows.where("__maybe").join(chosen.hint("shuffle_hash"), met, "left_semi").dropDuplicates(["__id", "__t1", "__t2"])
    return unfold(rows.where("not __maybe"), docs.columns).unionByName(unfold(stay, docs.columns))
