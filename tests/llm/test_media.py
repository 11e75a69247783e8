import glob
import hashlib
import math
import tarfile
import zlib
from collections import Counter

import pytest

from quern.llm import media
from quern.llm.media import ArchiveReader, ByteRange, decode_image, describe, encode_image, media_columns, payload_of, read_archives, write_archives
from quern.workloads.queries import place

ROWS = [(1, None), (2, ""), (None, "null id"), (3, "é" * 40), (3, "é" * 40), (4, "x" * 64), (5, "long text \n" * 40_000), (6, "ustar\0" * 200)]


def test_image_round_trip():
    for _, text in ROWS:
        n, payload = payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
        image = encode_image(payload)
        assert decode_image(image).tobytes() == payload
        with pytest.raises(ValueError):
            decode_image(image[:40] + bytes([image[40] ^ 1]) + image[41:])


def test_columns(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, media int")
    got = sorted(media_columns(docs, split_bytes=1 << 16).collect(), key=str)
    want = []
    for i, text in ROWS:
        n, payload = payload_of(text)
        image = encode_image(payload)
        want.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert media_columns(docs.limit(0)).count() == 0


def test_features_against_plain_sums(spark):
    docs = spark.createDataFrame(ROWS[:6], "doc_id long, text string")
    got = {(r.n_bytes, r.payload_sha256): r.feature for r in media_columns(docs).collect()}
    for _, text in ROWS[:6]:
        n, payload = payload_of(text)
        size, count = len(payload), Counter(payload)
        mean = sum(payload) / size
        std = math.sqrt(sum((x - mean) ** 2 for x in payload) / size)
        entropy = -sum(c / size * math.log2(c / size) for c in count.values())
        steps = [abs(payload[k + 1] - payload[k]) for k in range(size - 1) if k % 64 != 63]
        want = [f"64x{size // 64}", mean, std, entropy, sum(steps) / len(steps)]
        found = got[n, hashlib.sha256(payload).hexdigest()].split(";")
        assert found[0] == want[0] and all(abs(float(x.split("=")[1]) - y) < 1e-4 for x, y in zip(found[1:], want[1:], strict=True))


def test_a_damaged_member_costs_no_other(spark):
    folder = place(spark, "archives")
    write_archives(spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").coalesce(1), folder)
    path = glob.glob(f"{folder}/*.tar")[0]
    with tarfile.open(path) as tar:
        hit = tar.getmembers()[7]
    with open(path, "r+b") as f:
        f.seek(hit.offset_data + 45)
        f.write(b"\xff\x00\xff")
    got = {r.id: r for r in describe(read_archives(spark, folder)).collect()}
    assert len(got) == 40 and [k for k, r in got.items() if r.error] == [7] and got[7].feature is None
    assert all(r.payload_sha256 == hashlib.sha256(payload_of(f"text {k}")[1]).hexdigest() for k, r in got.items() if k != 7)


def test_ranges_cover_each_member_once_and_archives_are_plain_tar(spark):
    rows = [(i, f"{i} " * (i % 400)) for i in range(1500)]
    folder = place(spark, "archives")
    assert write_archives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder) == 1500
    reader = ArchiveReader({"path": folder, "split_bytes": str(1 << 16), "batch_bytes": "20000"})
    names = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("member").to_pylist()]
    assert len(reader.partitions()) > 6 and sorted(int(n.split(".")[0]) for n in names) == list(range(1500))
    assert sorted(n for f in glob.glob(f"{folder}/*.tar") for n in tarfile.open(f).getnames()) == sorted(names)
    assert read_archives(spark, folder).count() == 1500


def test_member_is_read_again_by_its_offset(spark, monkeypatch):
    folder = place(spark, "archives")
    write_archives(spark.createDataFrame([(i, str(i)) for i in range(20)], "doc_id long, text string").coalesce(1), folder)
    fs, _ = media.place(folder)
    fails = []

    class Flaky:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            if at % 3072 == 0 and fails.count(at) < 2:
                fails.append(at)
                raise OSError("lost")
            return self.file.read_at(n, at)

    class Files:
        def open_input_file(self, path):
            return Flaky(fs.open_input_file(path))

        def open_input_stream(self, path):
            return fs.open_input_stream(path)

    part = ArchiveReader({"path": folder}).partitions()[0]
    monkeypatch.setattr(media, "place", lambda path: (Files(), path))
    reader = ArchiveReader({"path": folder, "retries": "2"})
    assert sum(b.num_rows for b in reader.read(ByteRange(part.archive, part.start, part.end))) == 20 and len(fails) > 4
    fails.clear()
    with pytest.raises(OSError, match="lost"):
        list(ArchiveReader({"path": folder, "retries": "1"}).read(part))
