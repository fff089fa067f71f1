import hashlib
import struct

from pyspark.sql import functions as F

from hydroframe.sources import ranges, recordings

SAMPLES = struct.pack("<10h", *range(1, 11))
PLAIN = struct.pack("<HHIIHH", 1, 1, 96_000, 192_000, 2, 16)
EXTENSIBLE = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 96_000, 192_000, 2, 16, 22, 16, 4) + bytes.fromhex("0100000000001000800000aa00389b71")


def wav(*chunks):
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


FILES = {
    "plain": wav((b"fmt ", PLAIN), (b"data", SAMPLES)),
    "list": wav((b"fmt ", PLAIN), (b"LIST", b"INFOx"), (b"fact", b"1234"), (b"data", SAMPLES)),
    "bext": wav((b"bext", b"data" * 151), (b"fmt ", PLAIN), (b"data", SAMPLES), (b"LIST", b"after")),
    "many": wav((b"fmt ", PLAIN), *[(b"junk", b"")] * 300, (b"data", SAMPLES)),
    "extensible": wav((b"fmt ", EXTENSIBLE), (b"data", SAMPLES)),
}
BAD = {"no_data": wav((b"fmt ", PLAIN), (b"LIST", b"INFO" * 9)), "no_format": wav((b"data", SAMPLES)), "float": wav((b"fmt ", b"\3" + PLAIN[1:]), (b"data", SAMPLES)), "short": b"RIFF"}


def test_chunks_before_the_data_are_walked_over(spark, tmp_path):
    for name, content in (FILES | BAD).items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    stem = lambda path: path.rsplit("/", 1)[1][:-4]
    catalog = {stem(r.path): r for r in recordings.recording_catalog(spark, str(tmp_path)).collect()}
    for name, content in FILES.items():
        r = catalog[name]
        assert (r.reason, r.sample_count, r.sample_rate_hz) == (None, 10, 96_000), r
        assert content[r.data_offset : r.data_offset + 20] == SAMPLES
    assert {k: catalog[k].reason for k in BAD} == {"no_data": "no data chunk", "no_format": "not a WAV file", "float": "not 16-bit PCM", "short": "not a WAV file"}
    bag = {stem(r.path): bytes(r.pcm) for r in recordings.clip_bag(spark, str(tmp_path)).collect()}
    assert bag == dict.fromkeys(FILES, SAMPLES)
    want = {(k, i): SAMPLES[8 * i : 8 * i + 8] for k in FILES for i in range(3)}
    chunks = {(stem(r.path), r.chunk_no): bytes(r.pcm) for r in recordings.pcm_chunks(spark, str(tmp_path), 4).collect()}
    assert {k: v for k, v in chunks.items() if k[0] in FILES} == want
    assert not any(k[0] in ("no_data", "short") for k in chunks)
    ranges = recordings.scan_pcm(spark, [(r.path, r.sample_count, r.data_offset) for k, r in catalog.items() if k in FILES], 4)
    assert {(stem(r.path), r.chunk_no): bytes(r.pcm) for r in ranges.collect()} == want


def test_a_hundred_thousand_ranges_of_one_file(spark, tmp_path):
    content = bytes(range(256)) * 4000
    (tmp_path / "a b.bin").write_bytes(content)
    wanted = spark.range(100_000).select(F.lit(str(tmp_path / "a b.bin")).alias("path"), (F.col("id") * 37 % 1_024_100).alias("first_byte"), (F.col("id") % 11).alias("n_bytes"), F.col("id").alias("own"))
    got = ranges.read_ranges(wanted, "bytes", span_bytes=1 << 16)
    assert got.columns == ["path", "first_byte", "n_bytes", "own", "bytes"]
    rows = got.select("own", "first_byte", "n_bytes", "bytes", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 100_000 and len({r.own for r in rows}) == 100_000
    assert all(bytes(r.bytes) == content[r.first_byte : r.first_byte + r.n_bytes] for r in rows)
    assert len({r.task for r in rows}) > 1
    assert ranges.read_ranges(wanted.where("false")).count() == 0


def test_a_sparse_file_over_two_gigabytes_is_catalogued_and_hashed(spark, tmp_path):
    size = (1 << 31) + 1_000_001
    path = tmp_path / "long.wav"
    with path.open("wb") as f:
        head = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", 16) + PLAIN + b"junk" + struct.pack("<I", 9001) + b"\0" * 9002
        f.write(head + b"data" + struct.pack("<I", size))
        at = f.tell()
        f.truncate(at + size)
        f.seek(at + 2 * 1_073_000_000)
        f.write(SAMPLES)
    want = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 24):
            want.update(block)
    (r,) = recordings.recording_catalog(spark, str(tmp_path)).collect()
    assert (r.reason, r.sample_count, r.data_offset, r.sha256) == (None, size // 2, at, want.hexdigest())
    asked = spark.createDataFrame([("x", 1_072_999_999, 1_073_000_010), ("x", 0, 3)], "recording_id string, first_sample long, stop_sample long")
    known = spark.createDataFrame([("x", r.path, at)], "recording_id string, path string, data_offset long")
    got = {x.first_sample: bytes(x.pcm) for x in recordings.read_samples(asked, known).collect()}
    assert got == {1_072_999_999: b"\0\0" + SAMPLES, 0: b"\0" * 6}
