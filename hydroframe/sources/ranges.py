"""Byte ranges of files read on the executors from a table of ranges, and what needs a file's bytes but never its whole."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a file that are read at once, and bytes of content in one Arrow batch, about.
READ_BYTES, BATCH_BYTES = 8 << 20, 8 << 20
#: Bytes of a file whose ranges, by where they begin, one task reads.
SPAN_BYTES = 64 << 20
#: Bytes of a file's begin that a header walk reads at once.
PREFIX_BYTES = 4096
#: The extensible format's number, and the subformat by which it holds plain PCM.
EXTENSIBLE, PCM_GUID = 0xFFFE, bytes.fromhex("0100000000001000800000aa00389b71")


def open_file(path: str) -> pa.NativeFile:
    """A file of any store that Arrow opens (local or mounted, S3, GCS, HDFS), for reads at offsets."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path) if parts.scheme else path)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def read_ranges(ranges: DataFrame, name: str = "content", span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The rows of ``ranges`` (path, first_byte, n_bytes and any others) with the bytes they name, fewer at a file's end.

    Ranges are dealt out by spans of ``span_bytes`` of a file and read in order, one open file at a time. None of
    them passes through the driver. Ranges that overlap or repeat are read each for itself; without bytes,
    or with nulls, the content is empty.
    """
    columns = ranges.columns
    schema = StructType.fromJson(ranges.schema.jsonValue()).add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            held, size, begin = [], 0, 0
            for k, (own, first, count) in enumerate(zip(*(batch[c].to_pylist() for c in ("path", "first_byte", "n_bytes")), strict=True)):
                if own != path:
                    if file is not None:
                        file.close()
                    path, file = own, None if own is None else open_file(own)
                wanted = max(0, min(count or 0, file.size() - (first or 0))) if file is not None else 0
                held.append(file.read_at(wanted, first or 0) if wanted else b"")
                size += wanted
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], names=[*columns, name])
                    held, size, begin = [], 0, k + 1
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], names=[*columns, name])
        if file is not None:
            file.close()

    # a fixed number of tasks: Spark would join them by the size of the table, which says nothing of the bytes to be read
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartition(tasks, "path", F.floor(F.col("first_byte") / span_bytes)).sortWithinPartitions("path", "first_byte")
    return dealt.mapInArrow(run, schema)


def walk_header(read: Callable[[int, int], bytes], length: int) -> dict | None:
    """Fields of a WAV file's format chunk, and offset and bytes of its data chunk (none: null); nothing if it is no WAV file.

    ``read``: (offset, count) to bytes. Chunks before the data are stepped over by their sizes, those after it aren't read.
    """
    prefix = read(0, min(length, PREFIX_BYTES))

    def at(offset: int, count: int) -> bytes:
        if offset + count <= len(prefix):
            return prefix[offset : offset + count]
        return read(offset, max(0, min(count, length - offset)))

    if prefix[:4] != b"RIFF" or prefix[8:12] != b"WAVE":
        return None
    found: dict = dict.fromkeys(("format", "channels", "rate", "bits", "offset", "size"))
    number = lambda x: int.from_bytes(x, "little")
    where = 12
    while where + 8 <= length:
        head = at(where, 8)
        name, size = head[:4], number(head[4:])
        if name == b"fmt " and size >= 16:
            own = at(where + 8, min(size, 40))
            tag = number(own[:2])
            found |= {"format": 1 if tag == EXTENSIBLE and own[24:40] == PCM_GUID else tag, "channels": number(own[2:4]), "rate": number(own[4:8]), "bits": number(own[14:16])}
        elif name == b"data":
            return found | {"offset": where + 8, "size": size}
        where += 8 + size + size % 2  # a chunk of odd size is followed by a byte
    return found


HEADER = "path string, length long, format long, channels long, sample_rate_hz long, bits long, data_offset long, data_bytes long, riff boolean, sha256 string"


def file_headers(files: DataFrame, with_pcm: bool = False) -> DataFrame:
    """Header fields and SHA-256 of each file (path, length), each read once in blocks of ``READ_BYTES``.

    With ``with_pcm`` the data chunk of 16-bit mono files stands in ``pcm``, for clips that fit a row; other
    files, and all others' bytes, pass by.
    """
    schema = f"{HEADER}, pcm binary" if with_pcm else HEADER
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def one(path: str, length: int) -> dict:
        with open_file(path) as file:
            head = walk_header(lambda offset, count: file.read_at(count, offset), length)
            h = head or {}
            keep = with_pcm and h.get("offset") is not None and (h["channels"], h["format"], h["bits"]) == (1, 1, 16)
            digest, parts = hashlib.sha256(), []
            low, high = (h["offset"], h["offset"] + h["size"] // 2 * 2) if keep else (0, 0)
            for begin in range(0, length, READ_BYTES):
                block = file.read_at(min(READ_BYTES, length - begin), begin)
                digest.update(block)
                if begin < high and begin + len(block) > low:
                    parts.append(block[max(0, low - begin) : high - begin])
        row = {"path": path, "length": length, "format": h.get("format"), "channels": h.get("channels"), "sample_rate_hz": h.get("rate"), "bits": h.get("bits"), "data_offset": h.get("offset"), "data_bytes": h.get("size"), "riff": head is not None, "sha256": digest.hexdigest()}
        return row | ({"pcm": b"".join(parts) if keep else None} if with_pcm else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                held.append(one(path, length))
                size += len(held[-1].get("pcm") or b"") + 1000
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.select("path", "length").mapInArrow(run, schema)
