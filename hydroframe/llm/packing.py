"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of the rest. Pieces of one length form a bucket, a piece is a sequence of its
own, and so no sequence crosses documents or holds padding.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm.shared import bounded_batches, portions, table, text_of

LONGEST = 4096
END_ID = 2
#: Words, and pieces of words, whose ids a task remembers, and the longest that it does.
CACHED_WORDS, CACHED_CHARS = 200_000, 40

# The normalizer and pre-tokenizer of the tokenizers that are run word by word.
PARTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Words of printable ASCII and Latin-1 letters, which are their own NFC, and the same split among them.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
LETTER = r"a-z\u00df-\u00f6\u00f8-\u00ff"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")
#: A full stop or comma that ends a word after what is neither a plain letter nor a digit, and so may belong to it.
MARKS = re.compile(r"[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff \n][.,](?=[ \n])")
#: The character by which byte-level models name each byte: its own if it prints, else one from 256 on.
BYTE_NAMES = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE_NAMES |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTE_NAMES)}

_tokenizers: dict[str, tuple] = {}


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    A tokenizer whose normalizer and pre-tokenizer are PARTS never joins across blanks, so it gives a
    text the ids of its words in turn, and the ids of words are remembered. Texts are cut at spaces
    and line feeds alone; other blanks stay inside a piece. Words of Latin letters, digits and marks
    are cut by PIECE as the pre-tokenizer does, and their pieces go to the tokenizer's model; all
    other words go through the tokenizer. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.seen = Tokenizer.from_file(path), {"": b""}
        own = json.loads(self.tokenizer.to_str())
        self.by_word = (own["normalizer"], own["pre_tokenizer"]) == PARTS
        self.special = [t["content"] for t in own["added_tokens"]]
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        self.seen, self.pieces = {"": b""}, {}

    def _model(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            name = piece if piece.isascii() else "".join(map(BYTE_NAMES.__getitem__, piece.encode()))
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(name)]).tobytes()
            if len(piece) <= CACHED_CHARS:
                self.pieces[piece] = found
        return found

    def _encode(self, words: set[str]) -> dict[str, bytes]:
        out, rest = {}, []
        for w in words:
            if w.isalpha() and w.isascii():
                out[w] = self._model(w.lower())
            elif PLAIN.fullmatch(w) and not any(x in w for x in self.special):
                out[w] = b"".join(map(self._model, PIECE.findall(w.lower())))
            else:
                rest.append(w)
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                out[w] = array("I", e.ids).tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        split = [words_apart(t) for t in texts]
        if len(self.seen) > CACHED_WORDS:
            self.seen = {"": b""}
        if len(self.pieces) > CACHED_WORDS:
            self.pieces = {}
        seen = self.seen
        found = self._encode(set().union(*split).difference(seen))
        long = [w for w in found if len(w) > CACHED_CHARS]
        seen.update(found)
        out = [b"".join(map(seen.__getitem__, words)) for words in split]
        for w in long:
            del seen[w]
        return out


def words_apart(text: str) -> list[str]:
    """A text's pieces between spaces and line feeds; full stops and commas that end a word stand alone, if all of them follow plain letters or digits."""
    if not MARKS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return text.replace("\n", " ").split(" ")


def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document with n ids, longest first."""
    out = [longest] * (n // longest)
    rest, bit = n % longest, longest // 2
    while bit:
        if rest & bit:
            out.append(bit)
        bit //= 2
    return out


def pack(documents: DataFrame, tokenizer: str, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bucket, ids_crc32, doc_tokens, sequence_id, and ids.

    ``bucket`` is the length's binary logarithm. Each piece is a sequence; its number follows the
    task and the row in it, so it is the same when a task is run again. A null text counts as empty
    and has the end id alone. Rows that repeat are packed each for itself; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, stop in portions(texts):
                cols: list[list] = [[] for _ in range(8)]
                for doc, ids in zip(names[at:stop], coder.ids(texts.slice(at, stop - at).to_pylist()), strict=True):
                    ids += end
                    start = 0
                    for k, length in enumerate(pieces(len(ids) // 4, longest)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc, k, start, length, length.bit_length() - 1, crc32(own), len(ids) // 4, own if with_ids else None)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        start += length
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names_out = ["doc_id", "piece", "start", "length", "bucket", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names_out)
        coder.forget()  # the worker stays, and other tasks need its memory

    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInArrow(run, "doc_id long, piece long, start long, length long, bucket int, ids_crc32 long, doc_tokens long, ids binary")
    return out.withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences with a folder for each length, so that a batch can be filled from one bucket."""
    packed.select("sequence_id", "doc_id", "start", "length", "ids", "bucket").write.partitionBy("bucket").parquet(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), "bucket")
