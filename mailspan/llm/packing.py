"""Best-fit packing with bounded space: pieces arrive one after another, a fixed number of bins is open, a bitset
keyed by free space finds the tightest bin, and when too many are open the fullest closes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, table, written

SEQUENCE, END_ID = 1024, 2
#: Bins open at once, and pieces that one task packs at a time (both fixed bounds).
OPEN_BINS, BLOCK_PIECES = 512, 1 << 16
#: Chunks that are kept with their ids; then the store starts anew.
CACHED_CHUNKS = 400_000
#: White space of the tokenizer's pattern (Unicode's White_Space; fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Ids(dict):
    """Chunk -> its ids as little-endian 32-bit bytes. A text's ids are those of its chunks, each either white space or
    a run without white space and the one blank before it: the tokenizer's pattern never matches across these."""

    def __init__(self, json_path: str):
        import re

        import public_tokenizers
        import tiktoken

        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path, self.whole = json_path, None
        self.chunks = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        ids = self.encode(chunk)
        out = self[chunk] = b"".join(x.to_bytes(4, "little") for x in ids)
        return out

    def of(self, text: str) -> bytes:
        if "<|endoftext|>" in text:  # a special token of the vocabulary: left to the tokenizer itself
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return b"".join(x.to_bytes(4, "little") for x in self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, self.chunks(text)))


_IDS: dict[str, Ids] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids_crc32, ids (binary, 32-bit little-endian).

    A document is its text's ids and then `end_id`; null and empty texts are `end_id` alone. Longer ones than
    `length` are cut so that only the first piece is shorter.
    """
    arrow_batches(df.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(tokenizer) or _IDS.setdefault(tokenizer, Ids(tokenizer))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids.of(text or "") + last
                n = len(data) // 4
                at, piece, size = 0, 0, (n - 1) % length + 1
                while at < n:
                    part = data[4 * at : 4 * (at + size)]
                    for k, v in zip(out, (doc, piece, at, size, zlib.crc32(part), part), strict=True):
                        out[k].append(v)
                    at, piece, size = at + size, piece + 1, length
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("doc_id"), df[text_column].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(lengths: list[int], size: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """For each length in arrival order: its bin (numbered as opened) and its place there."""
    bits, free = 0, [[] for _ in range(size + 1)]  # free: bins by free space; bits: which lists have any
    bins, places, opened, n_open = [], [], 0, 0
    for x in lengths:
        fit = bits >> x
        if fit:
            f = x + (fit & -fit).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                bits &= ~(1 << f)
        else:
            if n_open == open_bins:  # the fullest closes
                f = (bits & -bits).bit_length() - 1
                free[f].pop()
                if not free[f]:
                    bits &= ~(1 << f)
                n_open -= 1
            b, f = opened, size
            opened, n_open = opened + 1, n_open + 1
        bins.append(b)
        places.append(size - f)
        if f == x:
            n_open -= 1
        else:
            free[f - x].append(b)
            bits |= 1 << (f - x)
    return bins, places


def pack(pieces: DataFrame, length: int = SEQUENCE, open_bins: int = OPEN_BINS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    Full pieces are sequences by themselves. The others are dealt into blocks of about `block_pieces` by a hash, and
    each block is packed online in hash order. Equal rows are packed each for itself; no pieces give no rows.
    """
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = pieces.select(*keep)
    rest = pieces.filter(F.col("length") < length)
    blocks = max(1, -(-rest.count() // block_pieces))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "start", "length", "ids_crc32"], kind="stable")
        bins, places = best_fit(pdf["length"].tolist(), length, open_bins)
        return pdf.assign(sequence_id=[(int(key[0]) << 32) + b for b in bins], offset=places).drop(columns=["h", "block"])

    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = rest.withColumn("h", h).withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("block").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # ids of the full pieces' sequences are negative, so that they never meet those of the blocks
    full = pieces.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack_documents(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    pieces = cut(df, tokenizer=tokenizer).drop("ids")
    return pack(written(pieces, "pieces"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
