"""Token ids packed into rows of fixed length by best-fit decreasing.

Texts are tokenised with a public vocabulary, overlong ones cut into pieces (nothing is lost), and pieces dealt by a
hash to shards of bounded size. In each shard pieces go, longest first, to the fullest row that still
has room; a segment tree over free capacities finds it. Each row of the result is a row of an id matrix with its
cumulative segment lengths and the places where positions start again from 0.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_texts, table

#: How the vocabulary's texts are cut before merging (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary is, tokens of a row, the id that fills rows up (no text has it), and bytes of text for a shard.
VOCABULARY, ROW, FILL, SHARD_BYTES = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 2048, 50256, 4 << 20


def tokenizer(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_pieces(docs: DataFrame, row: int = ROW, path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, again, piece, offset (in tokens), n, ids (uint16, little-endian): at most `row` tokens each.

    Null and empty texts have no piece; repeated rows have theirs each, and again counts those that a task has met before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        met: dict[bytes, int] = {}
        for batch in batches:
            owner, offset, ids, again = [], [], [], []
            for i, (key, text) in enumerate(zip(batch.column(0), batch.column(1))):
                text = text.as_py() or ""
                own = np.array(encode(text), dtype="<u2")
                same = hashlib.blake2b(repr((key.as_py(), text)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                met[same] = met.get(same, -1) + 1
                for at in range(0, len(own), row):
                    again.append(met[same])
                    owner.append(i)
                    offset.append(at)
                    ids.append(own[at : at + row].tobytes())
            at = np.array(offset, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(again, pa.int64()), pa.array((at // row).astype(np.int32)), pa.array(at), pa.array([len(x) // 2 for x in ids], pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "again", "piece", "offset", "n", "ids"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, again bigint, piece int, offset bigint, n int, ids binary")


class Capacities:
    """How many rows have each free capacity, in a segment tree; `least(n)` is the smallest capacity of n or more."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += count
            at >>= 1

    def least(self, n: int) -> int:
        """-1 where no row has so much room."""
        at, tree = n + self.leaves, self.tree
        if tree[at]:
            return n
        while at > 1 and (at & 1 or not tree[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(sizes: list[int], row: int) -> list[int]:
    """The row of each piece; sizes run from the longest down and are at most `row`."""
    free, open_rows, out, rows = Capacities(row), [[] for _ in range(row + 1)], [], 0
    for n in sizes:
        room = free.least(n)
        if room < 0:
            number, room, rows = rows, row, rows + 1
        else:
            number = open_rows[room].pop()
            free.add(room, -1)
        out.append(number)
        if room > n:
            open_rows[room - n].append(number)
            free.add(room - n, 1)
    return out


def pack_tokens(docs: DataFrame, row: int = ROW, path: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs(doc_id, text) -> shard, row, n_tokens, ids, cu_seqlens, position_resets, segments.

    ids is a row of the shard's id matrix: `row` uint16 numbers, little-endian, filled up with FILL after n_tokens. cu_seqlens
    has 0 and each segment's end, position_resets each segment's start, segments its doc_id, piece, offset in the document
    and tokens. The number of shards follows from the bytes of all texts; repeated rows are spread over shards. An empty table, or one of empty texts, has no row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    schema = f"shard bigint, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, segments array<struct<doc_id: {kind}, piece: int, offset: bigint, n: int>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pack(x: pa.Table) -> pa.Table:
        # Ids stay what they are: in pandas a null would turn the others into doubles.
        pieces = sorted(x.to_pylist(), key=lambda p: (-p["n"], p["doc_id"] is None, p["doc_id"] or 0, p["piece"], p["ids"]))
        members: dict[int, list] = {}
        for number, piece in zip(best_fit([p["n"] for p in pieces], row), pieces):
            members.setdefault(number, []).append(piece)
        out = []
        for number, own in members.items():
            ids = b"".join(p["ids"] for p in own)
            ends = np.cumsum([0] + [p["n"] for p in own]).tolist()
            segments = [{c: p[c] for c in ("doc_id", "piece", "offset", "n")} for p in own]
            fill = np.full(row - ends[-1], FILL, dtype="<u2").tobytes()
            out.append({"shard": own[0]["shard"], "row": number, "n_tokens": ends[-1], "ids": ids + fill, "cu_seqlens": ends, "position_resets": ends[:-1], "segments": segments})
        return pa.Table.from_pylist(out, arrow)

    pieces = token_pieces(docs, row, path).withColumn("shard", F.pmod(F.xxhash64("doc_id", "again", "piece", "ids"), F.lit(shards)))
    return pieces.groupBy("shard").applyInArrow(pack, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
