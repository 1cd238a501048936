"""Training-order materialisation of token ids as binary shards.

Texts become token ids, end with an end-of-document id, and are packed into sequences of a
fixed number of tokens. A keyed permutation (a Feistel network with cycle-walking) gives
each of the N sequences a slot from 0 to N-1, so the training order is a shuffle of the
whole corpus that one key reproduces, with no sort by random numbers. Slots are dealt
into ranges, each range is sorted and written as one shard with a fixed stride, and a
reader finds any slot by a multiplication, so reading is sequential and resumes anywhere.

Numbers of sequences have to be known before slots can be given. Texts are therefore
encoded once, into a table of ids in the shared folder. One number for each partition of
that table goes to the driver, and the pass that packs it checks that it meets the same
numbers. The table and the sequences on their way to their shard are compressed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import scratch, settle, ship

_U = np.uint64
#: How the table of ids is written: it is read twice and is as large as the shards.
_SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def feistel(values: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The images of values under a permutation of 0..n-1 that the key chooses.

    The network permutes the numbers of an even count of bits, fewer than 4n; a value that
    leaves the range is sent through again until it is back, so the whole stays one to one.
    """
    if n < 2:
        return values.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]
    out = values.astype(_U)
    active = np.arange(len(out))
    while len(active):
        x = out[active]
        left, right = x >> _U(half), x & mask
        for k in keys:
            f = (right ^ _U(k)) * _U(0x9E3779B97F4A7C15)
            f = (f ^ (f >> _U(29))) * _U(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> _U(32)) & mask)
        out[active] = x = (left << _U(half)) | right
        active = active[x >= _U(n)]
    return out.astype(np.int64)


class Bytes:
    """UTF-8 bytes as token ids 0 to 255. The bytes 254 and 255 are in no UTF-8 text and mark padding and ends."""

    dtype, end, pad = "uint8", 255, 254

    @staticmethod
    def encode(texts: list[str | None]) -> list[bytes]:
        return [(t or "").encode() for t in texts]


class Ids:
    """Ids of a tokenizer file; the end of a document and padding are two ids behind its own."""

    def __init__(self, tokenizer: str) -> None:
        from lodestrata.llm.bpe import codec

        self.codec = codec(tokenizer)
        self.dtype = "uint16" if self.codec.size + 2 <= 1 << 16 else "uint32"
        self.end, self.pad = self.codec.size, self.codec.size + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [x.astype(self.dtype).tobytes() for x in self.codec.encode_all([t or "" for t in texts])]


def _tokens(tokenizer: str) -> Bytes | Ids:
    return Bytes() if tokenizer == "bytes" else Ids(tokenizer)


def materialise(docs: DataFrame, folder: str, key: int, tokenizer: str = "bytes", length: int = 2048, shard_sequences: int = 16_384) -> DataFrame:
    """Writes the shards; returns (shard, path, first_slot, sequences) of each.

    ``docs`` has doc_id and text and is read once. Within a partition of the encoded table
    documents follow each other in the sequences; the last one is padded. A record is the number of documents that begin in
    the sequence, the doc_id of the first token's document and the token's offset in it
    (8 bytes each, little-endian; a null id is the smallest number), and ``length`` ids.
    Null and empty texts are an end mark alone; repeated rows are written as often as they
    occur; extra columns aren't looked at. An empty table writes no shard.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _tokens(tokenizer)
        for batch in batches:
            ids = use.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    coded = settle(rows.mapInArrow(encoded, "doc_id long, ids binary"), "token-ids", _SMALL)
    width = np.dtype(_tokens(tokenizer).dtype).itemsize

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total += (pc.sum(pc.binary_length(batch.column("ids"))).as_py() or 0) // width + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-total // length)], pa.int64())], ["part", "n"])

    # 8 bytes for each partition of the table, of 128 MB usually: 8 MB for 128 TB
    sized = coded.mapInArrow(measured, "part int, n long").toArrow()
    counts = np.zeros(max(sized.column("part").to_numpy(), default=-1) + 1, np.int64)
    counts[sized.column("part").to_numpy()] = sized.column("n").to_numpy()
    begins = spark.sparkContext.broadcast(np.append(0, np.cumsum(counts)))
    total = int(counts.sum())
    shards = max(1, -(-total // shard_sequences))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, zstd = _tokens(tokenizer), pa.Codec("zstd", compression_level=3)
        part = TaskContext.get().partitionId()
        at, bound = begins.value[part : part + 2].tolist()
        end, size = np.array([use.end], use.dtype).tobytes(), length * width
        pending, begun, owner, offset = bytearray(), 0, None, 0
        heads, bodies = [], []

        def flush() -> pa.RecordBatch:
            nonlocal at, heads, bodies
            if at + len(bodies) > bound:
                raise ValueError("the encoded table changed between the two passes")
            slots = feistel(np.arange(at, at + len(bodies)), total, key)
            at += len(bodies)
            records = [zstd.compress(np.array(h, "<i8").tobytes() + b, asbytes=True) for h, b in zip(heads, bodies)]
            out = pa.RecordBatch.from_arrays([pa.array((slots // shard_sequences).astype(np.int32)), pa.array(slots), pa.array(records, pa.binary())], ["shard", "slot", "record"])
            heads, bodies = [], []
            return out

        def head() -> tuple[int, int, int]:
            return begun, -(1 << 63) if owner is None else owner, offset

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                data, used = ids + end, 0
                begun += 1
                if not pending:
                    owner, offset = doc, 0
                while used < len(data):
                    take = min(size - len(pending), len(data) - used)
                    if not pending and used:
                        owner, offset, begun = doc, used // width, 0
                    pending += data[used : used + take]
                    used += take
                    if len(pending) == size:
                        heads.append(head()), bodies.append(bytes(pending))
                        pending.clear()
                        begun = 0
                if len(bodies) * size > 8 << 20:
                    yield flush()
        if pending:
            pending += np.full((size - len(pending)) // width, use.pad, use.dtype).tobytes()
            heads.append(head()), bodies.append(bytes(pending))
        yield flush()
        if at != bound:
            raise ValueError("the encoded table changed between the two passes")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, shard, out = [], None, None
        zstd, stride = pa.Codec("zstd"), 24 + length * width
        for batch in batches:
            for number, slot, record in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "record"))):
                if number != shard:
                    if out is not None:
                        out.close()
                    shard, name = number, f"shard-{number:08d}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    done.append([number, f"{folder}/{name}", slot, 0])
                out.write(zstd.decompress(record, stride, asbytes=True))
                done[-1][3] += 1
        if out is not None:
            out.close()
        columns = list(zip(*done)) if done else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "first_slot", "sequences"])

    sent = coded.mapInArrow(packed, "shard int, slot long, record binary")
    # a shard is a range of slots and is written by one task; its size is fixed
    ranged = sent.repartitionById(min(shards, 100_000), "shard").sortWithinPartitions("slot")
    manifest = settle(ranged.mapInArrow(written, "shard int, path string, first_slot long, sequences long"), "shards")
    use = _tokens(tokenizer)
    meta = {"dtype": use.dtype, "length": length, "end": use.end, "pad": use.pad, "sequences": total, "shard_sequences": shard_sequences, "key": key}
    _put(spark, f"{folder}/meta-json", meta)
    return manifest


def _put(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(path)


def meta_of(spark: SparkSession, folder: str) -> dict:
    """What ``materialise`` noted about a folder."""
    return json.loads(spark.read.text(f"{folder}/meta-json").first()[0])


def read_shard(path: str, first_slot: int, sequences: int, meta: dict, from_slot: int = 0) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(slot, documents begun, doc_id, offset, ids) of a shard in order, from ``from_slot`` on.

    A reader that stopped goes on at the slot behind its last one, without reading what
    lies before it.
    """
    dtype = np.dtype(meta["dtype"])
    stride = 24 + meta["length"] * dtype.itemsize
    fs, name = pafs.FileSystem.from_uri(path)
    skip = max(0, from_slot - first_slot)
    with fs.open_input_file(name) as f:
        f.seek(skip * stride)
        for i in range(skip, sequences):
            record = f.read(stride)
            if len(record) != stride:
                raise ValueError(f"{path} ends within a record")
            begun, doc, offset = np.frombuffer(record, "<i8", 3).tolist()
            yield first_slot + i, begun, doc, offset, np.frombuffer(record, dtype, offset=24)


def read(manifest: DataFrame, meta: dict, from_slot: int = 0) -> DataFrame:
    """Reads shards back: (slot, shard, n_begun, doc_id, offset, n_tokens, ids_sha256), in slot order within a shard.

    ``n_tokens`` counts ids without padding, ends of documents included; the digest is that
    of the ids' bytes with padding.
    """
    ship(manifest.sparkSession)
    ddl = "slot long, shard int, n_begun long, doc_id long, offset long, n_tokens long, ids_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "first_slot", "sequences"))):
                rows = [
                    (slot, shard, begun, None if doc == -(1 << 63) else doc, offset, int((ids != meta["pad"]).sum()), hashlib.sha256(ids.tobytes()).hexdigest())
                    for slot, begun, doc, offset, ids in read_shard(path, first, n, meta, from_slot)
                ]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["slot", "shard", "n_begun", "doc_id", "offset", "n_tokens", "ids_sha256"])

    files = max(1, manifest.count())
    return manifest.where(F.col("first_slot") + F.col("sequences") > from_slot).repartition(min(files, 100_000), "shard").mapInArrow(run, ddl)


def written_documents(docs: DataFrame, key: int = 20240501, tokenizer: str = "bytes") -> DataFrame:
    """Writes all documents in training order and reads all sequences back."""
    folder = scratch(docs.sparkSession, "tokens")
    manifest = materialise(docs, folder, key, tokenizer)
    return read(manifest, meta_of(docs.sparkSession, folder))
