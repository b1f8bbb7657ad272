"""Token ids in length-delimited binary record files, with a separate offset index.

Layout of a record file (little-endian, the framing of public record formats):

    frame    u64 length | u32 masked CRC-32C of the length | payload | u32 masked CRC-32C of it
    block    a frame that opens it | frames of records | a frame of length 0 that closes it
    opening  u8 0 | u64 offset of the block in its file | u64 ids before it in its file
    record   u8 1 | i64 document id | u8 1 if there is an id | u8 bytes an id (2 or 4) | u32 ids | ids

Files are dealt out by ranges of the id, so part numbers follow the id and each file is sorted.
The index (Parquet: shard, offset, length, id, n_tokens, first, ids_crc32) lets a shuffled reader
seek to single records; it comes from one pass that reads the files back and checks every sum.

Spark's own text writer puts the blocks on disk, and its text reader cuts files of any size at the
closing frames (its "line separator"), so files go through the commit protocol to any file system,
are read in splits, and a lost executor costs a task.  A record whose ids happen to hold the bytes
of a closing frame is written with 4 bytes an id, which cannot.

The ids are shuffled as text before they are encoded, so that the range bounds are sampled from
the scan and not from encoded rows.  Copies of one row are spread by their place in the input.

Nulls: a null text is empty; a null id sorts first.  Empty texts hold the end id alone.
Repeated ids: in the order of the texts' hash, each a record of its own.  Very long texts make
one large frame.  Empty tables give no records.  Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import arrow_map, batch, shared_folder, texts_of
from .word_ids import width_of, word_encoder

_HEAD, _RECORD, _OPENING = struct.Struct("<Q"), struct.Struct("<BqBBI"), struct.Struct("<BQQ")
#: Least and most bytes of text a file (between the two, some files a core), bytes a block.
FILE_BYTES, BLOCK_BYTES = (24 << 20, 256 << 20), 1 << 20


# ---- checksums ---------------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
    return c


class Crc32c:
    """CRC-32C of many byte strings at once.

    A CRC without its start value is linear and ignores leading zeros: inputs are padded in front
    to whole blocks, each block is looked up position by position, and block values are combined
    by a table of "block of zeros" steps.
    """

    BLOCK = 256

    def __init__(self):
        one = self.one = _crc_table()
        at = np.empty((self.BLOCK, 256), np.uint32)
        at[-1] = one
        for i in range(self.BLOCK - 2, -1, -1):
            at[i] = (at[i + 1] >> 8) ^ one[at[i + 1] & 0xFF]
        self.at = at.ravel()
        self.base = (np.arange(self.BLOCK) * 256)[None, :]
        lanes = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        for k in range(4):
            for _ in range(self.BLOCK):
                lanes[k] = (lanes[k] >> 8) ^ one[lanes[k] & 0xFF]
        self.skip = [x.tolist() for x in lanes]

    def small(self, data: bytes) -> int:
        c, one = 0xFFFFFFFF, self.one
        for b in data:
            c = (c >> 8) ^ int(one[(c ^ b) & 0xFF])
        return c ^ 0xFFFFFFFF

    def many(self, items: list[bytes]) -> list[int]:
        out = [self.small(x) if len(x) < 4 else 0 for x in items]
        big = [i for i, x in enumerate(items) if len(x) >= 4]
        if not big:
            return out
        blocks = [-(-len(items[i]) // self.BLOCK) for i in big]
        data = np.zeros(sum(blocks) * self.BLOCK, np.uint8)
        end = 0
        for i, n in zip(big, blocks):
            end += n * self.BLOCK
            x = np.frombuffer(items[i], np.uint8)
            data[end - len(x) : end] = x
            data[end - len(x) : end - len(x) + 4] ^= 0xFF
        values = np.empty(sum(blocks), np.uint32)
        rows = data.reshape(-1, self.BLOCK)
        for a in range(0, len(rows), 1024):
            values[a : a + 1024] = np.bitwise_xor.reduce(self.at[self.base + rows[a : a + 1024]], axis=1)
        s0, s1, s2, s3 = self.skip
        at, v = 0, values.tolist()
        for i, n in zip(big, blocks):
            c = 0
            for x in v[at : at + n]:
                c = s0[c & 255] ^ s1[c >> 8 & 255] ^ s2[c >> 16 & 255] ^ s3[c >> 24] ^ x
            at += n
            out[i] = c ^ 0xFFFFFFFF
        return out


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class Framer:
    def __init__(self):
        self.crc = Crc32c()
        self.heads: dict[int, bytes] = {}

    def head(self, size: int) -> bytes:
        got = self.heads.get(size)
        if got is None:
            raw = _HEAD.pack(size)
            got = self.heads[size] = raw + struct.pack("<I", masked(self.crc.small(raw)))
            if len(self.heads) > 50_000:
                self.heads = {}
        return got

    def frames(self, payloads: list[bytes]) -> list[bytes]:
        return [self.head(len(p)) + p + struct.pack("<I", masked(c)) for p, c in zip(payloads, self.crc.many(payloads))]

    def read(self, data: bytes):
        """(offset, payload) of each frame that is not empty; raises where a checksum is wrong."""
        at, end, found = 0, len(data), []
        while at < end:
            (size,) = _HEAD.unpack_from(data, at)
            if data[at : at + 12] != self.head(size) or at + 16 + size > end:
                raise ValueError(f"broken frame at byte {at}")
            if size:
                found.append((at, data[at + 12 : at + 12 + size], data[at + 12 + size : at + 16 + size]))
            at += 16 + size
        for a in range(0, len(found), 512):
            part = found[a : a + 512]
            for (at, raw, check), crc in zip(part, self.crc.many([p for _, p, _ in part])):
                if struct.unpack("<I", check)[0] != masked(crc):
                    raise ValueError(f"broken payload at byte {at}")
                yield at, raw


def closing() -> bytes:
    """The empty frame that ends a block."""
    return Framer().frames([b""])[0]


def payload(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return _RECORD.pack(1, doc_id or 0, doc_id is not None, width, len(ids) // width) + ids


def unpack_payload(raw: bytes) -> tuple[int | None, np.ndarray]:
    _, doc_id, known, width, n = _RECORD.unpack_from(raw)
    return doc_id if known else None, np.frombuffer(raw, f"<u{width}", n, _RECORD.size)


def unpack_opening(raw: bytes) -> tuple[int, int]:
    """Offset of the block in its file, ids before it."""
    return _OPENING.unpack(raw)[1:]


class Blocks:
    """The blocks of one file, in order."""

    def __init__(self):
        self.framer, self.end = Framer(), closing()
        self.frames, self.size, self.ids = [], 0, 0
        self.offset = self.before = 0  # of the block that is being filled

    def add(self, doc_id: int | None, width: int, ids: bytes, frame: bytes) -> bytes | None:
        if self.end in frame:
            frame = self.framer.frames([payload(doc_id, 4, np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())])[0]
        self.frames.append(frame)
        self.size += len(frame)
        self.ids += len(ids) // width
        return self.cut() if self.size >= BLOCK_BYTES else None

    def cut(self) -> bytes:
        block = b"".join([*self.framer.frames([_OPENING.pack(0, self.offset, self.before)]), *self.frames])
        self.offset += len(block) + len(self.end)
        self.before += self.ids
        self.frames, self.size, self.ids = [], 0, 0
        return block


def write_records(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int | None = None) -> DataFrame:
    """Encodes docs into ``folder``/records, reads them back and writes ``folder``/index; returns
    the index."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    least, most = FILE_BYTES
    files = max(1, -(-size // (file_bytes or min(most, max(least, size // (3 * spark.sparkContext.defaultParallelism))))))
    ranged = slim.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()}).repartitionByRange(int(files), "id", "h", "r").sortWithinPartitions("id", "h")

    def run(batches):
        width = width_of(path, end_id)
        encoder, blocks, end = word_encoder(path, width), Blocks(), end_id.to_bytes(width, "little")
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                docs, ids = part.column(0).to_pylist(), [x + end for x in encoder.encode(texts_of(part))]
                done = []
                for doc, x, frame in zip(docs, ids, blocks.framer.frames([payload(i, width, x) for i, x in zip(docs, ids)])):
                    if block := blocks.add(doc, width, x, frame):
                        done.append(block)
                yield batch({"value": (done, pa.binary())})
        if blocks.frames:
            yield batch({"value": ([blocks.cut()], pa.binary())})

    out = ranged.select("id", "text").mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # one file a task: offsets count from the task's first block
    out.write.options(lineSep=closing().decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=0).text(f"{folder}/records")
    read_records(spark, folder).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a record: shard, offset, length, id, n_tokens, first (ids before it in its file),
    ids_crc32 (of the ids as 32-bit integers) and, if asked for, the ids.  Checks every checksum.
    """

    def make():
        framer = Framer()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            cols: dict[str, list] = {k: [] for k in ("shard", "offset", "length", "id", "n_tokens", "first", "ids_crc32", "ids")}
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                base = first = None
                for at, raw in framer.read(content.as_py()):
                    if raw[0] == 0:
                        base, first = unpack_opening(raw)
                        continue
                    i, ids = unpack_payload(raw)
                    n = len(ids)
                    for k, v in (("shard", shard), ("offset", base + at), ("length", len(raw) + 16), ("id", i), ("n_tokens", n), ("first", first), ("ids_crc32", zlib.crc32(ids.astype("<u4").tobytes()))):
                        cols[k].append(v)
                    if with_ids:
                        cols["ids"].append(ids.tolist())
                    first += n
            kinds = {k: pa.int64() for k in cols} | {"shard": pa.int32(), "ids": pa.list_(pa.int64())}
            return batch({k: (v, kinds[k]) for k, v in cols.items() if k != "ids" or with_ids})

        return run

    blocks = spark.read.options(lineSep=closing().decode("latin-1"), encoding="ISO-8859-1").text(f"{folder}/records")
    blocks = blocks.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("shard"), F.col("value").cast("binary").alias("block"))
    return arrow_map(blocks, make, "shard int, offset long, length long, id long, n_tokens long, first long, ids_crc32 long" + ", ids array<long>" * with_ids, rows=16)


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records before it, over all files in order.

    Only one row a file takes part in the running sum.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return records.join(before, "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def record_digest(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes docs as records and returns what was read back from the files."""
    folder = folder or shared_folder(docs.sparkSession, "records")
    index = write_records(docs, folder, path, end_id)
    return with_starts(index, index).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
