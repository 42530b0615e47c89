"""Token-ID binary output: static range asymmetric numeral system with shared frequency tables.

Texts are tokenised in ascending ``doc_id`` order, counted once over the whole corpus, and written as
files of independent blocks. A block holds whole documents; its ids go round-robin to ``LANES`` interleaved
coder states that share one stream of 32-bit words, so numpy decodes all lanes of a step at once. Every
``CHECK_EVERY`` steps a checkpoint keeps the states and the place in the stream: a reader can start there,
and several readers can decode one block side by side. Blocks and the file index carry CRC-32 sums.

File: ``MAGIC``, blocks, index (one ``INDEX`` record per block), ``FOOT`` (index offset, blocks, crc, MAGIC).
Block: ``HEAD``, documents (zlib of int64 ids, null flags, uint32 lengths), checkpoints, words.

A block's ids pass between tasks as 16-bit numbers where they fit, else as 32-bit ones. Strings of special tokens in
a text get the ids that the library's plain call gives them.

Defined results: null text counts as empty (only the end id); rows with a null ``doc_id`` come first; rows
with equal ``doc_id`` are ordered by the hash of their text; an empty table gives no files and no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop_stored, new_path, stored
from .tokens import encoder

MAGIC = b"RANSIDS1"
LANES, CHECK_EVERY = 2048, 64
BLOCK_TOKENS = 1 << 18
BITS = 20
LOW = 1 << 31
HEAD = "<4sIIIIIIII"  # tag, docs, tokens, lanes, steps, doc bytes, checkpoints, words, crc of the rest
INDEX = "<qqII"  # offset, length, docs, tokens
FOOT = "<qII8s"

TOKENS = T.StructType([
    T.StructField("segment", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ahead", T.LongType()), T.StructField("n_docs", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.BinaryType()), T.StructField("nulls", T.BinaryType()),
    T.StructField("lengths", T.BinaryType()), T.StructField("ids", T.BinaryType()),
])
DECODED = "segment long, block long, place long, doc_id long, n_tokens long, ids_crc32 long, start long, ids binary"


class Table:
    """Frequencies scaled to 2**BITS in which each id that occurs keeps at least one slot."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        if len(counts) > 1 << BITS:
            raise ValueError(f"more than {1 << BITS} different ids; raise BITS")
        freq = np.maximum(1, np.floor(counts * ((1 << BITS) / max(counts.sum(), 1)))).astype(np.int64)
        for k in np.argsort(-freq, kind="stable"):  # the most frequent take what rounding left or took
            off = (1 << BITS) - int(freq.sum())
            if off == 0 or not len(freq):
                break
            freq[k] += max(off, 1 - int(freq[k]))
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq.astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.index = np.zeros(int(self.symbols[-1]) + 1 if len(freq) else 1, np.uint32)
        self.index[self.symbols] = np.arange(len(freq))

    def to_bytes(self) -> bytes:
        return zlib.compress(np.stack([self.symbols.astype("<u8"), self.freq.astype("<u8")]).tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> "Table":
        symbols, freq = np.frombuffer(zlib.decompress(data), "<u8").reshape(2, -1)
        return cls(symbols, freq)


def encode_ids(ids: np.ndarray, table: Table) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Checkpoints (place in the words, states) by step, the first at step 0, and the words."""
    steps = -(-len(ids) // LANES)
    sym = np.zeros(steps * LANES, np.uint32)
    sym[: len(ids)] = table.index[ids]
    sym[len(ids) :] = sym[0] if len(ids) else 0
    sym = sym.reshape(steps, LANES)
    x = np.full(LANES, LOW, np.uint64)
    out, marks, emitted = [], {}, 0
    top, word, shift = np.uint64(31 - BITS + 32), np.uint64(32), np.uint64(BITS)
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[sym[t]], table.start[sym[t]]
        full = x >= (f << top)
        if full.any():
            out.append(x[full].astype(np.uint32))
            emitted += len(out[-1])
            x[full] >>= word
        q, r = np.divmod(x, f)
        x = (q << shift) + r + c
        if t % CHECK_EVERY == 0:
            marks[t] = (emitted, x.copy())
    words = np.concatenate(out[::-1]).astype("<u4") if out else np.zeros(0, "<u4")
    return [(emitted - marks[t][0], marks[t][1]) for t in sorted(marks)], words


def decode_ids(n: int, first: int, last: int, at: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The symbols of steps first..last of a block of n ids, from the checkpoint before step ``first``."""
    x = states.astype(np.uint64)
    mask, shift, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    out = np.empty((last - first, LANES), np.uint32)
    for t in range(last - first):
        low = x & mask
        s = table.slots[low]
        out[t] = s
        x = table.freq[s] * (x >> shift) + low - table.start[s]
        need = np.flatnonzero(x < np.uint64(LOW))
        if len(need):
            x[need] = (x[need] << word) | words[at : at + len(need)]
            at += len(need)
    return table.symbols[out.reshape(-1)[: max(0, n - first * LANES)]]


def id_kind(ids: bytes, n: int) -> str:
    """Type of n ids in so many bytes: 16 bits each where all of a block fit, else 32."""
    return "<u4" if len(ids) == 4 * n and n else "<u2"


def pack_block(doc_ids: bytes, nulls: bytes, lengths: bytes, ids: bytes, table: Table) -> bytes:
    tokens = np.frombuffer(ids, id_kind(ids, int(np.frombuffer(lengths, "<u4").sum())))
    marks, words = encode_ids(tokens, table)
    docs = zlib.compress(doc_ids + nulls + lengths)
    rest = docs + b"".join(struct.pack("<I", at) + x.astype("<u8").tobytes() for at, x in marks) + words.tobytes()
    return struct.pack(HEAD, b"BLK1", len(nulls), len(tokens), LANES, -(-len(tokens) // LANES), len(docs), len(marks), len(words), zlib.crc32(rest)) + rest


def unpack_block(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, null flags and lengths of the documents of a block, and their token ids."""
    tag, n_docs, n, lanes, steps, n_head, n_marks, n_words, crc = struct.unpack_from(HEAD, data)
    rest = memoryview(data)[struct.calcsize(HEAD) :]
    if tag != b"BLK1" or lanes != LANES or zlib.crc32(rest) != crc:
        raise ValueError("damaged block")
    docs = zlib.decompress(rest[:n_head])
    mark = 4 + 8 * LANES
    words = np.frombuffer(rest[n_head + n_marks * mark :], "<u4", n_words).astype(np.uint64)
    parts = []
    for k in range(n_marks):  # each of these could go to a task of its own
        at = struct.unpack_from("<I", rest, n_head + k * mark)[0]
        states = np.frombuffer(rest, "<u8", LANES, n_head + k * mark + 4)
        parts.append(decode_ids(n, k * CHECK_EVERY, min(steps, (k + 1) * CHECK_EVERY), at, states, words, table)[: CHECK_EVERY * LANES])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "u1", n_docs, 8 * n_docs), np.frombuffer(docs, "<u4", n_docs, 9 * n_docs), ids


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` in ascending order; one row per block of whole documents (``TOKENS``)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").drop("_tie")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment, block, ahead, end = TaskContext.get().partitionId(), 0, 0, np.asarray([end_id], "<u4").tobytes()
        coder = encoder(tokenizer, True)
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            kind = "<u4" if len(ids) and ids.max() > 0xFFFF else "<u2"
            row = {"segment": segment, "block": block, "ahead": ahead, "n_docs": len(held), "n_tokens": len(ids), "doc_ids": np.asarray([x or 0 for x, _ in held], "<i8").tobytes(), "nulls": bytes(x is None for x, _ in held), "lengths": np.asarray([len(x) // 4 for _, x in held], "<u4").tobytes(), "ids": ids.astype(kind).tobytes()}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k in range(0, len(texts), 500):
                for name, ids in zip(names[k : k + 500], coder.encode(texts[k : k + 500]), strict=True):
                    held.append((name, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= BLOCK_TOKENS:
                        yield close()
                        held, size, block, ahead = [], 0, block + 1, ahead + size
        if held:
            yield close()

    return rows.mapInArrow(blocks, TOKENS)


def frequency_table(blocks: DataFrame) -> Table:
    """Counts of every id over all blocks; at most one row per id of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.bincount(np.frombuffer(ids, id_kind(ids, n)), minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["symbol", "n"])

    rows = blocks.select("n_tokens", "ids").mapInArrow(count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toPandas()
    return Table(rows["symbol"].to_numpy(), rows["n"].to_numpy())


def write_files(blocks: DataFrame, table: Table, folder: str) -> DataFrame:
    """Write the blocks as files under ``folder``; one row per file: path, first segment and block, block count.

    A file holds what one task reads, so a repeated task writes the same bytes to the same name.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(table.to_bytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fs, base, out, index = None, *pyarrow.fs.FileSystem.from_uri(folder), None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    table = Table.from_bytes(shared.value)
                    first, n_blocks = (row["segment"], row["block"]), 0
                    name = f"{base}/ids-{first[0]:06d}-{first[1]:06d}"
                    from pyspark import TaskContext

                    part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
                    out = fs.open_output_stream(part)
                    out.write(MAGIC)
                    at = len(MAGIC)
                data = pack_block(row["doc_ids"], row["nulls"], row["lengths"], row["ids"], table)
                data += struct.pack("<qqq", row["segment"], row["block"], row["ahead"])
                out.write(data)
                index.append(struct.pack(INDEX, at, len(data), row["n_docs"], row["n_tokens"]))
                at += len(data)
        if out is not None:
            listing = b"".join(index)
            out.write(listing + struct.pack(FOOT, at, len(index), zlib.crc32(listing), MAGIC))
            out.close()
            fs.move(part, name + ".rans")
            yield pa.RecordBatch.from_pylist([{"path": name + ".rans", "segment": first[0], "block": first[1], "n_blocks": len(index)}])

    return blocks.select("segment", "block", "ahead", "n_docs", "n_tokens", "doc_ids", "nulls", "lengths", "ids").mapInArrow(write, "path string, segment long, block long, n_blocks long")


def read_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Read a folder of id files: one row per document with its segment, block and place (``DECODED``)."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    paths = sorted(x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.path.endswith(".rans"))
    with fs.open_input_file(f"{base}/segments.json") as f:
        firsts = spark.sparkContext.broadcast({int(k): v for k, v in json.loads(f.read()).items()})
    with fs.open_input_file(f"{base}/table.bin") as f:
        shared = spark.sparkContext.broadcast(f.read())
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 4096)), "path")

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    at, n, crc, magic = struct.unpack(FOOT, f.read_at(struct.calcsize(FOOT), f.size() - struct.calcsize(FOOT)))
                    listing = f.read_at(n * struct.calcsize(INDEX), at)
                    if magic != MAGIC or zlib.crc32(listing) != crc:
                        raise ValueError(f"damaged index in {path}")
                yield pa.RecordBatch.from_pylist([{"path": path, "at": a, "size": b} for a, b, _, _ in struct.iter_unpack(INDEX, listing)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        table, open_path, f = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                table = table or Table.from_bytes(shared.value)
                if row["path"] != open_path:
                    open_path, f = row["path"], fs.open_input_file(row["path"])
                data = f.read_at(row["size"], row["at"])
                segment, block, ahead = struct.unpack("<qqq", data[-24:])
                names, nulls, lengths, ids = unpack_block(data[:-24], table)
                begin = firsts.value[segment] + ahead
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                own = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                k = len(names)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, segment)), pa.array(np.full(k, block)), pa.array(np.arange(k)), pa.array(names, mask=nulls.astype(bool)), pa.array(lengths.astype(np.int64)),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(begin + begins), pa.array(own if with_ids else [None] * k, pa.binary()),
                ], ["segment", "block", "place", "doc_id", "n_tokens", "ids_crc32", "start", "ids"])

    spread = listed.mapInArrow(indexes, "path string, at long, size long")
    return spread.mapInArrow(decode, DECODED)


def write_token_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> str:
    """Tokenise, count and write all of ``docs``: id files, ``table.bin``, and the ids before each segment in ``segments.json``. Returns the folder."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    blocks = stored(token_blocks(docs, tokenizer, end_id), "token-blocks")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    table = frequency_table(blocks)
    with fs.open_output_stream(f"{base}/table.bin") as f:
        f.write(table.to_bytes())
    sizes = sorted((r["segment"], r["n"]) for r in blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n")).collect())  # a row per partition
    ends = np.cumsum([n for _, n in sizes], dtype=np.int64).tolist()
    with fs.open_output_stream(f"{base}/segments.json") as f:
        f.write(json.dumps({s: e - n for (s, n), e in zip(sizes, ends, strict=True)}).encode())
    write_files(blocks, table, folder).write.format("noop").mode("overwrite").save()
    drop_stored(blocks)
    return folder


def token_ids_query(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    folder = write_token_ids(docs, tokenizer, end_id)
    return read_files(docs.sparkSession, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
