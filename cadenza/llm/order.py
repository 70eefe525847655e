"""Training-order materialisation of token sequences.

Texts become ids and an end id; each task's stream is cut into sequences of
``LENGTH`` ids. Sequences are numbered, and a keyed Feistel permutation with
cycle-walking over exactly that many numbers gives each its slot in the global
training order: no sort by random keys, and any slot can be computed alone.
Slots are range-partitioned, and each shard's task writes a file of fixed-stride
records, so a reader finds record ``slot`` at byte ``(slot mod per shard) *
stride`` and can resume from any slot. On their way to the shards records are
compressed; the files hold plain ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cadenza.llm.common import released, running_offsets, scratch, small_batches, stored
from cadenza.llm.tokens import encoder

LENGTH, END_ID, PAD_ID, PER_SHARD, KEY = 2048, 50256, 50256, 4096, 0x5EED
ROUNDS = 4
#: Offsets are one row of two numbers per input task; up to so many are broadcast, beyond it they are joined by shuffle.
MOST_PARTS = 500_000


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0..n-1: a balanced network over the next even power of two, walked until inside."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    low = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(ROUNDS):
            f = (right + np.uint64(key & 0xFFFFFFFF) + np.uint64(r * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ f >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f ^ f >> np.uint64(32)) & low
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """``part, k, n_ids, first_doc, payload``: each task's stream, cut. Only a task's last sequence is padded.

    Ids take two bytes; ``payload`` is a compressed record. Null and empty texts
    give their end id alone, rows without an id are read like all others. The
    cut follows the table's partitions: the same files and split give the same
    sequences.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, pack = encoder(tokenizer), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        rest, owner, k = np.zeros(0, np.uint16), None, 0
        for batch in (*[], *batches, None):
            if batch is None:
                stream, docs_at, starts = rest, [], np.zeros(0, np.int64)
            else:
                ids = [np.append(encode(t or ""), np.uint32(END_ID)).astype("<u2") for t in batch["text"]]
                starts = len(rest) + np.cumsum([0, *(len(i) for i in ids[:-1])])
                stream, docs_at = np.concatenate([rest, *ids]), list(batch["doc_id"])
            full = len(stream) // length if batch is not None else -(-len(stream) // length)
            rows = []
            for i in range(full):
                piece = stream[i * length : (i + 1) * length]
                d = int(np.searchsorted(starts, i * length, side="right")) - 1
                rows.append((part, k, len(piece), docs_at[d] if d >= 0 else owner, pack.compress(np.append(piece, np.full(length - len(piece), PAD_ID, "<u2")).astype("<u2").tobytes())))
                k += 1
            d = int(np.searchsorted(starts, full * length, side="right")) - 1
            owner = docs_at[d] if d >= 0 else owner
            rest = stream[full * length :]
            if rows:
                yield pd.DataFrame(rows, columns=["part", "k", "n_ids", "first_doc", "payload"]).astype({"first_doc": "Int64"})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lambda b: released(run(b)), "part long, k long, n_ids int, first_doc long, payload binary")


def in_training_order(docs: DataFrame, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD, tokenizer: str | None = None) -> DataFrame:
    """``slot, shard, byte_offset, sequence, n_ids, first_doc, payload``: a shard in one partition, sorted by slot.

    ``payload`` is a compressed record of ``length`` ids, ``n_ids`` of which are
    real. An empty table gives no rows.
    """
    cut = stored(sequences(docs, length, tokenizer))
    counts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = cut.count()
    base = running_offsets(counts, "part")
    if counts.count() <= MOST_PARTS:
        base = F.broadcast(base)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total, key))

    numbered = cut.join(base, "part").withColumn("sequence", F.col("offset") + F.col("k")).withColumn("slot", slot("sequence"))
    shards = max(1, -(-total // per_shard))
    return (
        numbered.withColumn("shard", F.expr(f"slot div {per_shard}").cast("int"))
        .withColumn("byte_offset", F.col("slot") % per_shard * (2 * length))
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .select("slot", "shard", "byte_offset", "sequence", "n_ids", "first_doc", "payload")
    )


def write_shards(ordered: DataFrame, path: str) -> DataFrame:
    """Write ``shard-NNNNNN.bin`` files below ``path``, a folder that executors share or a store's address.

    Returns ``ordered`` with ``ids_crc32`` of each record instead of its
    payload, for the records that the files hold. One task writes a shard, to a
    name of its own first and then moved, so a task that is run again leaves the
    same file and never half of one. The rows are stored: the files are written
    when this returns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        unpack, shard, out = zstandard.ZstdDecompressor(), None, None
        mine = f"{root}/part-{TaskContext.get().taskAttemptId()}.tmp"

        def close() -> None:
            if out is not None:
                out.close()
                store.move(mine, f"{root}/shard-{shard:06d}.bin")

        for batch in batches:
            crcs = []
            for s, payload in zip(batch["shard"], batch["payload"], strict=True):
                if s != shard:
                    close()
                    shard, out = int(s), store.open_output_stream(mine)
                record = unpack.decompress(payload)
                out.write(record)
                crcs.append(zlib.crc32(record))
            yield batch.drop(columns="payload").assign(ids_crc32=crcs)
        close()

    small_batches(ordered.sparkSession)
    return stored(ordered.mapInPandas(lambda b: released(run(b)), "slot long, shard int, byte_offset long, sequence long, n_ids int, first_doc long, ids_crc32 long"))


def materialise(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The shards of ``docs`` below ``path`` (a new shared folder if none is given), and a row for each record, with its ``path``."""
    path = path or scratch(docs.sparkSession)
    rows = write_shards(in_training_order(docs, **options), path)
    return rows.withColumn("path", F.format_string("%s/shard-%06d.bin", F.lit(path), F.col("shard")))


def read_from(path: str, slot: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """``n`` sequences from ``slot`` on, as written: a resumed reader seeks and reads on."""
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    out = []
    for s in range(slot, slot + n):
        with store.open_input_file(f"{root}/shard-{s // per_shard:06d}.bin") as f:
            f.seek(s % per_shard * 2 * length)
            out.append(np.frombuffer(f.read(2 * length), "<u2"))
    return np.stack(out) if out else np.zeros((0, length), np.uint16)
