"""Exact de-duplication by deterministic block naming.

A text, lower-cased in A-Z only, is cut into fixed-size blocks of bytes. All blocks of the corpus are sorted and each
distinct block gets its dense rank as an integer name; then adjacent names are paired, the pairs sorted and named in
turn, until one name is left for each document. With the number of blocks, that name is the document's identity: it
is made by comparing contents, so two texts share it only if they are equal; only where a run of equal blocks crosses
from one partition to the next are its two ends compared by a 128-bit digest.

Scale: blocks meet in one range-partitioned sort whose key ends in the document, so a block that a third of all rows
share is spread over many tasks; runs that cross a partition's border are mended from two rows per partition. Ranges are
cut by a block's first bytes and its digest, so what the driver samples is a few numbers a row. Only integers move after that. Every level is written to the shared folder, so executors may be lost between levels.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, rows_of, text_or_empty, written

BLOCK_BYTES = 1024
#: A block's first bytes and its digest: what rows are partitioned by, so that no block travels to the driver.
ROUTE = ["head", "digest1", "digest2"]
_BATCH_BYTES = 4 << 20


def _cutter(block_bytes: int):
    names = ["doc_id", "sha", "n_blocks", "pos", "mult", *ROUTE, "block"]
    types = [pa.int64(), pa.binary(), *[pa.int64()] * 6, pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = [[] for _ in names], 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes().lower()  # bytes.lower() touches A-Z only
                sha = hashlib.sha256(data).digest()
                n = max(1, -(-len(data) // block_bytes))
                for pos in range(n):
                    block = data[pos * block_bytes : (pos + 1) * block_bytes]
                    route = struct.unpack(">qqq", block[:8].ljust(8, b"\0") + hashlib.blake2b(block, digest_size=16).digest())
                    for c, v in zip(cols, (doc, sha, n, pos, 1, *route, block), strict=True):
                        c.append(v)
                    held += block_bytes
                    if held >= _BATCH_BYTES:
                        yield flush()
                        held = 0
        if cols[0]:
            yield flush()

    return cut


def dense_names(df: DataFrame, keys: list[str], tie: list[str], keep: list[str], label: str, route: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``name``: the dense rank (from 0) of the row's ``keys`` among all distinct ``keys``.

    Rows are range-partitioned and sorted by keys and ties; ranks are counted in each partition and shifted by what
    precedes it. A run that two partitions share counts once. The driver samples and sees a bounded number of keys for
    each partition. Where keys are long, ``route`` names short columns that are equal exactly where the keys are (a
    digest): ranges are cut and borders compared by them, and ranks follow first them and then the keys, which are
    compared in full within a partition.
    """
    spark = df.sparkSession
    route = route or []
    ordered = df.select(*dict.fromkeys([*route, *keys, *tie, *keep])).repartitionByRange(*(route or keys), *tie).sortWithinPartitions(*route, *keys, *tie)
    border = route or keys

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, before, last, held = TaskContext.get().partitionId(), -1, None, None, None

        def out(batch, ranks, first, end):
            n = batch.num_rows
            edge = [None] * n
            if first is not None:
                edge[0] = pickle.dumps(("first", first))
            if end is not None:
                edge[-1] = pickle.dumps(("last", end)) if edge[-1] is None else pickle.dumps(("both", first, end))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(ranks, pa.int64()), pa.array(np.full(n, pid, dtype=np.int32)), pa.array(edge, pa.binary())],
                [*keep, "rank", "pid", "edge"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k) for k in keys]
            head = tuple(batch.column(k)[0].as_py() for k in border)
            new = np.zeros(batch.num_rows, dtype=np.int64)
            for c in cols:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(np.int64)
            own = tuple(c[0].as_py() for c in cols)
            new[0] = int(own != before)
            ranks = at + np.cumsum(new)
            at, before = int(ranks[-1]), tuple(c[-1].as_py() for c in cols)
            last = tuple(batch.column(k)[-1].as_py() for k in border)
            if held:
                yield out(*held, None)
            held = (batch, ranks, head if held is None and ranks[0] == 0 and new[0] else None)
        if held:
            yield out(*held, last)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.select(*keep).schema)
    local = written(ordered.mapInArrow(rank, f"{fields}, rank bigint, pid int, edge binary"), label)
    ends: dict[int, dict] = {}
    for r in local.where(F.col("edge").isNotNull()).select("pid", "rank", "edge").collect():
        what, *found = pickle.loads(bytes(r.edge))
        e = ends.setdefault(r.pid, {})
        if what in ("first", "both"):
            e["first"] = found[0]
        if what in ("last", "both"):
            e |= {"last": found[-1], "count": r["rank"] + 1}
    shifts, total, before = [], 0, None
    for pid in sorted(ends):
        same = before is not None and ends[pid]["first"] == before
        shifts.append((pid, total - int(same)))
        total += ends[pid]["count"] - int(same)
        before = ends[pid]["last"]
    shift = spark.createDataFrame(shifts, "pid int, shift bigint")  # a row for each partition
    out = local.join(F.broadcast(shift), "pid").select(*keep, (F.col("rank") + F.col("shift")).alias("name"))
    out._tessera_path = local._tessera_path
    return out


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, sha, n_blocks, name, mult``: an identity (n_blocks, name) for every document.

    ``sha`` is the SHA-256 of the normalised text and serves as part of the row's key and as output, never to decide
    equality. Rows that repeat both id and text come back once, with their number in ``mult``. A null or empty text
    is one empty block. Ids may be null.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    blocks = src.mapInArrow(_cutter(block_bytes), f"doc_id bigint, sha binary, n_blocks bigint, pos bigint, mult bigint, {', '.join(f'{c} bigint' for c in ROUTE)}, block binary")
    keep = ["doc_id", "sha", "n_blocks", "pos", "mult"]
    named = dense_names(blocks, ["block"], ["doc_id", "pos"], keep, "names-0", ROUTE)
    longest = named.agg(F.max("n_blocks")).first()[0] or 1
    levels, done = [named], [named.where("n_blocks = 1")]
    for level in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        left = F.when(F.col("pos") % 2 == 0, F.col("name"))
        right = F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = (
            levels[-1]
            .where(F.col("n_blocks") > 2 ** (level - 1))
            .groupBy("doc_id", "sha", "n_blocks", F.floor(F.col("pos") / 2).cast("bigint").alias("half"))
            .agg(F.max(left).alias("l"), F.coalesce(F.max(right), F.lit(-1)).alias("r"), F.sum(F.when(F.col("pos") == 0, F.col("mult")).otherwise(0)).alias("mult"))
            .withColumnRenamed("half", "pos")
        )
        named = dense_names(pairs, ["l", "r"], ["doc_id", "pos"], keep, f"names-{level}")
        levels.append(named)
        done.append(named.where((F.col("n_blocks") > 2 ** (level - 1)) & (F.col("n_blocks") <= 2**level)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ids = written(out.groupBy("doc_id", "sha", "n_blocks", "name").agg(F.sum("mult").alias("mult")), "identities")
    drop(*levels)
    return ids


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; a null id is below all others. Of rows that repeat both id and text, one stays. An empty table
    gives an empty result; other columns of ``docs`` are not read.
    """
    ids = block_identities(docs, id_col, text_col, block_bytes)
    groups = written(ids.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("mult").alias("group_size"), F.max(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("sha").alias("c"))).alias("top")), "groups")
    # both sides of the join are read from tables, so Spark can split the partition of a hot group
    rows = ids.join(groups, ["n_blocks", "name"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mult"))))
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns, whatever their names."""
    ids = block_identities(docs, id_col, text_col)
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "sha", (F.col("mult") > 1).alias("again"))
    kept = ids.groupBy("n_blocks", "name").agg(F.max(place).alias("top")).select("top.doc_id", F.col("top.sha").alias("hash"), "top.again")
    kept = written(kept, "kept")
    drop(ids)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = F.unhex(F.sha2(F.translate(text_or_empty(F.col(text_col)), upper, upper.lower()).cast("binary"), 256))
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), sha.alias("hash"))
    return rows_of(src, kept)
