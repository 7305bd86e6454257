"""Packing of documents into windows by non-negative least squares over a histogram of lengths.

Documents become token ids and are cut into full windows and one remainder. Remainders are counted by length in units
of ``window / UNITS`` tokens, rounded down. Shallow combinations of lengths that fill a window exactly are enumerated,
and non-negative least squares finds how often to use each so that the histogram is used up. The repeat counts are
rounded down, pieces are dealt to combinations by their rank in their bin, and what is left (lengths no combination
took, and the few tokens by which a combination's true lengths exceed the window) is packed greedily end to end.
Because lengths were rounded down and pieces may be cut, every window but the last is full.

Scale: the histogram, the solution and the ranges that deal out pieces have sizes fixed by ``UNITS``. Ranks come from
counts per partition, so no key gathers rows: groups have at most ``DEPTH`` pieces. Token ids are written once and
shuffled once, to meet their place.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop, text_or_empty, written

WINDOW = 4096
UNITS = 64
DEPTH = 4
#: Bytes of words and ids that a task keeps.
CACHE_BYTES = 96 << 20
_BATCH_BYTES = 2 << 20
_LETTER, _TAIL_MARK, _GAP = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz", b".,!", b" \n"))
#: What an entry of the cache takes besides its word and ids: two objects and a place in a table.
_ENTRY_BYTES = 160
#: Letters that no normal form and no other version of Unicode changes, and marks that may follow them.
_LETTERS = re.compile("[a-zà-öø-ɏ]+")
_MARKS = ".,!?;:&#*%$)"
_PROBES = ("ab", "été", "straße", "ciónueganderheitly", "šž", "x")
_CODERS: dict[int, WordCoder] = {}


class WordCoder:
    """Ids of whole texts by a lower-casing tokenizer of the public ``tokenizers`` library that drops white space.

    Such a tokenizer treats what white space separates on its own, so words are encoded once and kept. Words live in
    two generations of at most ``cache_bytes`` together: when the young one is full it becomes the old one, and what
    is used again moves back. A tokenizer of another kind is refused.
    """

    def __init__(self, spec: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        probe = self.tok.encode(" Ab\n\t ab  ", add_special_tokens=False).ids
        if probe != 2 * self.tok.encode("ab", add_special_tokens=False).ids:
            raise ValueError("packing takes tokenizers that lower-case and drop white space")
        model = json.loads(spec)["model"]
        vocab = self.tok.get_vocab()
        self.wide = max(vocab.values()) >= 1 << 16
        self.kind = "I" if self.wide else "H"
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        # byte-level models see a character for each byte: those of Latin-1 that print, and others for the rest
        rest = iter(range(256, 512))
        self.chars = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else next(rest) for b in range(256)}
        self.direct = model["type"] == "BPE" and "ByteLevel" in json.dumps(json.loads(spec).get("pre_tokenizer")) and all(
            self._letters(w) == self.tok.encode(w, add_special_tokens=False).ids for w in _PROBES
        )
        self.half = cache_bytes // 2
        self.forget()

    def forget(self) -> None:
        """Give the cache back."""
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _letters(self, word: str) -> list[int]:
        """Ids of a word that is one pre-token."""
        return [t.id for t in self.tok.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.chars))]

    def _learn(self, fresh: list[bytes]) -> None:
        young, old, other, held = self.young, self.old, [], 0
        for w, s in zip(fresh, b" ".join(fresh).decode().split(" "), strict=True):
            if (ids := old.get(w)) is None:
                stem = s.rstrip(_MARKS)
                if not self.direct or not _LETTERS.fullmatch(stem) or stem != stem.lower():
                    other.append((w, s))
                    continue
                ids = array.array(self.kind, self._letters(stem)).tobytes()
                if len(stem) < len(s):  # letters, then marks: two pre-tokens
                    ids += self._marks(s[len(stem) :])
            young[w] = ids
            held += len(w) + len(ids) + _ENTRY_BYTES
        for (w, _), e in zip(other, self.tok.encode_batch_fast([s for _, s in other], add_special_tokens=False), strict=True):
            young[w] = ids = array.array(self.kind, e.ids).tobytes()
            held += len(w) + len(ids) + _ENTRY_BYTES
        self.held += held

    def _marks(self, marks: str) -> bytes:
        key = marks.encode()
        ids = self.young.get(key) or self.old.get(key)
        if ids is None:
            ids = array.array(self.kind, self.tok.encode(marks, add_special_tokens=False).ids).tobytes()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.half:
            self.young, self.old, self.held = {}, self.young, 0
        split = self._words(texts)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.young.get, words))
        if fresh := [i for i, ids in enumerate(known) if ids is None]:
            self._learn([words[i] for i in fresh])
            for i in fresh:
                known[i] = self.young[words[i]]
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        _, ends, raw = ids.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64, count=len(ids) + 1)[split.offsets.to_numpy()].tolist()
        return [raw[x:y].to_pybytes() if y > x else b"" for x, y in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _words(texts: list[str]) -> pa.ListArray:
        """The words of each text; a text that begins or ends with white space also has empty ones, without ids. A mark
        behind a letter is a word of its own, as letters repeat more without it."""
        raw = [t.encode() for t in texts]
        special = np.array([b"<|" in b for b in raw])  # special tokens are told apart by case; elsewhere A-Z may be lowered first
        raw = [b if own else b.lower() for b, own in zip(raw, special, strict=True)]
        offsets = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        at = np.flatnonzero(_TAIL_MARK[data[1:-1]]) + 1 if len(data) > 2 else offsets[:0]
        at = at[_LETTER[data[at - 1]] & _GAP[data[at + 1]]]
        at = at[~special[np.searchsorted(offsets, at, side="right") - 1]]
        data, offsets = np.insert(data, at, ord(" ")), offsets + np.searchsorted(at, offsets)
        joined = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        return pc.ascii_split_whitespace(joined)


def _coder(spec: str) -> WordCoder:
    """The worker's tokenizer; its cache is empty, as every task gives it back."""
    key = hash(spec)
    if key not in _CODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _CODERS.clear()
        _CODERS[key] = WordCoder(spec)
    return _CODERS[key]


def token_pieces(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Full windows and a remainder of each document: ``pid, bin, ord`` (its rank in the partition's bin), ``doc_id,
    start, length, doc_tokens, ids`` (little-endian, 2 or 4 bytes each)."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    unit = window // UNITS
    names = ["pid", "bin", "ord", "doc_id", "start", "length", "doc_tokens", "ids"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, ranks = TaskContext.get().partitionId(), [0] * (UNITS + 1)
        coder = _coder(spec.value)
        size, end = coder.dtype.itemsize, np.array([end_id], dtype=coder.dtype).tobytes()
        try:
            for batch in batches:
                first = 0
                while first < batch.num_rows:
                    texts, held, at = [], 0, first
                    while at < batch.num_rows and (held < _BATCH_BYTES or not texts):
                        texts.append(batch.column(1)[at].as_py())
                        held += len(texts[-1])
                        at += 1
                    cols: list[list] = [[] for _ in names]
                    for doc, ids in zip(batch.column(0).slice(first, at - first).to_pylist(), coder.encode(texts), strict=True):
                        ids += end
                        total = len(ids) // size
                        for start in range(0, total, window):
                            length = min(window, total - start)
                            b = length // unit
                            for c, v in zip(cols, (pid, b, ranks[b], doc, start, length, total, ids[start * size : (start + length) * size]), strict=True):
                                c.append(v)
                            ranks[b] += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                    first = at
        finally:
            coder.forget()

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return written(src.mapInArrow(run, "pid int, bin int, ord bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"), "pieces")


def combinations(units: int = UNITS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling tuples of at least two and at most ``depth`` lengths, in units, that sum to ``units``."""
    found = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            if len(head) > 1:
                found.append(head)
            return
        if len(head) < depth:
            for part in range(min(left, head[-1] if head else units - 1), 0, -1):
                if part * (depth - len(head)) >= left:
                    grow((*head, part), left - part)

    grow((), units)
    return found


def nnls(a: np.ndarray, b: np.ndarray, limit: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set: the column of steepest descent enters, and columns that a
    least-squares step would make negative leave."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(limit):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        enter = int(slope.argmax())
        if slope[enter] <= tol:
            break
        free[enter] = True
        while True:
            cols = np.flatnonzero(free)
            step = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (step > 0).all():
                x[:] = 0
                x[cols] = step
                break
            old, down = x[cols], step <= 0
            gap = old[down] - step[down]
            share = float(np.min(np.where(gap > 0, old[down] / np.where(gap > 0, gap, 1), 0)))
            x[cols] = np.maximum(old + share * (step - old), 0)
            gone = cols[down & (x[cols] <= tol)]
            x[gone] = 0
            free[gone] = False
            if not len(gone):
                break
    return x


def plan(histogram: np.ndarray, units: int = UNITS, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (bin, low, high, first sequence, repeats) that deal pieces out, and the number of sequences they fill.

    ``histogram[b]`` counts remainders of ``b`` units. The piece of rank k in [low, high) goes to sequence
    first + (k - low) mod repeats.
    """
    shapes = combinations(units, depth)
    a = np.zeros((units, len(shapes)))
    for j, s in enumerate(shapes):
        np.add.at(a[:, j], list(s), 1)
    left = histogram[:units].astype(np.int64).copy()
    left[0] = 0  # less than a unit: for the residual
    used, ranges, sequences = np.zeros(units, dtype=np.int64), [], 0
    x = np.floor(nnls(a, left.astype(float)) + 1e-6).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        bins = np.flatnonzero(need)
        repeats = int(min(x[j], (left[bins] // need[bins]).min()))
        if repeats <= 0:
            continue
        for b in bins:
            ranges.append((int(b), int(used[b]), int(used[b] + need[b] * repeats), sequences, repeats))
            used[b] += need[b] * repeats
            left[b] -= need[b] * repeats
        sequences += repeats
    return ranges, sequences


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` for every piece.

    Each document's ids, then ``end_id``, lie in exactly one piece each; a sequence's pieces have offsets without
    gaps from 0 and at most ``window`` ids. Null counts as empty (one id). Rows that repeat are packed each; null ids
    stay null; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, path, end_id, window, id_col, text_col)
    meta = ["pid", "bin", "ord", "doc_id", "start", "length"]
    counts = written(pieces.groupBy("pid", "bin").agg(F.count("*").alias("n")), "bin-counts")
    hist = np.zeros(UNITS + 1, dtype=np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        hist[r["bin"]] = r["n"]
    ranges, sequences = plan(hist)
    before = Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("pid", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.select(*meta).join(shift, ["pid", "bin"]).withColumn("k", F.col("ord") + F.col("shift"))
    deal = spark.createDataFrame(ranges, "b int, low bigint, high bigint, first bigint, repeats bigint")  # a few hundred rows
    dealt = ranked.join(F.broadcast(deal), (F.col("bin") == F.col("b")) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high")), "left")
    dealt = written(dealt.select(*meta, "k", (F.col("first") + (F.col("k") - F.col("low")) % F.col("repeats")).alias("seq")), "dealt")

    # combinations: lay pieces out longest first and cut at the window's end
    so_far = Window.partitionBy("seq").orderBy(F.desc("bin"), "k").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.where("seq is not null").withColumn("at", F.coalesce(F.sum("length").over(so_far), F.lit(0)))
    fits = F.greatest(F.lit(0), F.least(F.col("length"), window - F.col("at")))
    laid = written(laid.withColumn("fits", fits), "laid")
    part = ["pid", "bin", "ord", "skip", "size", "seq", "at"]
    placed = laid.where("fits > 0").select("pid", "bin", "ord", F.lit(0).cast("bigint").alias("skip"), F.col("fits").alias("size"), "seq", "at")

    rest = laid.where("fits < length").select("pid", "bin", "ord", F.col("fits").alias("skip"), (F.col("length") - F.col("fits")).alias("size"))
    rest = rest.unionByName(dealt.where(f"seq is null and bin < {UNITS}").select("pid", "bin", "ord", F.lit(0).cast("bigint").alias("skip"), F.col("length").alias("size")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(batch.column("size").to_numpy())
            sizes = batch.column("size").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task, dtype=np.int32)), pa.array(ends - sizes)], [*batch.schema.names, "task", "local"])
            total = int(ends[-1]) if len(ends) else total

    lined = written(rest.mapInArrow(run, "pid int, bin int, ord bigint, skip bigint, size bigint, task int, local bigint"), "residual")
    totals, at, starts = lined.groupBy("task").agg(F.sum("size").alias("size")).orderBy("task").collect(), 0, []  # a row for each task
    for r in totals:
        starts.append((r["task"], at))
        at += r["size"]
    line = lined.join(F.broadcast(spark.createDataFrame(starts, "task int, base bigint")), "task").withColumn("g", F.col("base") + F.col("local"))
    line = line.withColumn("w", F.explode(F.sequence(F.floor(F.col("g") / window), F.floor((F.col("g") + F.col("size") - 1) / window))))
    low = F.greatest(F.col("g"), F.col("w") * window)
    high = F.least(F.col("g") + F.col("size"), (F.col("w") + 1) * window)
    greedy = line.select("pid", "bin", "ord", (F.col("skip") + low - F.col("g")).alias("skip"), (high - low).alias("size"), (F.lit(sequences) + F.col("w")).alias("seq"), (low - F.col("w") * window).alias("at"))

    used = sequences + -(-at // window)
    whole = dealt.where(f"bin = {UNITS}").select("pid", "bin", "ord", F.lit(0).cast("bigint").alias("skip"), F.col("length").alias("size"), (F.lit(used) + F.col("k")).alias("seq"), F.lit(0).cast("bigint").alias("at"))
    places = written(placed.select(*part).unionByName(greedy.select(*part)).unionByName(whole.select(*part)), "places")
    width = F.length("ids") / F.col("length")
    out = pieces.join(places, ["pid", "bin", "ord"]).select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        F.col("size").alias("length"),
        F.substring(F.col("ids"), (F.col("skip") * width + 1).cast("int"), (F.col("size") * width).cast("int")).alias("ids"),
        "doc_tokens",
        F.col("seq").alias("sequence_id"),
        F.col("at").alias("offset"),
    )
    drop(counts, dealt, laid, lined)
    return out


def with_crc32(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32``: the CRC-32 of a piece's ids as little-endian unsigned 32-bit numbers, in place of its ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for ids, n in zip(batch.column("ids"), batch.column("length").to_pylist(), strict=True):
                raw = ids.as_buffer()
                wide = np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * n else "<u2").astype("<u4")
                crcs.append(zlib.crc32(wide.tobytes()))
            cols = {n: batch.column(n) for n in names if n != "ids_crc32"} | {"ids_crc32": pa.array(crcs, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return packed.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
