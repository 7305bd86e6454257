"""Byte-level BPE, encoding and decoding, with a segment tree over the ranks of adjacent pairs.

Each pre-token is a row of symbols. Over its adjacent pairs stands a segment tree of minima of (rank, position): the
root is the leftmost of the lowest-ranked merges. Applying it changes three leaves (the merged pair, the pair that
vanished, the pair before), each mended up its path to the root, until the root says that nothing merges. Many
pre-tokens of like length go through this in step as rows of one numpy array; long ones have a tree each, O(n log n).

No shuffle: a map over the rows. A task keeps a bounded cache of pre-tokens, as words repeat.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty

#: Fixed value: the public byte-level pre-token pattern; white space is the Unicode property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHE_ENTRIES = 700_000
#: Pre-tokens of up to this many bytes are encoded in step.
ROW_BYTES = 64
_BATCH_CHARS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class BytePairCoder:
    """Encodes and decodes with the byte-level BPE vocabulary given as the text of its JSON file."""

    def __init__(self, spec: str) -> None:
        spec_ = json.loads(spec)
        model, symbols = spec_["model"], byte_symbols()
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in symbols], dtype=np.int64)
        back = {c: b for b, c in enumerate(symbols)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.none = len(merges)
        # the ranks of two single bytes are asked for most
        a, b = np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")
        self.byte_ranks = self._ranks(a.ravel(), b.ravel()).reshape(256, 256)
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec_.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.cache: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of 1 to ROW_BYTES bytes, all in step."""
        n = len(words)
        size = np.array([len(w) for w in words])
        cap = 1 << max(1, int(size.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(w.ljust(cap, b"\0") for w in words), dtype=np.uint8).reshape(n, cap)
        sym = self.byte_ids[raw]
        pos = np.arange(cap)
        nxt = np.minimum(pos + 1, cap)[None, :] + np.zeros((n, 1), dtype=np.int64)
        prv = pos[None, :] - 1 + np.zeros((n, 1), dtype=np.int64)
        never = (self.none + 1) * cap
        tree = np.full((n, 2 * cap), never, dtype=np.int64)
        rank = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        real = (pos[None, 1:] < size[:, None]) & (rank < self.none)
        tree[:, cap : 2 * cap - 1] = np.where(real, rank * cap + pos[:-1], never)
        level = cap
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        alive = pos[None, :] < size[:, None]
        rows = np.flatnonzero(tree[:, 1] < never)
        while len(rows):
            root = tree[rows, 1]
            at, merged = root % cap, self.merged[root // cap]
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            before = prv[rows, at]
            sym[rows, at] = merged
            alive[rows, gone] = False
            nxt[rows, at] = after
            has_after = after < size[rows]
            prv[rows[has_after], after[has_after]] = at[has_after]
            tree[rows, cap + gone] = never
            r = np.full(len(rows), self.none)
            r[has_after] = self._ranks(merged[has_after], sym[rows[has_after], after[has_after]])
            tree[rows, cap + at] = np.where(r < self.none, r * cap + at, never)
            has_before = before >= 0
            rb, b = rows[has_before], before[has_before]
            r = self._ranks(sym[rb, b], merged[has_before])
            tree[rb, cap + b] = np.where(r < self.none, r * cap + b, never)
            for who, leaf in ((rows, gone), (rows, at), (rb, b)):
                node = (cap + leaf) >> 1
                while len(node) and node[0]:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < never]
        return np.split(sym[alive], np.cumsum(alive.sum(1))[:-1])

    def encode_long(self, word: bytes) -> list[int]:
        """The ids of one long word, with a tree of its own."""
        n = len(word)
        cap = 1 << max(1, (n - 1).bit_length())
        sym = [int(self.byte_ids[b]) for b in word]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        never = (self.none + 1) * cap
        rank_of, none = self.rank_of, self.none
        tree = [never] * (2 * cap)
        for i in range(n - 1):
            r = rank_of.get(sym[i] << 32 | sym[i + 1], none)
            if r < none:
                tree[cap + i] = r * cap + i
        for i in range(cap - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            i = cap + leaf
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        alive = bytearray(b"\1") * n
        while tree[1] < never:
            rank, at = divmod(tree[1], cap)
            gone = nxt[at]
            sym[at], alive[gone], after, before = int(self.merged[rank]), 0, nxt[gone], prv[at]
            nxt[at] = after
            put(gone, never)
            r = none
            if after < n:
                prv[after] = at
                r = rank_of.get(sym[at] << 32 | sym[after], none)
            put(at, r * cap + at if r < none else never)
            if before >= 0:
                r = rank_of.get(sym[before] << 32 | sym[at], none)
                put(before, r * cap + before if r < none else never)
        return [s for s, a in zip(sym, alive, strict=True) if a]

    def _learn(self, fresh: list[str]) -> None:
        """Put the ids of pre-tokens into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in fresh:
            b = w.encode()
            if len(b) > ROW_BYTES:
                self.cache[w] = np.array(self.encode_long(b), dtype="<i4").tobytes()
            else:
                by_size.setdefault((len(b) - 1).bit_length(), []).append((w, b))
        for same in by_size.values():
            for (w, _), ids in zip(same, self.encode_rows([b for _, b in same]), strict=True):
                self.cache[w] = ids.astype("<i4").tobytes()

    def _pieces(self, text: str) -> list[str | int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pre_token.findall(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pre_token.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (int32) of each text. Special tokens in a text become their ids; nothing is added."""
        pieces = [self._pieces(t) for t in texts]
        known = self.cache
        if len(known) > CACHE_ENTRIES:
            known.clear()
        self._learn(sorted({w for p in pieces for w in set(p) if w not in known and not isinstance(w, int)}))
        get = known.__getitem__
        out = []
        for p in pieces:
            try:
                data = b"".join(map(get, p))
            except KeyError:
                data = b"".join(int(w).to_bytes(4, "little") if isinstance(w, int) else get(w) for w in p)
            out.append(np.frombuffer(data, dtype="<i4"))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def token_map(docs: DataFrame, path: str, id_col: str, text_col: str, each: Callable[[BytePairCoder, np.ndarray], tuple], schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Encode every text and return its id with what ``each(coder, ids)`` makes of the ids.

    ``path`` is read on the driver; its contents, of bounded size, go to executors as a broadcast value.
    """
    sc = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        spec = sc.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or BytePairCoder(spec.value)
            start = 0
            while start < batch.num_rows:
                texts, end, chars = [], start, 0
                while end < batch.num_rows and (chars < _BATCH_CHARS or not texts):
                    texts.append(batch.column(1)[end].as_py())
                    chars += len(texts[-1])
                    end += 1
                rows = [each(coder, ids) for ids in coder.encode_batch(texts)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *(pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])
                start = end

    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return src.mapInArrow(run, f"doc_id bigint, {schema}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every row's whole text.

    Null counts as empty and gives no ids. Rows are mapped one by one, so repeated rows and null ids stay as they are;
    other columns are not read.
    """
    return token_map(docs, path, id_col, text_col, lambda c, ids: (ids,), "ids array<int>", [("ids", pa.list_(pa.int32()))])


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of every row's ids; null ids give an empty text."""
    sc = rows.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        spec = sc.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or BytePairCoder(spec.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id bigint, text string")
