"""Similarity self-join of documents on the Jaccard index of their word n-gram sets, and its connected components.

A document is the sorted array of the 64-bit hashes of its distinct n-grams; documents of equal sets are one class.
Two sets whose index reaches t differ in at most (n1 + n2) (1 - t) / (1 + t) n-grams. So if the hash space is cut into
more parts than that, linked sets agree on all n-grams of some part.

1. One pass over the texts gives each class's key, size and signature (parity bitmap), and its tokens: for its size
   band, and for the band below, the content of each part. Tokens are shuffled once, packed; those that one class
   alone has end there. What a task finds to be held by many of its classes goes past the shuffle that gathers tokens.
2. The classes of a token are a tile, all of one band or two neighbours; tiles of the same classes are one.
3. In a tile, bit counts of the signatures bound the overlap of every pair from above; pairs that could reach t go to
   the exact intersection of their sorted arrays. Large tiles are dealt out by pairs of blocks.
4. Forest rounds come first: a tile names only enough pairs to join what could be linked, and blocks are not crossed;
   the first takes two tiles of each class. A large group of near copies costs about as many checks as it has members.
   Links found are contracted into components, and tiles that lie in one component are done.
5. The last round is exact: every pair of a tile that lies in different components and could reach t is checked once.
   What lies in the tile's largest component is not compared among itself.

Only the last round decides that two components are not linked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, bounded_broadcast, drop, input_bytes, rows_of, text_or_empty, written
from tessera.llm.graph import components

#: Rows that a block of a tile takes, and bytes of their signatures.
TILE = 512
TILE_BYTES = 8 << 20
FOREST_ROUNDS = 2
#: Tokens that a task packs at a time; of a token that more of its classes have, they do not go through one bucket.
PACK_TOKENS = 1 << 20
HOT_IN_TASK = 16
#: Classes that a task remembers to have sent tokens of; one that is forgotten is sent again, which changes nothing.
SEEN = 100_000
#: Input bytes for each bucket of tokens, and the most buckets.
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 1 << 16
#: Chance that a set has so many empty parts that it needs the tile of such sets.
SPARSE_CHANCE = 1e-5
#: Tokens of a shuffled row.
_ROW_TOKENS = 1000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << 48) - 1)
_PACKED = np.dtype([("token", "V6"), ("k1", "V6")])


@dataclass(frozen=True)
class Rule:
    """``size``-word n-grams; linked when ``den`` * intersection >= ``num`` * union."""

    size: int = 3
    num: int = 90
    den: int = 100

    def edges(self, top: int = 1 << 40) -> np.ndarray:
        """First sizes of the bands; linked sets are in one band or in neighbours."""
        steps = max(1, int(math.log(1.4) / math.log(self.den / self.num))) if self.num < self.den else 1
        e = [1]
        while e[-1] < top:
            x = e[-1]
            for _ in range(steps):
                x = x * self.den // self.num + 1
            e.append(x)
        return np.array(e, dtype=np.int64)

    def most_different(self, first: int, end: int) -> int:
        """By how many n-grams linked sets can differ of which the smaller has at least ``first`` and less than ``end``."""
        small = end - 1
        large = self.den * small // self.num
        return (small + large) * (self.den - self.num) // (self.den + self.num)

    def parts(self, first: int, end: int) -> tuple[int, int]:
        """(number of parts, empty parts that a set may have) for sets of at least ``first`` n-grams; linked sets agree
        on one part more than a set may have empty. No parts if only equal sets are linked."""
        differ = self.most_different(first, end)
        if not differ:
            return 0, 0
        best = None
        for spare in range(3 * differ + 10):
            m, k = differ + 1 + spare, spare + 1
            # at most: the ways to choose so many parts, times the chance that all n-grams miss them
            chance = math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + first * math.log1p(-k / m)
            if best is None or chance < best[0]:
                best = chance, m, spare
            if chance <= math.log(SPARSE_CHANCE):
                break
        return best[1:]


@lru_cache(maxsize=8)
def _tiling(rule: Rule) -> tuple[np.ndarray, list[tuple[int, int] | None]]:
    e = rule.edges(1 << 34)
    return e, [None] * len(e)


def band_parts(rule: Rule, band: int) -> tuple[int, int]:
    """:meth:`Rule.parts` of the tile of a band: its own sets and those of the next band."""
    edges, known = _tiling(rule)
    if known[band] is None:
        known[band] = rule.parts(int(edges[band]), int(edges[band + 1]))
    return known[band]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A-Z lower-cased, words split at ASCII white space."""
    w = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words; fewer words make one n-gram, none make none."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        k = min(size, len(words))
        x = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            x = _mix(x * _M1 + words[j : len(words) - k + 1 + j])
    return x


def gram_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct n-gram hashes (uint64) of a text."""
    return np.unique(gram_hashes(word_hashes(text), size))


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def short_key(key: bytes) -> int:
    """48 bits of a key: the name of a class in tokens and tiles. Classes that share it are candidates together."""
    return int.from_bytes(key[:6], "little")


def set_tokens(grams: np.ndarray, rule: Rule) -> np.ndarray:
    """The tokens of a sorted set: linked sets that differ have one in common."""
    edges, _ = _tiling(rule)
    n, band = len(grams), int(np.searchsorted(edges, len(grams), side="right")) - 1
    sums, found = None, []
    for tile in (band, band - 1):
        if tile < 0 or (tile < band and -(-rule.num * n // rule.den) >= edges[band]):
            continue
        m, spare = band_parts(rule, tile)
        if not m:
            continue
        part = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        with np.errstate(over="ignore"):
            if sums is None:
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(grams), dtype=np.uint64)])
            content = sums[np.append(first[1:], n)] - sums[first]
            seed = _mix(np.array([tile + 1], dtype=np.uint64) * _M1)
            found.append(_mix((content ^ seed) + part[first] * _M1))
            if m - len(first) > spare:  # such sets may agree on empty parts alone
                found.append(_mix(seed + _M3))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def signature(grams: np.ndarray) -> bytes:
    """Parity bitmap: a bit for each bucket, set if an odd number of n-grams fall in it; at least n bits, a power of 2.

    Folding the halves of a bitmap by xor gives the next narrower one. Two sets differ in at least as many n-grams as
    their bitmaps differ in bits.
    """
    bits = max(64, 1 << max(0, len(grams) - 1).bit_length())
    parity = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _fold(sig: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) narrowed to ``size`` bytes."""
    while sig.shape[1] > size:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


def may_link(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether sets of these sizes whose bitmaps differ in so many bits can reach the threshold: the overlap is at most
    (n1 + n2 - differ) / 2."""
    over2 = n1 + n2 - differ  # twice the bound; union = n1 + n2 - overlap
    return (over2 > 0) & (rule.den * over2 >= rule.num * (2 * (n1 + n2) - over2))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(F.col(text_col))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("xx"))


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _eight(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, :6] = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _tile_name(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The tile of a token on its own: of its bucket and its lowest 48 bits."""
    return _mix(low + bucket.astype(np.uint64) * _M1)


def pack_tokens(tokens: np.ndarray, k1: np.ndarray, shift: int) -> Iterator[tuple[int, bytes, bool]]:
    """(bucket, packed tokens, past) of one task's tokens; the bucket is what lies above ``shift``, and the lowest bit
    of a token marks it as held by HOT_IN_TASK classes or more. Of those tokens two classes stand for all, and the
    rows are given again as (tile, class) to go ``past`` the buckets."""
    order = np.lexsort((k1, tokens))
    tokens, k1 = tokens[order], k1[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (k1[1:] != k1[:-1])])
    tokens, k1 = tokens[fresh] & ~np.uint64(1), k1[fresh]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    count = np.diff(np.append(start, len(tokens)))
    hot = np.repeat(count >= HOT_IN_TASK, count)
    if hot.any():
        t, k = tokens[hot], k1[hot]
        pairs = np.stack([_tile_name(t >> np.uint64(shift), t & _LOW), k], axis=1)
        for i in range(0, len(pairs), _ROW_TOKENS):
            yield int(pairs[i, 0] & np.uint64(0x7FFFFFFF)), pairs[i : i + _ROW_TOKENS].tobytes(), True
        ends = np.zeros(len(tokens), dtype=bool)
        many = count >= HOT_IN_TASK
        ends[start[many]] = ends[start[many] + count[many] - 1] = True
        tokens = tokens | hot.astype(np.uint64)
        tokens, k1 = tokens[~hot | ends], k1[~hot | ends]
    bucket = (tokens >> np.uint64(shift)).astype(np.int64)
    packed = np.empty(len(tokens), dtype=_PACKED)
    packed["token"], packed["k1"] = _six(tokens), _six(k1)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for first, end in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        for i in range(first, end, _ROW_TOKENS):
            yield int(bucket[first]), packed[i : min(end, i + _ROW_TOKENS)].tobytes(), False


def shared_tokens(bucket: int, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, classes) of the tokens of a bucket that two or more classes have. The tile is a hash of its classes, so
    that tiles of the same classes are one; that of a marked token is the token."""
    rows = np.frombuffer(b"".join(packed), dtype=_PACKED)
    tokens, k1 = _eight(rows["token"]), _eight(rows["k1"])
    name = tokens >> np.uint64(1)
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    order = order[often]
    tokens, k1, name = tokens[order], k1[order], name[order]
    order = np.lexsort((k1, name))
    tokens, k1, name = tokens[order], k1[order], name[order]
    if not len(name):
        return name, k1
    first = np.concatenate([[True], name[1:] != name[:-1]])
    marked = np.maximum.reduceat(tokens & np.uint64(1), np.flatnonzero(first))
    marked = marked[np.cumsum(first) - 1]
    once = first | np.concatenate([[True], k1[1:] != k1[:-1]])
    k1, name, marked = k1[once], name[once], marked[once]
    start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    count = np.diff(np.append(start, len(name)))
    with np.errstate(over="ignore"):
        sets = np.add.reduceat(_mix(k1 * _M1 + _M2), start)
        own = _tile_name(np.full(len(name), bucket, dtype=np.uint64), name << np.uint64(1))
    tile = np.where(marked > 0, own, np.repeat(_mix(sets), count))
    many = np.repeat(count > 1, count) | (marked > 0)
    return tile[many], k1[many]


def gram_sets(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``sets(doc_id, n, key, k1, sig, xx)`` of all rows (key, k1 and sig null without words; ``xx`` a hash of the
    text), and ``tiles(tile, k1)``, which may repeat rows."""
    names = ["bucket", "past", "packed", "doc_id", "n", "key", "sig", "xx"]
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    buckets = 1 << max(6, min(MAX_BUCKETS, -(-input_bytes(docs) // BUCKET_BYTES)).bit_length())
    shift = 64 - (buckets.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens, firsts, count = [], [], 0

        def packed():
            t, k = np.concatenate(tokens), np.repeat(np.array(firsts, dtype=np.uint64), [len(t) for t in tokens])
            tokens.clear()
            firsts.clear()
            held: list[tuple] = []
            for row in pack_tokens(t, k, shift):
                held.append(row)
                if len(held) == 256:
                    yield blobs(held)
                    held.clear()
            if held:
                yield blobs(held)

        def blobs(rows):
            b, p, past = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(b, types[0]), pa.array(past, types[1]), pa.array(p, types[2]), *(pa.nulls(len(b), t) for t in types[3:])], names)

        for batch in batches:
            at, ns, keys, sigs = [], [], [], []
            for t in batch.column(1):
                g = np.unique(gram_hashes(word_hashes(t.as_py()), rule.size))
                key = set_key(g) if len(g) else None
                ns.append(len(g))
                keys.append(key)
                sigs.append(signature(g) if len(g) else None)
                at.append(len(ns) if key is None else int.from_bytes(key[6:9], "little"))
                if key is None or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                made = set_tokens(g, rule)
                if len(made):
                    tokens.append(made)
                    firsts.append(short_key(key))
                    count += len(made)
                if count >= PACK_TOKENS:
                    yield from packed()
                    count = 0
            none = pa.nulls(len(ns), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(at, types[0]), pa.nulls(len(ns), types[1]), none, batch.column(0), pa.array(ns, types[4]), pa.array(keys, types[5]), pa.array(sigs, types[6]), batch.column(2)], names)
        if tokens:
            yield from packed()

    out_names = ["tile", "k1", "doc_id", "n", "key", "sig", "xx"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def tiles(tile, k1):
            n = len(tile)
            return pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(k1.astype(np.int64)), *(pa.nulls(n, t) for t in types[3:])], out_names)

        for batch in batches:
            past, packed = batch.column(1), batch.column(2)
            sets = pc.is_null(packed)
            if pc.any(sets).as_py():
                own = batch.filter(sets)
                k1 = pa.array([None if k is None else short_key(k) for k in own.column(5).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(own.num_rows, pa.int64()), k1, *own.columns[3:]], out_names)
            for bucket, gone, raw in zip(batch.column(0).to_pylist(), past.to_pylist(), packed.to_pylist(), strict=True):
                if raw is None:
                    continue
                if gone:
                    pairs = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
                    yield tiles(np.ascontiguousarray(pairs[:, 0]), pairs[:, 1])
                    continue
                if bucket != now and held:
                    yield tiles(*shared_tokens(now, held))
                    held = []
                now = bucket
                held.append(raw)
        if held:
            yield tiles(*shared_tokens(now, held))

    made = _source(docs, id_col, text_col).mapInArrow(run, "bucket int, past boolean, packed binary, doc_id bigint, n bigint, key binary, sig binary, xx bigint")
    met = made.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "tile bigint, k1 bigint, doc_id bigint, n bigint, key binary, sig binary, xx bigint")
    both = written(met, "sets")
    sets = both.where("tile is null").drop("tile")
    sets._tessera_path = both._tessera_path
    return sets, both.where("tile is not null").select("tile", "k1")


def _arrays(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """``key, grams`` (sorted uint64, as bytes) of the wanted classes, each from the row that stands for it."""
    reps = bounded_broadcast(written(classes.join(wanted, "key", "left_semi").select(F.col("rep.doc_id").alias("rep"), F.col("rep.xx").alias("rep_xx")), "representatives"))
    src = _source(docs, id_col, text_col)
    texts = src.join(reps, src["doc_id"].eqNullSafe(reps["rep"]) & (F.col("xx") == F.col("rep_xx")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gram_set(t.as_py(), rule.size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, made), pa.binary()), pa.array([g.tobytes() for g in made], pa.binary())], ["key", "grams"])

    # a row that is repeated gives its array twice, which repeats a check and no more
    out = written(texts.mapInArrow(run, "key binary, grams binary"), "arrays")
    drop(reps)
    return out


def _verified(pairs: DataFrame, arrays: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked, by exact intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(rule.den * both >= rule.num * (len(p) + len(q) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    side = lambda x: arrays.select(F.col("key").alias(x), F.col("grams").alias(f"g{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def _tile_pairs(rows: DataFrame, rule: Rule, forest: bool) -> DataFrame:
    """Pairs (a, b) that share a tile, are of a size and of different components, and whose bitmaps allow a link.

    ``rows``: tile, one, two (the pair of blocks), own (the row's block), key, n, comp, sig. Of two different blocks
    only pairs across them count. With ``forest``, a tile names only pairs that join components which it has not
    joined yet.
    """
    at = ["tile", "one", "two"]
    placed = rows.select(*at, "own", "n", "key", "comp", "sig").repartition(*at).sortWithinPartitions(*at, "key")

    def few_pairs(across, own, n, keys, comps, sigs):
        """As below, without arrays."""
        bits = [(8 * len(s), int.from_bytes(s, "little")) for s in sigs]
        out = []
        for x in range(len(keys)):
            for y in range(x + 1, len(keys)):
                small, large = sorted((n[x], n[y]))
                if comps[x] == comps[y] or (across and own[x] == own[y]) or rule.den * small < rule.num * large:
                    continue
                (p, a), (q, b) = sorted((bits[x], bits[y]))
                while q > p:
                    q //= 2
                    b = (b ^ (b >> q)) & ((1 << q) - 1)
                differ = (a ^ b).bit_count()
                over2 = small + large - differ
                if over2 > 0 and rule.den * over2 >= rule.num * (2 * (small + large) - over2):
                    out.append((differ, x, y))
        return joined(out, comps, keys)

    def joined(edges, comps, keys):
        """The edges (differ, x, y) as pairs of keys; of a forest only those that join, the likeliest first."""
        comps, left = list(comps), len(set(comps))
        out = []
        for _, x, y in sorted(edges) if forest else edges:
            if forest:
                if left == 1:
                    break
                if comps[x] == comps[y]:
                    continue
                old, left = comps[y], left - 1
                comps = [comps[x] if c == old else c for c in comps]
            out.append((min(keys[x], keys[y]), max(keys[x], keys[y])))
        return out

    def pairs_of(one, two, own, n, keys, comps, sigs):
        out = []
        if len(keys) < 2 or len(set(comps)) < 2:
            return out
        if len(keys) <= 6:
            return few_pairs(one != two, own, n, keys, comps, sigs)
        words = _fold_all(sigs, min(len(s) for s in sigs))
        comp = np.unique([c.hex() for c in comps], return_inverse=True)[1]
        own, n = np.array(own), np.array(n)
        for x in range(len(keys) - 1):
            y = np.arange(x + 1, len(keys))
            y = y[(comp[y] != comp[x]) & ((own[y] != own[x]) | (one == two))]
            y = y[rule.den * np.minimum(n[y], n[x]) >= rule.num * np.maximum(n[y], n[x])]
            if not len(y):
                continue
            differ = np.bitwise_count(words[y] ^ words[x]).sum(axis=1).astype(np.int64)
            ok = may_link(n[y], n[x], differ, rule)
            out += [(d, x, z) for d, z in zip(differ[ok].tolist(), y[ok].tolist(), strict=True)]
        return joined(out, comp.tolist(), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sent: set[tuple[bytes, bytes]] = set()

        def close():
            cols = list(zip(*held, strict=True))
            found = [p for p in pairs_of(held[0][1], held[0][2], *cols[3:]) if p not in sent]
            if len(sent) > 200_000:
                sent.clear()
            sent.update(found)
            return found

        def pack(out):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != r[:3]:
                    out += close()
                    held.clear()
                if held and held[-1][5] == r[5]:
                    continue  # a row of the tile that came twice
                held.append(r)
            if out:
                yield pack(out)
        if held and (out := close()):
            yield pack(out)

    return placed.mapInArrow(run, "a binary, b binary").distinct()


def _fold_all(sigs: list[bytes], size: int) -> np.ndarray:
    return np.concatenate([_fold(np.frombuffer(s, dtype=np.uint8)[None], size) for s in sigs]).view(np.uint64)


def _dealt(rows: DataFrame, turn: int, last: bool) -> DataFrame:
    """``rows(tile, key, n, comp)`` of tiles with several components, with the pairs of blocks ``one, two`` in which
    each row is compared, and its own block. A forest round takes each block by itself. In the last round the tile's
    largest component has blocks of its own, which meet all other blocks but not each other."""
    parts = rows.groupBy("tile", "comp").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    live = parts.groupBy("tile").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.max("n").alias("most")).where("k > 1")
    # a signature has at most a quarter of a byte for each n-gram
    size = F.greatest(F.lit(2), F.least(F.lit(TILE), F.floor(TILE_BYTES / (F.col("most") / 4 + 64))))
    rows = rows.join(live.select("tile", "m", F.col("top.comp").alias("top"), F.col("top.c").alias("c"), size.alias("size")), "tile")
    block = lambda count: F.pmod(F.xxhash64("key", F.lit(turn)), count).cast("int")
    if not last:
        own = block(F.ceil(F.col("m") / F.col("size")))
        return rows.withColumn("own", own).select("tile", "key", "n", "comp", "own", F.col("own").alias("one"), F.col("own").alias("two"))
    rest, tops = (F.ceil(x / F.col("size")).cast("int") for x in (F.col("m") - F.col("c"), F.col("c")))
    rows = rows.withColumns({"rest": rest, "tops": tops, "is_top": F.col("comp") == F.col("top")})
    rows = rows.withColumn("own", F.when(F.col("is_top"), F.col("rest") + block(F.col("tops"))).otherwise(block(F.col("rest"))))
    others = F.sequence(F.lit(0), F.when(F.col("is_top"), F.col("rest") - 1).otherwise(F.col("rest") + F.col("tops") - 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("tile", "key", "n", "comp", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))


def linked_classes(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``sets`` of all rows and ``labels(node, comp)`` of the classes that are linked to others."""
    spark = docs.sparkSession
    sets, shared = gram_sets(docs, rule, id_col, text_col)
    tiles = written(shared.distinct(), "tiles")
    near = bounded_broadcast(written(tiles.select("k1").distinct(), "near"))
    # minima combine before the shuffle; the sets of a class are equal, so its least row has its size and signature
    classes = sets.where("key is not null").join(near, "k1", "left_semi").groupBy("key", "k1").agg(F.min(F.struct("doc_id", "xx")).alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = written(classes, "classes")
    # two classes of one k1 are candidates both; what links is decided on sets alone
    cand = written(tiles.join(classes.select("k1", "key", "n"), "k1").select("tile", "key", "n"), "candidates")
    drop(tiles, near)
    links, labels = None, None
    for turn in range(FOREST_ROUNDS + 1):
        last = turn == FOREST_ROUNDS
        rows = cand.withColumn("comp", F.col("key"))
        if labels is not None:
            rows = cand.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        if turn == 0:  # each class in the least of its even and of its odd tiles: near copies share them
            least = rows.groupBy("key").agg(F.min(F.when(F.col("tile") % 2 == 0, F.col("tile"))).alias("a"), F.min(F.when(F.col("tile") % 2 != 0, F.col("tile"))).alias("b"))
            rows = rows.join(least.select("key", F.explode(F.array("a", "b")).alias("tile")), ["key", "tile"])
        dealt = _dealt(rows, turn, last).join(classes.select("key", "sig"), "key")
        pairs = written(_tile_pairs(dealt, rule, not last), "pairs")
        arrays = _arrays(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), id_col, text_col, rule)
        fresh = written(_verified(pairs, arrays, rule), "links")
        drop(pairs, arrays)
        links = fresh if links is None else links.unionByName(fresh)
        if not fresh.isEmpty():
            labels = components(links)
    if labels is None:
        labels = spark.createDataFrame([], "node binary, comp binary")
    drop(cand, classes)
    return sets, labels


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id among the rows that can be reached by links, itself included. A text
    without words (null, empty, white space) has an empty set and is linked with nothing. Equal sets are linked;
    repeated rows come back as often as they are there. A null doc_id counts as larger than all others. An empty table
    gives an empty result; other columns are not read. Equality of n-grams is that of 64-bit hashes, and of sets that
    of 128-bit digests.
    """
    rows, least = _members(docs, rule, id_col, text_col)
    # rows and least are tables, so the partition of a hot component can be split
    return rows.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))


def _members(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows(doc_id, xx, n, comp)`` and each component's ``least`` row as (doc_id, xx); null ids come last."""
    sets, labels = linked_classes(docs, rule, id_col, text_col)
    rows = written(sets.join(labels.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "xx", "n", F.coalesce("comp", "key").alias("comp")), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xx"))
    least = written(rows.where("comp is not null").groupBy("comp").agg(first.alias("least")), "least")
    drop(sets)
    return rows, least


def drop_near_duplicates(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, a row with its smallest doc_id. Texts without words all stay.

    Of rows that repeat id and text one stays. Columns of any names are returned as they are; null ids count as
    largest; an empty table gives an empty result.
    """
    rows, least = _members(docs, rule, id_col, text_col)
    again = rows.where("comp is not null").groupBy("doc_id", "xx").count().where("count > 1").select(F.col("doc_id").alias("id"), "xx", F.lit(True).alias("again"))
    first = least.select("least.doc_id", F.col("least.xx").alias("hash"))
    kept = first.join(again, first["doc_id"].eqNullSafe(again["id"]) & (first["hash"] == again["xx"]), "left")
    kept = written(kept.select("doc_id", "hash", F.coalesce("again", F.lit(False)).alias("again")), "kept")
    text = text_or_empty(F.col(text_col))
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("hash"))
    return rows_of(src, kept).unionByName(docs.where(~text.rlike(f"[^{SPACE_CLASS[1:-1]}]")))
