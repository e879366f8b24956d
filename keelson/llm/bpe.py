"""Byte-level BPE with a segment tree over byte positions."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that a worker remembers because they came again, those it remembers from their first time
#: on, and the longest of them in characters.
REMEMBERED, MET_ONCE, REMEMBERED_CHARS = 140_000, 60_000, 48
#: Pieces of at most so many bytes are merged together with others of like length.
LONGEST_TOGETHER = 64
#: Texts are encoded together up to so many characters.
TOGETHER_CHARS = 400_000


class ByteBPE:
    """Encoder and decoder for a rank file (lines of base64 token and rank).

    Texts are cut by `pattern`; each piece is merged for itself: lowest rank first, leftmost
    among equals. The leaves of a segment tree are the byte positions; leaf i holds the rank of
    the pair that starts at i together with i, so the root is the leftmost minimum. A merge
    changes three leaves (its own, the swallowed one, the live neighbour before), each in a
    logarithmic number of steps, so that a piece of n bytes takes O(n log n). Short pieces run
    through the same steps in arrays, thousands at a time.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.known: dict[str, bytes] = {}
        self.met: dict[str, bytes] = {}
        self.byte_ranks = np.array([ranks.get(bytes([i]), -1) for i in range(256)])
        self.pair_keys: np.ndarray | None = None

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        lines = Path(path).read_bytes().splitlines()
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        never = 1 << 62
        base = 1 << (n - 1).bit_length()
        tree = [never] * (2 * base)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[base + i] = rank << shift | i
        for k in range(base - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        low, rank_of = (1 << shift) - 1, ranks.get
        while (top := tree[1]) != never:
            i = top & low
            j = after[i]
            here = part[i] = part[i] + part[j]
            k = after[i] = after[j]
            changed = [(base + j, never)]
            if k < n:
                before[k] = i
                rank = rank_of(here + part[k])
                changed.append((base + i, never if rank is None else rank << shift | i))
            else:
                changed.append((base + i, never))
            h = before[i]
            if h >= 0:
                rank = rank_of(part[h] + here)
                changed.append((base + h, never if rank is None else rank << shift | h))
            for k, value in changed:
                if tree[k] == value:
                    continue
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where they make none."""
        if self.pair_keys is None:
            ranks, keys, merged = self.ranks, [], []
            for token, rank in ranks.items():
                for cut in range(1, len(token)):
                    a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                    if a is not None and b is not None:
                        keys.append(a << 32 | b)
                        merged.append(rank)
            order = np.argsort(np.array(keys, np.int64))
            self.pair_keys, self.pair_values = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_values[at], -1) if len(self.pair_keys) else np.full(len(left), -1)

    def _merge_alike(self, pieces: list[bytes], base: int) -> list[bytes]:
        """merge() for pieces of at most `base` bytes at once, as packed int32: a row of arrays for
        each piece, a tree in each row, and every round does the next merge of every piece."""
        n, width = len(pieces), base.bit_length() - 1
        never = np.iinfo(np.int64).max
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(base, b"\0") for p in pieces), np.uint8).reshape(n, base)
        places = np.arange(base)
        ids = np.where(places < lengths[:, None], self.byte_ranks[raw], -1)
        after = np.minimum(np.broadcast_to(places + 1, (n, base)), lengths[:, None])
        after = np.concatenate([after, lengths[:, None]], axis=1)
        before = np.broadcast_to(np.arange(-1, base), (n, base + 1)).copy()
        tree = np.full((n, 2 * base), never)
        row, col = np.nonzero(ids[:, 1:] >= 0)
        rank = self._pair_ranks(ids[row, col], ids[row, col + 1])
        tree[row, base + col] = np.where(rank >= 0, rank << width | col, never)
        for k in range(base - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        flat = tree.reshape(-1)
        live = np.flatnonzero(tree[:, 1] != never)
        while len(live):
            top = tree[live, 1]
            i = top & (base - 1)
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = top >> width, -1
            after[live, i], before[live, k] = k, i
            h = before[live, i]
            behind, ahead = k < lengths[live], h >= 0
            value = np.full((len(live), 3), never)
            new = self._pair_ranks(ids[live[behind], i[behind]], ids[live[behind], k[behind]])
            value[behind, 1] = np.where(new >= 0, new << width | i[behind], never)
            new = self._pair_ranks(ids[live[ahead], h[ahead]], ids[live[ahead], i[ahead]])
            value[ahead, 2] = np.where(new >= 0, new << width | h[ahead], never)
            value[~ahead, 2] = value[~ahead, 1]
            at = np.stack([j, i, np.where(ahead, h, i)], axis=1) + base
            start = (live * 2 * base)[:, None]
            flat[start + at] = value
            for _ in range(width):
                at >>= 1
                flat[start + at] = np.minimum(flat[start + 2 * at], flat[start + 2 * at + 1])
            live = live[tree[live, 1] != never]
        kept = ids >= 0
        if self.byte_ranks.min() < 0:
            alone = (places < lengths[:, None]) & (self.byte_ranks[raw] < 0)
            if alone.any():
                raise KeyError(f"no rank for byte {int(raw[alone][0])}")
        data, ends = ids[kept].astype(np.int32).tobytes(), (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def merge_many(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces: whole tokens first, then classes of like length together."""
        out: dict[str, bytes] = {}
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONGEST_TOGETHER:
                out[piece] = np.array(self.merge(raw), np.int32).tobytes()
            else:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for base, members in classes.items():
            for k in range(0, len(members), 2048):
                part = members[k : k + 2048]
                out.update(zip((p for p, _ in part), self._merge_alike([r for _, r in part], base), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as int32."""
        get = self.known.get
        cut = [self.pieces(text) for text in texts]
        found = [list(map(get, pieces)) for pieces in cut]
        gaps = [(k, [i for i, packed in enumerate(packed_all) if packed is None]) for k, packed_all in enumerate(found) if None in packed_all]
        if gaps:
            missing = {cut[k][i] for k, places in gaps for i in places}
            again = {p: self.met.pop(p) for p in missing.intersection(self.met)}
            new = self.merge_many(list(missing - again.keys()))
            either = again | new
            for k, places in gaps:
                pieces, packed_all = cut[k], found[k]
                for i in places:
                    packed_all[i] = either[pieces[i]]
            for held, most, more in ((self.known, REMEMBERED, again), (self.met, MET_ONCE, new)):
                if len(held) + len(more) > most:
                    held.clear()
                held.update((p, x) for p, x in more.items() if len(p) <= REMEMBERED_CHARS)
        return [np.frombuffer(b"".join(packed), np.int32) for packed in found]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer for each Python worker and rank file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.load(path, pattern)
    return _loaded[path, pattern]


def tokenise(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int), decoded (what the ids decode to).

    Whole texts are encoded, null as empty (no ids, no bytes); pieces and their ids are
    remembered by each worker within fixed bounds. Rows pass one by one: repeated rows repeat,
    an empty table stays empty, other columns are not read. `path` must exist on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            sizes = np.cumsum([len(t or "") for t in batch.column(1).to_pylist()]) // TOGETHER_CHARS
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for at, end in zip(starts, starts[1:], strict=False):
                part = batch.slice(at, end - at)
                ids = bpe.encode_many([text or "" for text in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def decode(encoded: DataFrame, path: str, pattern: str = "", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: doc_id, decoded.

    Null and empty lists of ids decode to nothing; an id without a token raises. Rows pass one by
    one: repeated rows repeat, an empty table stays empty, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            out = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def with_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what tokenise() returns, row by row: a
    document without tokens has 0 and the digests of nothing, an empty table stays empty."""
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
