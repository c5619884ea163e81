"""Sampled SentencePiece encoding and lossless decoding (operator 10).

The lattice of a text has a node at every byte and an edge for every vocabulary
piece that stands there (a space is the piece letter U+2581); bytes of
characters that the vocabulary lacks get byte-piece edges. An edge weighs
``rank ** -alpha``: the model file holds merge ranks, not probabilities, so a
piece's probability follows Zipf's law in its rank, and ``alpha`` is the
inverse temperature. Segmentations are drawn exactly in proportion to the
product of their weights: forward filtering sums the weight of all paths to
each node, backward sampling walks from the end and picks an incoming edge by
its share. Random numbers are a hash of (seed, row key, byte position): equal
for every run, partitioning and retry.

No piece crosses a place where a space run begins or beside a line feed, so
the lattice falls into independent units there; the forward pass runs once per
distinct unit of a slab, the backward pass once per occurrence.

Decoding joins the bytes of the pieces. ``decode(encode(t)) == t`` for every
text, also with literal U+2581, control characters or no known character.

Defined cases: null text gives null; empty text gives no ids; a null key
counts as 0; repeated rows (same key and text) give the same ids; unknown ids
or ids of control pieces decode to nothing; bytes that are not UTF-8 decode to
U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import mix64, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.6
SEED = 20
ZIPF_SHIFT = 2.7
BYTE_LOG_WEIGHT = -20.0
UNIT_SLAB = 1 << 18   # bytes of text whose lattice is held at a time: some 150 bytes of memory for each


class Vocabulary:
    """Pieces as byte strings with weights, in arrays that vectorised look-ups read."""

    def __init__(self, pieces: list[tuple[bytes, float]], byte_ids: list[int], alpha: float = ALPHA):
        """``pieces[i]``: bytes of id i (empty: never used) and its rank; ``byte_ids[b]``: id of byte b."""
        self.raw = [p for p, _ in pieces]
        usable = [i for i, (p, r) in enumerate(pieces) if p and r >= 0]
        sizes = np.array([len(pieces[i][0]) for i in usable])
        self.lengths = sorted({int(x) for x in sizes} | {1})
        self.tables = {}  # by length: sorted codes, where they stand in ``ids``, a bitmap that ends most look-ups
        all_ids = [np.array(byte_ids, dtype=np.int32)]
        for size in self.lengths:
            ids = np.array([i for i, n in zip(usable, sizes) if n == size], dtype=np.int32)
            grid = np.frombuffer(b"".join(pieces[i][0] for i in ids), np.uint8).reshape(-1, size)
            codes = _rows(grid)
            order = np.argsort(codes, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[_slot(codes)] = True
            self.tables[size] = (codes[order], sum(map(len, all_ids)), seen)
            all_ids.append(ids[order])
        self.ids = np.concatenate(all_ids)
        ranks = np.array([pieces[i][1] for i in self.ids[256:]], dtype=float)
        self.logs = np.concatenate([np.full(256, BYTE_LOG_WEIGHT), -alpha * np.log(ranks + ZIPF_SHIFT)])
        lone = {p for p, r in pieces if r >= 0 and p}
        self.known = frozenset(c for c in (p.decode("utf-8", "ignore") for p in lone) if len(c) == 1)
        self.sizes = np.array([len(p) for p in self.raw], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.ascii_known = np.array([chr(b) in self.known for b in range(128)])


def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Read a SentencePiece model file (on the driver; tasks get the arrays)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, rank = [], [0] * 256, 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            pieces.append((bytes([value]), -1.0))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append((b"", -1.0))
        else:
            pieces.append((model.id_to_piece(i).replace("▁", " ").encode(), float(rank)))
            rank += 1
    return Vocabulary(pieces, byte_ids, alpha)


def _rows(grid: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes (injective up to 8 bytes)."""
    out = np.zeros(len(grid), dtype=np.uint64)
    for k in range(grid.shape[1]):
        if k and k % 8 == 0:
            out = mix64(out)
        out = (out << np.uint64(8)) ^ grid[:, k]
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def units(raw: bytes) -> np.ndarray:
    """Starts of the independent parts: where a run of spaces begins and around line feeds."""
    buf = np.frombuffer(raw, np.uint8)
    space, feed = buf == 32, buf == 10
    begin = np.ones(len(buf), dtype=bool)
    begin[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    return np.flatnonzero(begin)


def _unknown(vocab: Vocabulary, raw: bytes) -> np.ndarray:
    """True at bytes of characters that are not pieces themselves."""
    buf = np.frombuffer(raw, np.uint8)
    out = np.zeros(len(buf), dtype=bool)
    low = buf < 128
    out[low] = ~vocab.ascii_known[buf[low]]
    if not low.all():
        text = raw.decode("utf-8")
        for c in set(text):
            if ord(c) > 127 and c not in vocab.known:
                code, at = c.encode("utf-8"), -1
                while (at := raw.find(code, at + 1)) >= 0:
                    out[at:at + len(code)] = True
    return out


def lattice(vocab: Vocabulary, raw: bytes, starts: np.ndarray):
    """Forward filtering of the units of ``raw``; a node stands behind each byte.

    Returns each node's first edge, and of the edges (grouped by node, longest
    first) the cumulative shares, piece lengths and piece ids. What a unit gets
    does not depend on the units beside it.
    """
    n = len(raw)
    sizes = np.diff(np.append(starts, n))
    inner = np.arange(n) - np.repeat(starts, sizes)  # place inside the unit
    room = np.repeat(sizes, sizes) - inner           # bytes from here to the unit's end
    longest = int(sizes.max())
    columns = [k for k in vocab.lengths if k <= longest]
    padded = np.frombuffer(raw + b"\0" * longest, np.uint8)
    entry = np.full((n, len(columns)), -1, dtype=np.int32)  # by node and length: place in vocab.ids
    at = np.arange(n)
    code = np.zeros(n, dtype=np.uint64)
    done = 0
    for col, size in enumerate(columns):
        fits = room[at] >= size
        if not fits.all():
            at, code = at[fits], code[fits]
        while done < size:
            if done and done % 8 == 0:
                code = mix64(code)
            code = (code << np.uint64(8)) ^ padded[at + done]
            done += 1
        keys, base, seen = vocab.tables[size]
        maybe = np.flatnonzero(seen[_slot(code)])
        if not len(maybe):
            continue
        hit = np.searchsorted(keys, code[maybe])
        hit[hit == len(keys)] = 0
        good = keys[hit] == code[maybe]
        entry[at[maybe[good]] + size - 1, len(columns) - 1 - col] = base + hit[good]
    lone = np.flatnonzero(_unknown(vocab, raw))
    entry[lone, len(columns) - 1] = padded[lone]
    flat = np.flatnonzero(entry.ravel() >= 0)
    node = flat // len(columns)
    length = np.array(columns[::-1])[flat - node * len(columns)]
    place = entry.ravel()[flat]
    weight = vocab.logs[place]
    counts = np.bincount(node, minlength=n)
    ptr = np.concatenate(([0], np.cumsum(counts)))
    # total weight of all paths to each node, place by place: earlier nodes are done before
    order = np.argsort(inner.astype(np.uint16) if longest < 65536 else inner, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(inner, minlength=longest))))
    logs = np.full(n + 1, -np.inf)
    logs[n] = 0.0  # the start of every unit
    before = np.where(length > inner[node], n, node - length)
    share = np.zeros(len(node))
    for p in range(longest):
        into = order[cuts[p]:cuts[p + 1]]
        c = counts[into]
        if not c.all():
            into, c = into[c > 0], c[c > 0]
            if not len(into):
                continue
        rel = np.cumsum(c) - c
        edge = np.arange(int(rel[-1] + c[-1])) + np.repeat(ptr[into] - rel, c)
        total = weight[edge] + logs[before[edge]]
        top = np.maximum.reduceat(total, rel)
        top[top == -np.inf] = 0.0
        part = np.exp(total - np.repeat(top, c))
        whole = np.add.reduceat(part, rel)
        with np.errstate(divide="ignore"):
            logs[into] = top + np.log(whole)
        whole[whole == 0] = 1.0
        share[edge] = part / np.repeat(whole, c)
    # a node's last edge of positive weight closes its share, whatever the rounding
    real = np.flatnonzero(share > 0)
    last = real[np.append(node[real][1:] != node[real][:-1], True)] if len(real) else real
    edge, k = ptr[:-1][counts > 1], 1
    while len(edge):
        share[edge + k] += share[edge + k - 1]
        k += 1
        edge = edge[counts[node[edge]] > k]
    share[last] = 2.0
    return ptr[:-1], share, length.astype(np.uint16), vocab.ids[place]


class Arena:
    """The lattices of the first distinct units that a task meets, up to ``limit`` bytes of them."""

    def __init__(self, vocab: Vocabulary, limit: int = 1 << 19):
        self.vocab, self.limit = vocab, limit
        self.pool = b""
        self.codes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
        self.ptr, self.share = np.zeros(0, int), np.zeros(0)
        self.length, self.ids = np.zeros(0, np.uint16), np.zeros(0, np.int32)

    def get(self, raw: bytes, begin: np.ndarray, stop: np.ndarray):
        """Start of each unit of ``raw`` in the node space, and the lattice arrays of that space."""
        buf = np.frombuffer(raw, np.uint8)
        own = stop - begin
        codes, first, which = np.unique(word_hashes(buf, begin, stop, fold=False),
                                        return_index=True, return_inverse=True)
        sizes = own[first]
        held = np.searchsorted(self.codes, codes)
        held[held == len(self.codes)] = 0
        known = (self.codes[held] == codes) if len(self.codes) else np.zeros(len(codes), dtype=bool)
        new = np.flatnonzero(~known)
        fresh = b"".join([raw[a:b] for a, b in zip(begin[first[new]].tolist(), stop[first[new]].tolist())])
        fresh_starts = np.cumsum(sizes[new]) - sizes[new]
        starts = np.zeros(len(codes), dtype=np.int64)
        starts[new] = fresh_starts + len(self.pool)
        starts[known] = self.starts[held[known]]
        pool = self.pool + fresh
        # equal hashes must mean equal bytes
        all_sizes = sizes.copy()
        all_sizes[known] = self.sizes[held[known]]
        same = (own == all_sizes[which]).all()
        if same:
            take = np.arange(len(buf)) - np.repeat(begin - starts[which], own)
            same = (np.frombuffer(pool, np.uint8)[take] == buf).all()
        if not same:  # two units share a hash: number them by their bytes, without the arena
            numbers: dict[bytes, int] = {}
            which = np.array([numbers.setdefault(raw[a:b], len(numbers))
                              for a, b in zip(begin.tolist(), stop.tolist())])
            starts = np.cumsum([0] + [len(u) for u in numbers][:-1])
            return (starts[which], *lattice(self.vocab, b"".join(numbers), starts))
        if not len(new):
            return starts[which], self.ptr, self.share, self.length, self.ids
        ptr, share, length, ids = lattice(self.vocab, fresh, fresh_starts)
        space = (np.concatenate([self.ptr, ptr + len(self.share)]), np.concatenate([self.share, share]),
                 np.concatenate([self.length, length]), np.concatenate([self.ids, ids]))
        if len(pool) <= self.limit:
            self.pool = pool
            self.ptr, self.share, self.length, self.ids = space
            put = np.searchsorted(self.codes, codes[new])
            self.codes = np.insert(self.codes, put, codes[new])
            self.starts = np.insert(self.starts, put, starts[new])
            self.sizes = np.insert(self.sizes, put, sizes[new])
        return (starts[which], *space)


def uniform(keys: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    x = mix64(keys + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def sample(arena: Arena, parts: list[tuple[int, np.uint64, int, bytes]], seed: int):
    """Draw segmentations of text parts (row, key, byte place in the row, bytes).

    Returns arrays sorted by (row, place): row, place and id of every piece.
    """
    raw = b"".join(p[3] for p in parts)
    base = np.cumsum([0] + [len(p[3]) for p in parts[:-1]])
    begin = np.concatenate([units(p[3]) + b for p, b in zip(parts, base)])
    stop = np.append(begin[1:], len(raw))
    at, ptr, share, lengths, ids = arena.get(raw, begin, stop)
    part = np.searchsorted(base, begin, side="right") - 1
    row = np.array([p[0] for p in parts])[part]
    key = np.array([p[1] for p in parts], dtype=np.uint64)[part]
    place = np.array([p[2] for p in parts], dtype=np.int64)[part] + begin - base[part]
    left = stop - begin  # bytes of the unit not yet covered, from its end
    out_row, out_place, out_id = [], [], []
    while len(left):
        edge = ptr[at + left - 1]
        u = uniform(key, place + left, seed)
        more = np.flatnonzero(share[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[share[edge[more]] <= u[more]]
        left = left - lengths[edge]
        out_row.append(row)
        out_place.append(place + left)
        out_id.append(ids[edge])
        live = left > 0
        row, key, place, left, at = row[live], key[live], place[live], left[live], at[live]
    r, p, i = (np.concatenate(x) for x in (out_row, out_place, out_id))
    order = np.lexsort((p, r))
    return r[order], p[order], i[order]


def encode_texts(arena: Arena, keys, texts, seed: int = SEED) -> list:
    """Ids of each text (None for None)."""
    found = [None if t is None else [] for t in texts]
    held, total = [], 0

    def flush():
        if held:
            r, _, ids = sample(arena, held, seed)
            lo = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            for a, b in zip(lo, np.append(lo[1:], len(r))):
                found[r[a]].append(ids[a:b])
    row_keys = mix64(np.array([0 if k is None or k != k else int(k) for k in keys], dtype=np.int64).view(np.uint64))
    for k, text in enumerate(texts):
        if not text:
            continue
        raw, place = text.encode("utf-8"), 0
        for piece in _parts(raw):
            held.append((k, row_keys[k], place, piece))
            place += len(piece)
            total += len(piece)
            if total >= UNIT_SLAB:
                flush()
                held.clear()
                total = 0
    flush()
    return [None if f is None else np.concatenate(f) if f else np.zeros(0, np.int32) for f in found]


def _parts(raw: bytes):
    """Cut a long text at line feeds or before spaces: places that no piece crosses."""
    at = 0
    while len(raw) - at > UNIT_SLAB:
        feed = raw.rfind(b"\n", at + 1, at + UNIT_SLAB)
        gap = raw.rfind(b" ", at + 1, at + UNIT_SLAB)
        while gap > at and raw[gap - 1] == 32:
            gap -= 1
        end = max(feed, gap)
        if end <= at:
            nexts = [x for x in (raw.find(b"\n", at + UNIT_SLAB), raw.find(b" ", at + UNIT_SLAB)) if x > 0]
            if not nexts:
                break
            end = min(nexts)
            if raw[end - 1] == 32 and raw[end] == 32:
                break
        yield raw[at:end]
        at = end
    yield raw[at:]


def decode_ids(vocab: Vocabulary, ids) -> str | None:
    if ids is None:
        return None
    ids = np.asarray(ids, dtype=np.int64)
    ids = ids[(ids >= 0) & (ids < len(vocab.sizes))]
    sizes = vocab.sizes[ids]
    if not int(sizes.sum()):
        return ""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    take = np.arange(int(sizes.sum())) - np.repeat(first - vocab.starts[ids], sizes)
    return vocab.bytes[take].tobytes().decode("utf-8", "replace")


def _small(it, rows: int = 500):
    """Batches of at most ``rows`` rows: ids are handed on before the next are made."""
    for keys, texts in it:
        for lo in range(0, len(texts), rows):
            yield list(keys.iloc[lo:lo + rows]), list(texts.iloc[lo:lo + rows])


def encoder(vocab: Vocabulary, seed: int = SEED):
    """A column function (key, text) -> array of piece ids."""
    @F.pandas_udf("array<int>")
    def encode(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        arena = Arena(vocab)
        for keys, texts in _small(it):
            yield pd.Series(encode_texts(arena, keys, texts, seed), dtype=object)
    return encode


def checked_encoder(vocab: Vocabulary, seed: int = SEED):
    """A column function (key, text) -> (ids, lossless): encoded, decoded and compared in one task."""
    @F.pandas_udf("ids array<int>, lossless boolean")
    def encode(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        arena = Arena(vocab)
        for keys, texts in _small(it):
            ids = encode_texts(arena, keys, texts, seed)
            same = [decode_ids(vocab, i) == t for i, t in zip(ids, texts)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "lossless": same})
    return encode


def decoder(vocab: Vocabulary):
    """A column function: array of piece ids -> text."""
    @F.pandas_udf("string")
    def decode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield pd.Series([decode_ids(vocab, x) for x in batch], dtype=object)
    return decode


def encoded(docs, vocab: Vocabulary | None = None, seed: int = SEED, id_col: str = "doc_id",
            text_col: str = "text"):
    """One row per document row: doc_id, text, ids."""
    vocab = vocab or load()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       encoder(vocab, seed)(F.col(id_col), F.col(text_col)).alias("ids"))


def round_trip(docs, vocab: Vocabulary | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document row: doc_id, n_tokens, ids, and whether the ids decode to the text again."""
    encode = checked_encoder(vocab or load(), seed)
    return (docs.select(F.col(id_col).alias("doc_id"), encode(F.col(id_col), F.col(text_col)).alias("x"))
            .select("doc_id", F.coalesce(F.size("x.ids"), F.lit(0)).alias("n_tokens"), "x.ids", "x.lossless"))
