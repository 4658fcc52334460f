"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Words become 64-bit hashes; the sorted hashes of the training words are level 1, and a word's id is its rank. A node of
level n is a run of n words. The words that follow a node stand beside each other, each written as its place among the
words that follow the node without its first word (at level 2: as its id), so ids are small where contexts are long.
Ranges are made one increasing sequence by adding where the last range ended; sequence and range pointers are kept in
Elias-Fano form. A lookup finds the shorter run first, and searches the longer context's range for that place by
successor search. Probabilities (absolute discounting, interpolated with the next lower level) and back-off weights
are log10 values quantised to 16 bits.

Counting: tasks sum n-grams in sorted arrays of bounded size and send them, compressed, to shards of contexts; each
shard is merged, and then smoothed with the discount of the whole level and written as one file in the shared folder,
which scoring tasks memory-map. Every n-gram of every training text counts; nothing is pruned, and the number of shards
changes no score. Levels are built one after the other, each reading the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm import eliasfano, files
from tephra.llm.quality import held_out
from tephra.llm.shingles import batches_of, word_hashes
from tephra.session import remove, scratch, tidy

#: Log10 probabilities lie in [-STEP * 65535, 0].
STEP = 16 / 65535
#: Bytes and lookups that are worked on together, so that what lies between stays in the processor's cache.
NEAR = 1 << 17
BLOCK = 1 << 14
END = np.uint64(0x5BD1E995A5A5A5A5)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def hashed(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with one END after each text, bounds). Only A-Z are lowered; words are runs of anything but ASCII white space."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in batches_of([len(p) for p in parts], NEAR):
        words, starts, _ = word_hashes(b" ".join(parts[a:b]), SPACE)
        last = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts[a:b]]))
        found.append(np.insert(words, last, END))
        sizes.append(np.diff(last, prepend=0) + 1)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.round(-log10 / STEP)).astype(np.uint16)


def sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def squeeze(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as differences in byte planes, and counts, both compressed."""
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=1)
    planes = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    return codec.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True), codec.compress(counts.astype(np.uint32).tobytes(), asbytes=True)


def unsqueeze(keys: bytes, counts: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    codec = pa.Codec("zstd")
    planes = np.frombuffer(codec.decompress(keys, decompressed_size=8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(codec.decompress(counts, decompressed_size=4 * n, asbytes=True), np.uint32).astype(np.int64)


class Sums:
    """Counts of keys, merged when many wait."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.parts, self.waiting = most, [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.waiting += len(keys)

    def full(self) -> bool:
        if self.waiting > self.most and len(self.parts) > 1:
            merged = self.take()
            self.parts, self.waiting = [merged], len(merged[0])
        return self.waiting > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.waiting = self.parts, [], 0
        if len(parts) == 1:
            return parts[0]
        keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        return sum_sorted(keys, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64))


@dataclass(frozen=True)
class Level:
    """Where one level lies: nodes before each shard, and (level 2 up) contexts before each shard."""

    folder: str
    nodes: np.ndarray  # cumulative, shards + 1
    contexts: np.ndarray | None = None

    @property
    def size(self) -> int:
        return int(self.nodes[-1])


@dataclass(frozen=True)
class Trie:
    levels: tuple[Level, ...]
    tokens: int
    discount: float

    @property
    def order(self) -> int:
        return len(self.levels)

    @property
    def vocabulary(self) -> int:
        return self.levels[0].size


@lru_cache(4096)
def shard(folder: str, i: int) -> dict:
    arrays = files.mapped_arrays(f"{folder}/{i:06d}.ef")
    if "vhead" in arrays:
        arrays = arrays | {"values": eliasfano.EliasFano(arrays, "v"), "ranges": eliasfano.EliasFano(arrays, "p")}
    return arrays


def _by_shard(bounds: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys) for keys that lie in [bounds[s], bounds[s + 1])."""
    which = np.searchsorted(bounds, key, "right") - 1
    order = np.argsort(which.astype(np.uint16) if len(bounds) < 65_000 else which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(bounds)))
    for s in np.unique(which):
        yield int(s), order[cuts[s] : cuts[s + 1] if s + 1 < len(cuts) else len(order)]


def word_ids(level: Level, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids or -1, training counts) of words."""
    back, wanted = pd.factorize(hashes)  # few words make up a text: only these are sorted
    order = np.argsort(wanted)
    wanted, place = wanted[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    back = place[back]
    shards = len(level.nodes) - 1
    ids, counts = np.full(len(wanted), -1), np.zeros(len(wanted), np.int64)
    which = (wanted >> _U(40)).astype(np.int64) * shards >> 24
    cuts = np.searchsorted(which, np.arange(shards + 1))
    for s in range(shards):
        a, b = cuts[s], cuts[s + 1]
        if a == b or level.nodes[s] == level.nodes[s + 1]:
            continue
        arrays = shard(level.folder, s)
        at = np.minimum(np.searchsorted(arrays["hashes"], wanted[a:b]), len(arrays["hashes"]) - 1)
        hit = arrays["hashes"][at] == wanted[a:b]
        ids[a:b] = np.where(hit, level.nodes[s] + at, -1)
        counts[a:b] = np.where(hit, arrays["counts"][at], 0)
    return ids[back], counts[back]


def unigram(trie: Trie, counts: np.ndarray) -> np.ndarray:
    """log10 probability of words by training count; a word of count 0 has the share of one unknown word."""
    n, v, d = trie.tokens, trie.vocabulary, trie.discount
    if not n:
        return np.zeros(len(counts))
    return np.log10(np.maximum(counts - d, 0) / n + d * v / n / (v + 1))


def find(level: Level, context: np.ndarray, place: np.ndarray, scores: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node or -1, place among the context's words, log10 probability, log10 back-off) of context nodes and places (-1: no such word)."""
    node, inner = np.full(len(context), -1), np.full(len(context), -1)
    prob, back = np.zeros(len(context)), np.zeros(len(context))
    for s, at in ((s, at[i : i + BLOCK]) for s, at in _by_shard(level.contexts, context) for i in range(0, len(at), BLOCK)):
        arrays = shard(level.folder, s)
        c = context[at] - level.contexts[s]
        if scores:
            back[at] = arrays["back"][c] * -STEP
        some = at[place[at] >= 0]
        if not len(some):
            continue
        # neighbours mostly share a context: its range is looked up once
        c = context[some] - level.contexts[s]
        begins = np.concatenate([[True], c[1:] != c[:-1]])
        heads = c[begins]
        lo, hi = (x.astype(np.int64) for x in arrays["ranges"].access_two(heads))
        base = np.zeros(len(heads), np.uint64)
        later = (lo > 0) & (hi > lo)
        base[later] = arrays["values"].access(lo[later] - 1) + _U(1)
        run = np.cumsum(begins) - 1
        lo, hi, base = lo[run], hi[run], base[run]
        live = hi > lo
        some, lo, hi, base = some[live], lo[live], hi[live], base[live]
        where, equal = arrays["values"].successor(base + place[some].astype(np.uint64), lo, hi)
        got = some[equal]
        node[got] = level.nodes[s] + where[equal]
        inner[got] = (where - lo)[equal]
        if scores:
            prob[got] = arrays["prob"][where[equal]] * -STEP
    return node, inner, prob, back


def walk(trie: Trie, ids: np.ndarray, first: np.ndarray, counts: np.ndarray, upto: int, scores: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along texts: (log10 probability with runs of at most ``upto`` words, node of the run of ``upto`` words ending here or -1, its place in its range).

    ``first`` marks the first token of each text. Without ``scores`` only the nodes and places count.
    """
    score = unigram(trie, counts) if scores else np.zeros(len(ids))
    node, place = ids.copy(), ids.copy()
    for n in range(2, upto + 1):
        context = np.full(len(ids), -1)
        context[1:] = node[:-1]
        context[first] = -1
        live = np.flatnonzero(context >= 0)
        node, inner = np.full(len(ids), -1), np.full(len(ids), -1)
        if len(live):
            # equal runs are looked up once, in order, so that neighbours in a level are read together
            shift = _U(max(1, (trie.vocabulary + 1).bit_length()))
            keys, again = np.unique(context[live].astype(np.uint64) << shift | (place[live] + 1).astype(np.uint64), return_inverse=True)
            looked = find(trie.levels[n - 1], (keys >> shift).astype(np.int64), (keys & ((_U(1) << shift) - _U(1))).astype(np.int64) - 1, scores)
            found, at, prob, back = (x[again] for x in looked)
            score[live] = np.where(found >= 0, prob, back + score[live])
            node[live], inner[live] = found, at
        place = inner
    return score, node, place


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in batches_of([len(t or "") for t in texts], 4_000_000):
            words, bounds = hashed(texts[a:b])
            yield batch.iloc[a:b], words, bounds


BLOBS = "shard int, keys binary, counts binary, n int"


def _blobs(sums: tuple[np.ndarray, np.ndarray], which: np.ndarray, shards: int) -> pd.DataFrame:
    keys, counts = sums
    cuts = np.searchsorted(which, np.arange(shards + 1))
    rows = [(s, *squeeze(keys[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]]), int(cuts[s + 1] - cuts[s])) for s in range(shards) if cuts[s + 1] > cuts[s]]
    return pd.DataFrame(rows, columns=["shard", "keys", "counts", "n"])


def _merge(parts: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    found = [unsqueeze(r.keys_, r.counts, r.n) for part in parts for r in part.rename(columns={"keys": "keys_"}).itertuples()]
    return sum_sorted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def build_vocabulary(texts: DataFrame, shards: int) -> Trie:
    """Level 1: every training word with its count."""
    folder = scratch(texts.sparkSession, "level1")

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for _, words, _ in _texts(batches):
            sums.add(words)
            if sums.full():
                yield blob(sums)
        if sums.waiting:
            yield blob(sums)

    def blob(sums: Sums) -> pd.DataFrame:
        taken = sums.take()
        return _blobs(taken, (taken[0] >> _U(40)).astype(np.int64) * shards >> 24, shards)

    def write(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = _merge(parts)
        files.put(f"{folder}/{key[0]:06d}.ef", files.array_bytes({"hashes": hashes, "counts": counts.astype(np.uint32)}))
        yield pd.DataFrame({"shard": [key[0]], "n": [len(hashes)], "tokens": [int(counts.sum())], "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())]})

    done = texts.mapInPandas(count, BLOBS).repartition(shards, "shard").groupBy("shard").applyInPandas(write, "shard int, n long, tokens long, once long, twice long").toPandas()
    sizes = np.zeros(shards, np.int64)
    sizes[done["shard"].to_numpy(int)] = done["n"].to_numpy(np.int64)
    discount = discount_of(int(done["once"].sum()), int(done["twice"].sum()))
    return Trie((Level(folder, np.concatenate([[0], np.cumsum(sizes)])),), int(done["tokens"].sum()), discount)


def add_level(texts: DataFrame, trie: Trie, shards: int) -> Trie:
    """The next level: every run of one word more, counted, smoothed and written by shard of contexts."""
    n = trie.order + 1
    folder = scratch(texts.sparkSession, f"level{n}")
    contexts = trie.levels[-1].size
    cuts = -(-np.arange(shards + 1) * contexts // shards)
    bits = max(1, trie.vocabulary.bit_length())
    if contexts.bit_length() + bits > 63:
        raise ValueError(f"level {n} needs keys of more than 63 bits: {contexts} contexts of {trie.vocabulary} words")

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for _, words, bounds in _texts(batches):
            ids, counts = word_ids(trie.levels[0], words)
            first = np.zeros(len(ids), bool)
            first[bounds[:-1]] = True
            _, node, place = walk(trie, ids, first, counts, n - 1, False)
            follows = np.flatnonzero(~first[1:]) + 1
            follows = follows[(node[follows - 1] >= 0) & (place[follows] >= 0)]
            sums.add(node[follows - 1].astype(np.uint64) << _U(bits) | place[follows].astype(np.uint64))
            if sums.full():
                yield blob(sums)
        if sums.waiting:
            yield blob(sums)

    def blob(sums: Sums) -> pd.DataFrame:
        taken = sums.take()
        return _blobs(taken, np.searchsorted(cuts, (taken[0] >> _U(bits)).astype(np.int64), "right") - 1, shards)

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = _merge(parts)
        files.put(f"{sums_folder}/{key[0]:06d}", files.array_bytes(dict(zip(("keys", "counts"), map(_bytes, squeeze(keys, counts)), strict=True))))
        yield pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "once": [int((counts == 1).sum())], "twice": [int((counts == 2).sum())]})

    sums_folder = scratch(texts.sparkSession, f"sums{n}")
    done = texts.mapInPandas(count, BLOBS).repartition(shards, "shard").groupBy("shard").applyInPandas(merge, "shard int, n long, once long, twice long").toPandas()
    sizes = np.zeros(shards, np.int64)
    sizes[done["shard"].to_numpy(int)] = done["n"].to_numpy(np.int64)
    discount = discount_of(int(done["once"].sum()), int(done["twice"].sum()))

    @tidy
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in (int(x) for batch in batches for x in batch["id"]):
            c0, c1 = int(cuts[s]), int(cuts[s + 1])
            if sizes[s]:
                blob = files.mapped_arrays(f"{sums_folder}/{s:06d}")
                keys, counts = unsqueeze(blob["keys"].tobytes(), blob["counts"].tobytes(), int(sizes[s]))
            else:  # contexts that nothing follows
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            context, place = (keys >> _U(bits)).astype(np.int64), (keys & _U((1 << bits) - 1)).astype(np.int64)
            files.put(f"{folder}/{s:06d}.ef", files.array_bytes(smooth(trie, context, place, counts, c0, c1, discount)))
            yield pd.DataFrame({"shard": [s]})

    texts.sparkSession.range(0, shards, 1, shards).mapInPandas(write, "shard int").count()
    remove(texts.sparkSession, sums_folder)
    return Trie((*trie.levels, Level(folder, np.concatenate([[0], np.cumsum(sizes)]), cuts)), trie.tokens, trie.discount)


def _bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8)


def discount_of(once: int, twice: int) -> float:
    """The absolute discount of a level from how many of its runs occur once and twice in the whole corpus."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


def smooth(trie: Trie, context: np.ndarray, place: np.ndarray, counts: np.ndarray, c0: int, c1: int, discount: float) -> dict[str, np.ndarray]:
    """The arrays of one shard: pointers, places as one increasing sequence, probabilities, back-off weights."""
    kinds = np.bincount(context - c0, minlength=c1 - c0)
    total = np.bincount(context - c0, counts, c1 - c0)
    weight = np.where(kinds > 0, discount * kinds / np.maximum(total, 1), 1.0)
    lower = lower_log10(trie, context, place)
    prob = (counts - discount) / np.maximum(total[context - c0], 1) + weight[context - c0] * 10.0**lower
    ranges = np.concatenate([[0], np.cumsum(kinds)])
    last = ranges[1:][kinds > 0] - 1
    ends = np.cumsum(place[last] + 1)
    base = np.repeat(np.concatenate([[0], ends[:-1]]), kinds[kinds > 0]) if len(place) else place
    return eliasfano.encode(base + place, "v") | eliasfano.encode(ranges, "p") | {"prob": quantise(np.log10(prob)), "back": quantise(np.log10(weight))}


def last_word(trie: Trie, node: np.ndarray) -> np.ndarray:
    """Level 2: the ids of the nodes' last words."""
    level, out = trie.levels[1], np.zeros(len(node), np.int64)
    for s, at in _by_shard(level.nodes, node):
        arrays = shard(level.folder, s)
        i = node[at] - level.nodes[s]
        starts = np.searchsorted(_ranges(level.folder, s), i, "right") - 1
        lo = _ranges(level.folder, s)[starts]
        value = arrays["values"].access(i).astype(np.int64)
        base = np.zeros(len(i), np.int64)
        base[lo > 0] = arrays["values"].access(lo[lo > 0] - 1).astype(np.int64) + 1
        out[at] = value - base
    return out


@lru_cache(2)
def _ranges(folder: str, s: int) -> np.ndarray:
    """All pointers of a shard, decoded."""
    ef = shard(folder, s)["ranges"]
    return ef.access(np.arange(ef.n)).astype(np.int64)


def lower_log10(trie: Trie, context: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 probability of the run without its first word, by level 1 or 2."""
    if not len(context):
        return np.zeros(0)
    if trie.order == 1:
        counts = np.zeros(len(place), np.int64)
        level = trie.levels[0]
        for s, at in _by_shard(level.nodes, place):
            counts[at] = shard(level.folder, s)["counts"][place[at] - level.nodes[s]]
        return unigram(trie, counts)
    if trie.order > 2:
        raise NotImplementedError("runs of more than three words")
    heads, back = np.unique(context, return_inverse=True)
    word = last_word(trie, heads)
    level = trie.levels[1]
    node = np.zeros(len(heads), np.int64)
    for s, at in _by_shard(level.contexts, word):
        node[at] = level.nodes[s] + shard(level.folder, s)["ranges"].access(word[at] - level.contexts[s]).astype(np.int64)
    node = node[back] + place
    out = np.zeros(len(node))
    for s, at in _by_shard(level.nodes, node):
        out[at] = shard(level.folder, s)["prob"][node[at] - level.nodes[s]] * -STEP
    return out


def fit(docs: DataFrame, *, text_col: str = "text", order: int = 3, shard_tokens: int = 4_000_000) -> Trie:
    """A trie of all texts. Null counts as empty: its END is a token. ``order`` is 1 to 3; an empty table gives an empty trie."""
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(60_000, max(1, size // (6 * shard_tokens))))
    trie = build_vocabulary(texts, shards)
    for _ in range(order - 1):
        if trie.levels[-1].size:
            trie = add_level(texts, trie, shards)
    return trie


def score(docs: DataFrame, trie: Trie, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row: sums of log10 probabilities over words and one end.

    Null and empty texts are their end alone. Equal texts score alike; repeated rows stay, whatever their id. Texts of
    any length are scored whole. Other columns are ignored, whatever their names. An empty table gives no rows.
    """

    @tidy
    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = trie.tokens, trie.vocabulary
        for batch, words, bounds in _texts(batches):
            ids, counts = word_ids(trie.levels[0], words)
            first = np.zeros(len(ids), bool)
            first[bounds[:-1]] = True
            logs, _, _ = walk(trie, ids, first, counts, trie.order)
            base = np.log10((counts + 1) / (n + v + 1))
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), base, logs)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_tokens": np.diff(bounds), "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rate, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def rate_documents(docs: DataFrame, *, mod: int = 7, rest: int = 2, order: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; held-out texts are not counted.

    A null doc_id counts as '' in the hash that holds out. Without training texts every word scores 0. Odd rows are
    taken as in ``score``.
    """
    out = held_out(F.col("doc_id"), mod, rest)
    trie = fit(docs.where(~out), order=order)
    return score(docs, trie).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
