"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Darts: every element of a weighted set has, for each dyadic region of its weight axis, a Poisson stream of darts over
rank, all drawn from hashes of the element. A set keeps the darts below its elements' weights; each dart belongs to one
of ``k`` coordinates, and the earliest of a coordinate is the set's signature there. Two sets agree in a coordinate with
the chance of their weighted Jaccard similarity. About k ln k + 2k darts fill a signature however large the set is; a
set with an empty coordinate throws on to twice the rank.

Banded joining: ``rows`` coordinates make a band. Documents that share a band are candidates; a link is a candidate pair
whose exact similarity on five-word shingles is at least ``threshold``; classes are the connected documents. Documents
of equal words are one from the start. No pair is a row unless it is with a centre or is a link:

1. Each band's documents are held against the band's centre, the one of them that meets the most others in all its
   bands. Copies of one text have the same centre in all their bands, so a document meets few centres.
2. Where documents are still in another class than their centre, they are compared with all others of their band by
   products of shingle matrices, in blocks of bounded size that are dealt over tasks. Only links that join classes come
   out, fewer than there are documents.

Every candidate pair is therefore compared or joins documents that are in one class already. n documents of a band that
all stay in different classes cost n^2 / 2 comparisons inside tasks, but no such rows.

Elements are weighed alike (sets) by default, as a similarity of shingles is meant; ``counts`` weighs them by how often
they occur, in the darts and in the exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm.shingles import Words, batches_of, mix64
from tephra.session import tidy, written

_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def distinct_weights(elements: np.ndarray, bounds: np.ndarray, counts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, element, weight) without repeats; weights are counts or 1."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((elements, owner))
    owner, elements = owner[order], elements[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (elements[1:] != elements[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(owner)))
    return owner[at], elements[at], times.astype(float) if counts else np.ones(len(at))


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, sets: int, k: int) -> np.ndarray:
    """(sets, k) dart ids; rows of empty sets are all 0. Weights are positive."""
    out = np.zeros((sets, k), np.uint64)
    total = np.bincount(owner, weights, sets)
    left = total > 0
    darts = k * math.log(k) + 2 * k
    while left.any():
        mine = left[owner]
        limit = np.zeros(sets)
        limit[left] = darts / total[left]
        rank, name = np.full(sets * k, np.inf), np.zeros(sets * k, np.uint64)
        for slot, r, dart in _throw(owner[mine], elements[mine], weights[mine], limit, k):
            np.minimum.at(rank, slot, r)
            won = rank[slot] == r
            name[slot[won]] = dart[won]
        full = np.isfinite(rank.reshape(sets, k)).all(1) & left
        out[full] = name.reshape(sets, k)[full]
        left &= ~full
        darts *= 2
    return out


def _throw(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Darts below the sets' rank limits as (set * k + coordinate, rank, dart), region by region."""
    low, level = 0.0, 0
    while len(owner):
        width = 1.0 if level == 0 else low
        o, e, w = owner, mix64(elements + _U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), weights
        most = limit[o]
        r, j = np.zeros(len(o)), 0
        while len(o):
            h = mix64(e + _U((2 * j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            r = r - np.log(_uniform(h)) / width
            keep = r <= most
            o, e, w, r, most, h = o[keep], e[keep], w[keep], r[keep], most[keep], h[keep]
            if len(o):
                dart = mix64(h ^ _U(0xA0761D6478BD642F))
                if level == 0:
                    inside = w >= 1.0
                    if not inside.all():
                        inside |= _uniform(mix64(dart)) < w
                else:
                    inside = low + width * _uniform(mix64(dart)) < w
                slot = o * k + (dart % _U(k)).astype(np.int64)
                yield (slot, r, dart) if inside.all() else (slot[inside], r[inside], dart[inside])
            j += 1
        low, level = low + width, level + 1
        above = weights > low
        owner, elements, weights = owner[above], elements[above], weights[above]


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) hashes of the bands, different for different band numbers."""
    parts = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)
    key = np.repeat(key, len(sketch), 0)
    for i in range(rows):
        key = mix64(key ^ parts[:, :, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, *, bands: int, rows: int, width: int, counts: bool) -> DataFrame:
    """(doc_id, content, bands): a hash of the words in order, and band keys; both null for texts without words."""

    @tidy
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of([len(t or "") for t in texts], 1_500_000):
                words = Words.of(texts[a:b])
                shingles, bounds = words.shingles(width)
                owner, elements, weights = distinct_weights(shingles, bounds, counts)
                keys = band_keys(signatures(owner, elements, weights, b - a, bands * rows), bands, rows)
                some = np.diff(words.bounds) > 0
                content = [_content(words.hashes[x:y]) if y > x else None for x, y in zip(words.bounds, words.bounds[1:], strict=False)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "content": content, "bands": [k if s else None for k, s in zip(keys, some, strict=True)]})

    return docs.mapInPandas(sketch, "doc_id long, content binary, bands array<long>")


def _content(hashes: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def element_sets(docs: DataFrame, *, width: int, counts: bool) -> DataFrame:
    """(id, size, elements) of (id, text): the distinct shingles as ascending 64-bit hashes; with ``counts``, a shingle's further occurrences are elements too."""

    @tidy
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in batches_of([len(t or "") for t in texts]):
                shingles, bounds = Words.of(texts[a:b]).shingles(width)
                owner, elements, weights = distinct_weights(shingles, bounds, counts)
                if counts:
                    times = weights.astype(np.int64)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    owner, elements = np.repeat(owner, times), np.repeat(elements, times)
                    elements = np.where(nth > 0, mix64(elements + nth.astype(np.uint64)), elements)
                    order = np.lexsort((elements, owner))
                    owner, elements = owner[order], elements[order]
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                found = [elements[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(), "size": np.diff(cuts), "elements": found})

    return docs.select("id", "text").mapInPandas(make, "id long, size int, elements binary")


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of ascending hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.sort(np.concatenate([x, y]), kind="stable")  # merges two ascending runs
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(x) + len(y) - shared)


def with_centres(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (centre, id) that are links. Pairs of a hot centre are split by adaptive execution."""
    small = pairs.join(sets.select("id", F.col("size").alias("n"), F.col("elements").alias("mine")), "id")
    both = small.join(sets.select(F.col("id").alias("centre"), F.col("size").alias("m"), F.col("elements").alias("other")), "centre")
    both = both.where((F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n")))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = np.array([similarity(a, b) >= threshold for a, b in zip(batch["mine"], batch["other"], strict=True)], bool)
            yield batch.loc[near, ["centre", "id"]]

    return both.select("centre", "id", "mine", "other").mapInPandas(compare, "centre long, id long")


def joining_links(roots: np.ndarray, sets: list[np.ndarray], threshold: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Pairs of roots that join the classes linked among these sets, no more than there are classes; sets of one class are not compared."""
    kinds, kind = np.unique(roots, return_inverse=True)
    n, size = len(sets), np.array([len(x) for x in sets], float)
    if len(kinds) < 2:
        return []
    owner = np.repeat(np.arange(n), size.astype(int))
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[column] > 1
    owner, column = owner[keep], column[keep]
    column = np.unique(column, return_inverse=True)[1]
    shared = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        part = np.zeros((n, min(columns, int(column[-1]) + 1 - first)), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        shared += part @ part.T
    near = (shared >= threshold * (size[:, None] + size[None, :] - shared)) & (kind[:, None] < kind[None, :])
    a, b = np.nonzero(near)
    parent, out = list(range(len(kinds))), []
    for x, y in sorted(set(zip(kind[a].tolist(), kind[b].tolist(), strict=True))):
        u, v = x, y
        while parent[u] != u:
            u = parent[u]
        while parent[v] != v:
            v = parent[v]
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((int(kinds[x]), int(kinds[y])))
    return out


def within_bands(torn: DataFrame, sets: DataFrame, threshold: float, *, block: int, elements: int) -> DataFrame:
    """Links (a, b) between the classes of (band, id, root) that join all linked documents of a band.

    Bands are dealt into blocks of about ``block`` documents and ``elements`` elements; a task holds two blocks.
    """
    rows = torn.join(sets, "id")
    sizes = rows.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / elements)).cast("int").alias("g"))
    rows = rows.join(sizes, "band").withColumn("h", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("band", F.least("h", "o").alias("i"), F.greatest("h", "o").alias("j"), "root", "elements")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = joining_links(frame["root"].to_numpy(), [np.frombuffer(x, np.uint64) for x in frame["elements"]], threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def components(links: DataFrame, *, most: int = 60) -> DataFrame:
    """(id, root): the least id connected with each id that has a link (a, b).

    Rounds take the least root among neighbours and then follow roots once more, so a chain halves with every round;
    each round is written, and the last one changes nothing.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    for _ in range(most):
        near = both.join(roots.select(F.col("id").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = roots.join(near, roots["id"] == near["a"]).select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = roots.select(F.col("id").alias("r_id"), F.col("root").alias("r_root"))
        new = written(lower.join(jump, lower["root"] == jump["r_id"], "left").select("id", F.least("root", "r_root").alias("root"), "old"), "roots")
        if not new.where("root <> old").limit(1).count():
            return new.select("id", "root")
        roots = new.select("id", "root")
    raise RuntimeError("classes did not settle")


def near_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 30,
    rows: int = 5,
    counts: bool = False,
    block: int = 512,
    elements: int = 400_000,
) -> DataFrame:
    """(doc_id, class_id, exact_copies): the least doc_id of each document's class, one row per row of ``docs``.

    ``exact_copies`` counts the rows of the same words. Texts without words (null, empty, punctuation) are classes of
    their own; shorter texts than ``width`` words are alike only if all their words are. Rows of equal doc_id are one
    document as far as classes go. A null doc_id gives a null class. Other columns are ignored, whatever their names.
    An empty table gives no rows. ``block`` and ``elements`` bound the documents and shingles of half a task.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = written(sketches(texts, bands=bands, rows=rows, width=width, counts=counts), "sketches")
    live = made.where("content is not null and doc_id is not null")
    groups = written(live.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "contents")
    heads = live.join(groups.select("rep", F.col("content").alias("c")), (F.col("doc_id") == F.col("rep")) & (F.col("content") == F.col("c"))).select("rep", "bands")
    banded = written(heads.dropDuplicates(["rep"]).select(F.col("rep").alias("id"), F.explode("bands").alias("band")), "bands")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(shared, "band"), "members")

    involved = written(members.groupBy("id").agg(F.sum("n").alias("meets")), "involved")
    ranked = members.join(involved, "id").groupBy("band").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("centre"))
    held = written(members.join(ranked, "band").select("band", "id", "centre"), "held")
    small = texts.join(_checked(involved.select(F.col("id").alias("i"))), F.col("doc_id") == F.col("i"), "left_semi").dropDuplicates(["doc_id"])
    sets = written(element_sets(small.select(F.col("doc_id").alias("id"), "text"), width=width, counts=counts), "sets")

    stars = written(with_centres(held.select("centre", "id").where("centre <> id").distinct(), sets, threshold), "stars")
    roots = components(stars.select(F.col("centre").alias("a"), F.col("id").alias("b")))
    placed = _rooted(held.select("band", "id"), roots)
    torn = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1 and n > 2").select("band")
    links = written(within_bands(placed.join(torn, "band"), sets, threshold, block=block, elements=elements), "links")
    merged = components(links)
    roots = _rooted(_rooted(involved.select("id"), roots).withColumnRenamed("root", "first").withColumnRenamed("id", "rep"), merged, "first")

    placed = groups.join(roots.select(F.col("rep").alias("r"), "root"), F.col("rep") == F.col("r"), "left")
    placed = placed.select(F.col("content").alias("c"), F.coalesce("root", "rep").alias("root"), "copies")
    found = made.join(placed, made["content"] == F.col("c"), "left")
    return found.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("exact_copies"))


def _rooted(frame: DataFrame, roots: DataFrame, by: str = "id") -> DataFrame:
    """The frame with ``root``: that of ``by`` in (id, root), or ``by`` itself."""
    known = roots.select(F.col("id").alias("known"), F.col("root").alias("to"))
    return frame.join(known, frame[by] == known["known"], "left").withColumn("root", F.coalesce("to", by)).drop("known", "to")


def _checked(ids: DataFrame, most: int = 500_000) -> DataFrame:
    """The ids, marked for broadcast if a count shows that they are few; beyond that the join shuffles."""
    return F.broadcast(ids) if ids.count() <= most else ids


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that of the least doc_id, with all its columns, whatever their names.

    Rows of equal doc_id are one document and stay or go together. Rows of null doc_id, and texts without words, stay.
    """
    gone = near_classes(docs, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(_checked(written(gone, "gone")), docs["doc_id"] == F.col("__gone"), "left_anti")
