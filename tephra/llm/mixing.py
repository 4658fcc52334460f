"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a target number of words. Its documents, dealt by a hash into shards of bounded size and put in a seeded
order there, form a row of words that is cut into blocks of equal length. Blocks are the seats: highest quotients give
them to sources by target, then to groups of shards and to shards by their words. A shard takes each of its blocks
``quota // blocks`` times, and ``quota % blocks`` of them, those of least seeded hash, once more.

Only totals by source and by group of ``GROUP`` shards reach the driver. Documents without words take no part in the
shuffle: their row is (size 0, taken 0).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tephra.session import tidy, written

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]++"
#: Shards whose quotas one task computes together.
GROUP = 2048


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], repeat: float = 3.0) -> np.ndarray:
    """Share out the sum of all sizes by weight; no target exceeds ``repeat`` times its size, and the excess is shared anew.

    Sources of size 0, or an empty list, get 0.
    """
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    target, free, left = np.zeros(len(size)), np.ones(len(size), bool), size.sum()
    while free.any() and weight[free].sum() > 0:
        share = np.where(free, left * weight / weight[free].sum(), 0)
        over = free & (share > repeat * size)
        if not over.any():
            return np.where(free, share, target)
        target[over] = repeat * size[over]
        left -= target[over].sum()
        free &= ~over
    return target


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats by highest quotients w/(2s+1), none above its cap; ties go to the lower index.

    The quotients above a common level are counted at once: bisection finds the level, and only the seats on it are
    dealt one by one. Fewer seats than asked for are dealt only if all caps are reached or no weight is positive.
    """
    w = np.maximum(np.asarray(weights, float), 0)
    cap = np.where(w > 0, np.asarray(caps, np.int64) if caps is not None else np.iinfo(np.int64).max // 4, 0)
    seats = int(min(seats, cap.sum() if caps is not None else (seats if (w > 0).any() else 0)))
    if seats <= 0:
        return np.zeros(len(w), np.int64)

    def at(scale: float) -> np.ndarray:
        return np.minimum(cap, np.floor(w * scale + 0.5)).astype(np.int64)

    low, high = 0.0, 1.0 / w[w > 0].min()
    while at(high).sum() < seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() <= seats else (low, mid)
    got = at(low)
    for _ in range(int(seats - got.sum())):
        got[np.argmax(np.where(got < cap, w / (2 * got + 1), -1.0))] += 1
    return got


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads neighbours."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def block_copies(blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block is taken: an even number of passes, then a seeded choice."""
    base, more = divmod(int(quota), blocks)
    out = np.full(blocks, base, np.int64)
    rank = _mix64(np.arange(blocks, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    out[np.argsort(rank, kind="stable")[:more]] += 1
    return out


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    repeat: int = 3,
    block_words: int = 64,
    shard_words: int = 200_000,
    shard_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """One row per document: id, source, text_sha256, size, source_size, target, taken, shard, and ``spans`` (first word, end, times).

    Sources are ordered by code point with null last, and weights repeat over them. Null texts have size 0; ids may
    repeat or be null (each row is a document of its own); other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.sha2(F.col(text_col), 256).alias("text_sha256"), word_count(F.col(text_col)).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum((F.col("size") > 0).cast("long")).alias("n")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], repeat)
    shards = [max(1, -(-r["size"] // shard_words), -(-r["n"] // shard_rows)) for r in totals]
    catalogue = pd.DataFrame({"source": pd.Series([r["source"] for r in totals], dtype=object), "src": range(len(sizes)), "source_size": sizes, "target": targets, "shards": shards})
    sources = spark.createDataFrame(catalogue.astype(object).values.tolist() if len(sizes) else [], "source string, src int, source_size long, target double, shards int")
    # one row per source: as large as the catalogue the driver has just held
    keyed = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    live = keyed.where("size > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_sha256"), F.col("shards").cast("long")).cast("int"))

    per_shard = written(live.groupBy("src", "shard").agg(F.sum("size").alias("words")).withColumn("grp", F.expr(f"shard div {GROUP}")), "shards")
    seats = sainte_lague(targets, int(round(float(sum(targets)) / block_words)))
    n_blocks = F.ceil(F.col("words") / block_words)
    groups = per_shard.groupBy("src", "grp").agg(F.sum("words").alias("words"), F.sum(n_blocks).alias("blocks")).orderBy("src", "grp").toPandas()
    groups["quota"] = 0
    for src, part in groups.groupby("src"):
        groups.loc[part.index, "quota"] = sainte_lague(part["words"].to_numpy(), int(seats[src]), repeat * part["blocks"].to_numpy())
    quota_of = {(int(r.src), int(r.grp)): int(r.quota) for r in groups.itertuples()}

    def shard_quota(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        words = part["words"].to_numpy()
        quota = sainte_lague(words, quota_of[int(key[0]), int(key[1])], repeat * -(-words // block_words))
        return pd.DataFrame({"q_src": part["src"].to_numpy(), "q_shard": part["shard"].to_numpy(), "quota": quota})

    quotas = written(per_shard.groupBy("src", "grp").applyInPandas(shard_quota, "q_src int, q_shard int, quota long"), "quotas")

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "doc_id", "size", "text_sha256"]).reset_index(drop=True)
        end = part["size"].cumsum().to_numpy()
        start = end - part["size"].to_numpy()
        blocks = -(-int(end[-1]) // block_words)
        copies = block_copies(blocks, part["quota"].iloc[0], hash((seed, int(key[0]), int(key[1]))))
        ends = np.minimum(np.arange(1, blocks + 1) * block_words, end[-1])
        taken_to = np.concatenate([[0], np.cumsum(copies * np.diff(ends, prepend=0))])

        def upto(word: np.ndarray) -> np.ndarray:
            block = np.minimum(word // block_words, blocks - 1)
            return taken_to[block] + copies[block] * (word - block * block_words)

        part["taken"] = upto(end) - upto(start)
        spans = []
        for a, b in zip(start, end, strict=True):
            inner = range(a // block_words, -(-b // block_words))
            runs: list[list[int]] = []
            for x in inner:
                lo, hi, times = max(a, x * block_words) - a, min(b, (x + 1) * block_words) - a, int(copies[x])
                if times and runs and runs[-1][1] == lo and runs[-1][2] == times:
                    runs[-1][1] = hi
                elif times:
                    runs.append([lo, hi, times])
            spans.append([{"first": int(r[0]), "end": int(r[1]), "times": r[2]} for r in runs])
        part["spans"] = spans
        return part[["doc_id", "source", "text_sha256", "size", "source_size", "target", "taken", "shard", "spans"]]

    key_type = dict(sized.dtypes)["doc_id"]
    out = "doc_id string, source string, text_sha256 string, size long, source_size long, target double, taken long, shard int, spans array<struct<first:int,end:int,times:int>>"
    # ids go through pandas as text: numbers beside nulls would become doubles there
    ranked = live.withColumn("rank", F.xxhash64(F.lit(seed + 1), "doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    joined = ranked.join(quotas, (F.col("src") == F.col("q_src")) & (F.col("shard") == F.col("q_shard")))
    chosen = joined.groupBy("src", "shard").applyInPandas(choose, out).withColumn("doc_id", F.col("doc_id").cast(key_type))
    idle = keyed.where("size = 0").selectExpr("doc_id", "source", "text_sha256", "size", "source_size", "target", "0L as taken", "cast(null as int) as shard", "cast(array() as array<struct<first:int,end:int,times:int>>) as spans")
    return chosen.unionByName(idle)


def cut_text(text: str | None, spans: Sequence[dict], copy: int) -> str:
    """The words of the spans that are taken more than ``copy`` times, with the white space that stood between them."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    return "\n".join(text[words[s["first"]][0] : words[s["end"] - 1][1]] for s in spans if s["times"] > copy)


def apply_mix(docs: DataFrame, plan: DataFrame, *, repeat: int = 3) -> DataFrame:
    """The mixed documents themselves: a row per pass over a document, its text cut to the blocks taken in that pass.

    Each row meets the plan of its own id, source and text; rows equal in these are told apart by number, as their plans
    fit each of them. Ids may repeat or be null. Documents of which nothing is taken go, null and empty texts among them.
    Other columns stay, whatever their names; an empty table stays empty.
    """
    key = ["__mix_id", "__mix_source", "__mix_sha256"]

    def numbered(frame: DataFrame) -> DataFrame:
        return frame.withColumn("__mix_row", F.row_number().over(Window.partitionBy(*key).orderBy("__mix_sha256")))

    picked = numbered(plan.select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("text_sha256").alias(key[2]), "taken", F.col("spans").alias("__mix_spans"))).where("taken > 0").drop("taken")
    keyed = numbered(docs.withColumns({key[0]: F.col("doc_id"), key[1]: F.col("source"), key[2]: F.sha2("text", 256)}).where("__mix_sha256 is not null"))
    on = F.lit(True)
    for c in [*key, "__mix_row"]:
        on = on & keyed[c].eqNullSafe(picked[c])
    joined = keyed.join(picked, on).select(*[keyed[c] for c in docs.columns], "__mix_spans")
    schema = docs.schema

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, spans = batch.column("text").to_pylist(), batch.column("__mix_spans").to_pylist()
            batch = batch.drop_columns(["__mix_spans"])
            for copy in range(repeat):
                texts = [cut_text(t, s, copy) for t, s in zip(whole, spans, strict=True)]
                part = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
                if "n_chars" in part.schema.names:
                    place = part.schema.get_field_index("n_chars")
                    part = part.set_column(place, part.schema.field(place), pa.array([len(t) for t in texts], part.schema.field(place).type))
                yield part.filter(pa.array([t != "" for t in texts], pa.bool_()))

    return joined.mapInArrow(cut, schema)
