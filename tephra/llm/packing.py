"""Token ids in fixed-width bit-packed files.

A file holds documents in ascending order of doc_id. Every id takes the fewest bits that hold the vocabulary. Ids stand
in blocks of ``BLOCK``; each block starts on a byte, its offset stands in the header, so any range of ids is unpacked
with numpy from the blocks it touches alone.

Layout, little-endian: magic ``TPK1``, uint32 width, uint64 block length, n_ids, n_docs, n_blocks; then n_blocks + 1
uint64 byte offsets (from the start of the packed part), n_docs int64 doc_id, n_docs + 1 uint64 starts in the file;
then the packed blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm import files
from tephra.session import scratch, tidy

MAGIC = b"TPK1"
BLOCK = 4096
#: Characters for which Python's and the tokenizer's classes of letters, digits and white space surely agree; the second is their Latin-1 part.
PLAIN = r"[\n\r\t -~¡-±´-¸º»¿-ɏ‐-‧€]*"
PLAIN_BYTES = bytes(i for i in range(256) if i in (9, 10, 13) or 32 <= i < 127 or i > 160 and chr(i) not in "²³¹¼½¾")
#: Characters of texts that are encoded at a time, and at least one text.
GROUP = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data[: n * width // 8].tobytes(), f"<u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(np.asarray(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def file_bytes(doc_ids: Sequence[int], lengths: Sequence[int], ids: np.ndarray, width: int, none: Sequence[bool] = ()) -> Iterator[bytes]:
    """The chunks of one file; documents marked ``none`` have no id."""
    blocks = -(-len(ids) // BLOCK)
    sizes = [(min(BLOCK, len(ids) - b * BLOCK) * width + 7) // 8 for b in range(blocks)]
    yield MAGIC + np.uint32(width).tobytes() + np.array([BLOCK, len(ids), len(doc_ids), blocks], "<u8").tobytes()
    yield np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
    yield np.asarray(doc_ids, "<i8").tobytes()
    yield np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    yield np.resize(np.asarray(none if len(none) else [False], "<i8"), len(doc_ids)).tobytes()
    for b in range(blocks):
        yield pack_bits(ids[b * BLOCK : (b + 1) * BLOCK], width)


class TokenFile:
    """Random access to a packed file that is mapped, not loaded."""

    def __init__(self, data: np.ndarray):
        self.data = data
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a packed token file")
        self.width = int(np.frombuffer(data[4:8].tobytes(), "<u4")[0])
        self.block, self.n_ids, self.n_docs, n_blocks = (int(x) for x in np.frombuffer(data[8:40].tobytes(), "<u8"))
        at = 40
        self.offsets, at = self._array(at, n_blocks + 1, "<u8")
        self.doc_ids, at = self._array(at, self.n_docs, "<i8")
        self.starts, at = self._array(at, self.n_docs + 1, "<u8")
        self.none, self.body = self._array(at, self.n_docs, "<i8")

    def doc_id(self, i: int) -> int | None:
        return None if self.none[i] else int(self.doc_ids[i])

    def _array(self, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
        return np.frombuffer(self.data[at : at + 8 * n].tobytes(), kind).astype(np.int64), at + 8 * n

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids [first, end) of the file, from the blocks that hold them."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (end - 1) // self.block
        parts = [unpack_bits(self.data[self.body + self.offsets[x] : self.body + self.offsets[x + 1]], self.width, min(self.block, self.n_ids - x * self.block)) for x in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


class Parts:
    """Ids of texts of ``PLAIN`` characters, put together from those of their parts, which are kept for other texts.

    A text is cut only where the pre-tokenizer cuts it whatever else stands around, so the tokenizer gives a part the ids
    that it has in the text: between letters, digits, white space and other characters, before the last white space that
    a visible character follows, not after it if it is a space, and nowhere beside an apostrophe, which may open an
    ending such as ``'ll``.

    A part is kept in the row that its characters are hashed to, with all of them, and a new one takes the row from the
    one before, so memory is bounded. Parts of more than ``LONG`` characters, beyond Latin-1 or of more than ``MOST``
    ids are not kept. Unknown words, a space and letters each, are encoded together in one text: the pre-tokenizer parts
    them again, and a token that begins with the space begins a word.
    """

    LONG, MOST, BLOCK = 24, 8, 1 << 17
    EDGE, SPACE, LETTER, DIGIT, OTHER = range(5)
    MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")
    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self, tokenizer, bits: int = 21):
        self.tokenizer, self.shift = tokenizer, np.uint64(64 - bits)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # how byte-level vocabularies write a space
        kinds = {self.LETTER: r"[^\W\d_]", self.DIGIT: r"\d", self.SPACE: r"\s", self.EDGE: r"\0"}
        self.kinds = np.full(1 << 14, self.OTHER, np.uint8)  # beyond all of PLAIN
        for kind, pattern in kinds.items():
            self.kinds[[i for i in range(len(self.kinds)) if re.match(pattern, chr(i))]] = kind
        self.keys, self.counts = np.zeros((1 << bits, self.LONG // 8), "<u8"), np.zeros(1 << bits, np.uint8)
        self.ids = np.zeros((1 << bits, self.MOST), "<u4")

    def of(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not len(texts):
            return []
        joined = "\0" + "\0".join(texts) + "\0"  # PLAIN has no zero; every character is one unit of UTF-16
        chars = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        starts = self.cuts(chars)
        done = [self.block(joined, chars, starts[a : a + self.BLOCK + 1]) for a in range(0, len(starts) - 1, self.BLOCK)]
        counts, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return np.split(ids, np.cumsum(counts)[chars[starts[:-1]] == 0][1:-1])

    def cuts(self, chars: np.ndarray) -> np.ndarray:
        """Where parts begin, and the end of all. ``chars`` has a zero, which is a part, before, between and behind texts."""
        kind, blank, quote = self.kinds[chars], chars == ord(" "), chars == ord("'")
        before, here, after = kind[:-2], kind[1:-1], kind[2:]
        held = blank[:-2] | ((quote[1:-1] | quote[:-2]) & (before > self.SPACE))
        cut = (before != here) & ~(held & (here > self.SPACE)) | (here == self.SPACE) & (after > self.SPACE) | (before == self.EDGE) | (here == self.EDGE)
        return np.concatenate([[0], np.flatnonzero(cut) + 1, [len(chars) - 1, len(chars)]])

    def block(self, joined: str, chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part of a block has, and the ids of all."""
        first, starts, lengths = bounds[0], bounds[:-1] - bounds[0], np.diff(bounds)
        own = chars[first : bounds[-1]]
        kept = lengths <= self.LONG
        if (wide := np.flatnonzero(own > 255)).size:
            kept[np.searchsorted(starts, wide, "right") - 1] = False
        raw = np.concatenate([own.astype(np.uint8), np.zeros(self.LONG, np.uint8)])
        keys = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(own) + self.LONG - 7,), (1,))[starts[:, None] + np.arange(0, self.LONG, 8)]
        keys &= self.MASKS[np.clip(lengths[:, None] - np.arange(0, self.LONG, 8), 0, 8)]
        mixed = (keys * self.FACTORS).sum(1, dtype=np.uint64)
        rows = ((mixed ^ (mixed >> np.uint64(32))) * self.FACTORS[0] >> self.shift).astype(np.int64)
        edge = own[starts] == 0
        there = self.keys[rows] == keys
        hit = kept & ~edge & there[:, 0] & there[:, 1] & there[:, 2]
        counts, ids = np.where(hit, self.counts[rows], 0).astype(np.int64), self.ids[rows]
        missing = np.flatnonzero(~hit & ~edge)
        parts = [joined[a:b] for a, b in zip(bounds[missing].tolist(), bounds[missing + 1].tolist(), strict=True)]
        names, begins, found = self.encode(list(dict.fromkeys(parts)))
        number = dict(zip(names, range(len(names)), strict=True))
        which = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        counts[missing] = np.diff(begins)[which]
        for j in range(self.MOST):
            has = np.flatnonzero(counts[missing] > j)
            ids[missing[has], j] = found[begins[which[has]] + j]
        new = missing[kept[missing] & (counts[missing] <= self.MOST)]
        at, one = np.unique(rows[new], return_index=True)
        self.keys[at], self.counts[at], self.ids[at] = keys[new[one]], counts[new[one]], ids[new[one]]
        ends = np.cumsum(counts)
        starts, out = ends - counts, np.empty(int(ends[-1]), np.uint32)
        for j in range(self.MOST):
            has = np.flatnonzero(counts > j)
            out[starts[has] + j] = ids[has, j]
        for i in np.flatnonzero(counts[missing] > self.MOST).tolist():
            out[starts[missing[i]] : ends[missing[i]]] = found[begins[which[i]] : begins[which[i] + 1]]
        return counts, out

    def encode(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The parts in some order, where the ids of each begin (and the end of all), and the ids that the tokenizer gives them."""
        names: list[str] = []
        counts, done = [np.zeros(1, np.int64)], [np.zeros(0, np.uint32)]
        words, rest = [], []
        for p in parts:
            (words if p[0] == " " and p[1:].isalpha() else rest).append(p)
        for i in range(0, len(words), 2_000):
            some = words[i : i + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                names += some
                counts.append(np.diff(starts, append=len(ids)))
                done.append(ids)
            else:
                rest += some
        singly = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        counts.append(np.array([len(x) for x in singly], np.int64))
        done.append(np.fromiter(chain.from_iterable(singly), np.uint32))
        return names + rest, np.cumsum(np.concatenate(counts)), np.concatenate(done)


@lru_cache(2)
def encoder(path: str):
    """(encode, vocabulary size): encode maps texts to arrays of ids, the same as the tokenizer's own for each whole text.

    The tokenizer encodes the pieces of its pre-tokenizer one by one, so equal ones need no encoding again. Texts with
    characters outside ``PLAIN``, or with the string of a special token, go to the tokenizer whole.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    known, wide = Parts(tokenizer), re.compile(PLAIN).fullmatch

    def plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, PLAIN_BYTES)
        except UnicodeEncodeError:
            return wide(text) is not None

    by_piece = "ByteLevel(add_prefix_space=False" in repr(tokenizer.pre_tokenizer) and tokenizer.normalizer is None

    def encode(texts: Sequence[str]) -> Iterator[np.ndarray]:
        ends = np.cumsum([len(t) for t in texts])
        for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // GROUP)) + 1):
            part = [texts[i] for i in group]
            apart = [by_piece and plain(t) and not any(s in t for s in special) for t in part]
            found = iter(known.of([t for t, x in zip(part, apart, strict=True) if x]))
            for text, x in zip(part, apart, strict=True):
                yield next(found) if x else np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode, tokenizer.get_vocab_size(with_added_tokens=True)


def file_count(docs: DataFrame, rows: int, size: int) -> int:
    """Files of about ``rows`` documents, up to 4,096 of them, or more if texts of ``size`` bytes a file need more."""
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(1, min(-(-n // rows), 4096), -(-total // size))


def write_tokens(docs: DataFrame, *, tokenizer: str, end_id: int, file_rows: int = 2_500, file_size: int = 64 << 20, file_ids: int = 8_000_000) -> DataFrame:
    """Encode every text (null: empty), add ``end_id``, and write packed files in ascending order of doc_id.

    Returns a row per file: file number, path, n_docs, n_ids and the ids in files before it. Rows of equal doc_id stand
    together, ordered by text; many of them are several files, as files are ranges of doc_id and text. Rows whose doc_id
    is null come first. Other columns are ignored, whatever their names; an empty table writes no file. A file is
    closed after ``file_ids`` ids, so what a task holds is bounded.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = scratch(spark, "tokens")
    order = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(file_count(rows, file_rows, file_size), order, F.substring("text", 1, 32)).sortWithinPartitions(order, "text")
    dealt = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")

    @tidy
    def encode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, vocabulary = encoder(tokenizer)
        width, task, part = max(bits_for(vocabulary), bits_for(end_id + 1)), TaskContext.get().partitionId(), 0
        held: tuple[list, list, list, list] = ([], [], [], [])  # ids, documents, lengths, whether the document has no id
        waiting = 0

        def close() -> pd.DataFrame:
            path = f"{folder}/{task:08d}-{part:06d}.tpk"
            ids = np.concatenate(held[0])
            files.put(path, file_bytes(held[1], held[2], ids, width, held[3]))
            return pd.DataFrame({"task": [task], "part": [part], "path": [path], "n_docs": [len(held[1])], "n_ids": [len(ids)]})

        for batch in batches:
            for doc_id, none, found in zip(batch["doc_id"].tolist(), batch["none"].tolist(), encode(batch["text"].tolist()), strict=True):
                if waiting and waiting + len(found) >= file_ids:
                    yield close()
                    held, waiting, part = ([], [], [], []), 0, part + 1
                held[0].append(np.append(found, np.uint32(end_id)))
                held[1].append(doc_id)
                held[2].append(len(found) + 1)
                held[3].append(none)
                waiting += len(found) + 1
        if waiting:
            yield close()

    done = dealt.mapInPandas(encode_files, "task int, part int, path string, n_docs long, n_ids long").toPandas()  # a row per file
    done = done.sort_values(["task", "part"]).drop_duplicates(["task", "part"]).reset_index(drop=True)
    done["file"], done["before"] = np.arange(len(done)), done["n_ids"].cumsum() - done["n_ids"]
    kept = done[["file", "path", "n_docs", "n_ids", "before"]]
    return spark.createDataFrame(kept.astype(object).values.tolist(), "file int, path string, n_docs long, n_ids long, before long")


def read_tokens(written: DataFrame) -> DataFrame:
    """A row per document, read from the packed files: doc_id, start, n_tokens, ids_crc32, file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                packed = TokenFile(files.mapped(row.path))
                out = []
                for i in range(packed.n_docs):
                    ids = packed.document(i)
                    out.append((packed.doc_id(i), row.before + packed.starts[i], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row.file))
                found = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32", "file"])
                found["doc_id"] = pd.array([r[0] for r in out], dtype="Int64")
                yield found

    spread = written.repartition(max(1, written.count()), "file")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file int")
