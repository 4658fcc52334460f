"""The ten operators against brute force, round trips and held-out accuracy; nulls, empty tables, ties, repeated rows, long texts, clashing columns."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import calibrate, chat, decontaminate, dedup, eliasfano, langid, lm, mixing, mpeg, packing, quality, toxicity
from tephra.llm.shingles import Words, normalised


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


#: Nulls in every column, empty and blank texts, a very long text, repeated rows, columns that clash with inner names.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "x"),
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "b", 0, "y"),
    (4, " \n\t ", None, "b", 3, "y"),
    (5, "word " * 60_000, "de", None, 300_000, "z"),
    (6, "ünïcode ☃ 12 <|endoftext|> it's\x1cok", "de", "c", 9, None),
    (None, "no id here at all", "en", "a", 4, "w"),
]


#: Names that operators might use inside.
CLASHES = "stats bands l p label example_id first_id gone_id mix_id mix_spans mix_row h n file none id root band rep content shard src words taken spans quota held_out score".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, size string").withColumns({c: F.lit("clash") for c in CLASHES})


# 1. language model


def lm_brute(train, texts, order=3):
    tok = lambda t: (t or "").encode().lower().split() + [None]
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        w = tok(t)
        for n in range(1, order + 1):
            counts[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, vocabulary = sum(counts[1].values()), len(counts[1])
    sums, kinds = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            sums[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
    once = [sum(v == 1 for v in c.values()) for c in counts]
    twice = [sum(v == 2 for v in c.values()) for c in counts]
    d = [min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5 for a, b in zip(once, twice, strict=True)]

    def p(g):
        n = len(g)
        if n == 1:
            return max(counts[1][g] - d[1], 0) / total + d[1] * vocabulary / total / (vocabulary + 1)
        if not sums[n][g[:-1]]:
            return p(g[1:])
        return max(counts[n][g] - d[n], 0) / sums[n][g[:-1]] + d[n] * kinds[n][g[:-1]] / sums[n][g[:-1]] * p(g[1:])

    out = []
    for t in texts:
        w = tok(t)
        out.append((len(w), sum(counts[1][(x,)] > 0 for x in w), total, sum(math.log10((counts[1][(x,)] + 1) / (total + vocabulary + 1)) for x in w), sum(math.log10(p(tuple(w[max(0, i - order + 1) : i + 1]))) for i in range(len(w)))))
    return out


def test_lm_matches_brute_force(docs):
    got = {r.doc_id: r for r in lm.rate_documents(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    want = lm_brute([r.text for r in rows if not held[r.doc_id]], [r.text for r in rows])
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], *w[:3])
        assert g.base_score == pytest.approx(w[3], rel=1e-9)
        assert abs(g.score - w[4]) <= 3 * lm.STEP * w[0]  # what quantising may add
    unseen = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in unseen) > sum(g.base_score for g in unseen)


def test_lm_odd_rows_and_several_shards(odd, docs):
    got = lm.rate_documents(odd).collect()
    assert len(got) == len(ODD) and all(g.n_tokens >= 1 for g in got)
    assert lm.rate_documents(odd.limit(0)).count() == 0
    few, many = (lm.score(docs, lm.fit(docs, shard_tokens=s)).orderBy("doc_id").toPandas() for s in (10**9, 5_000))
    assert np.allclose(few["score"], many["score"], atol=1e-6)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (7, 10), (500, 500), (500, 10**7), (3000, 2**44)):
        v = np.unique(rng.integers(0, top, n)).astype(np.uint64)
        ef = eliasfano.EliasFano(eliasfano.encode(v))
        assert (ef.access(np.arange(len(v))) == v).all()
        q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 2, 200).astype(np.uint64)])
        place = np.searchsorted(v, q)
        lo, hi = (place * rng.random(len(q))).astype(int), np.full(len(q), len(v))
        found, equal = ef.successor(q, lo, hi)
        want = (place < len(v)) & (v[np.minimum(place, len(v) - 1)] == q)
        assert (equal == want).all() and (found[equal] == place[equal]).all()


# 2. MPEG audio


def test_media_round_trip(odd, docs):
    import hashlib

    for frame in (odd, docs):
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            want[r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        got = mpeg.read_media(mpeg.store_texts(frame)).collect()
        assert Counter((g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) for g in got) == want
        assert all("crc=" in g.feature and len(g.seek_offsets) == g.n_frames and g.samples == 1152 * g.n_frames for g in got)


def test_foreign_media_have_no_payload(spark):
    whole = mpeg.frames_of(b"x" * 64, {})
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"junk" * 50), (4, bytearray(whole)), (5, bytearray(whole[:100]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in mpeg.read_media(rows).collect()}
    assert len(got) == 5 and all(r.payload_sha256 is None and r.n_bytes is None for r in got.values())
    assert got[1].media_bytes is None and got[3].media_bytes == 200 and got[3].n_frames == 0 and got[4].n_frames > 0


def test_tags_in_payloads_are_payload():
    for size in (64, 128, 192, 960, 1920):
        for mark in (b"TAG", b"ID3"):
            for at in range(size - 2):
                payload = (b"x" * at + mark).ljust(size, b"y")
                data = mpeg.frames_of(payload, {"n_bytes": str(size), "payload_bytes": str(size)})
                got = mpeg.parse(data)
                assert mpeg.payload_of(data, got) == payload and got.skipped == 0 and set(got.tags) == {"n_bytes", "payload_bytes"}, (size, mark, at)


def test_mpeg_damage_and_tables():
    data = mpeg.frames_of(bytes(range(256)) * 20, {"n_bytes": "5120", "payload_bytes": "5120"})
    whole = mpeg.parse(data)
    assert whole.table == "Xing" and whole.table_ok and whole.crc_bad == 0 and whole.skipped == 0
    assert mpeg.payload_of(data, whole) == bytes(range(256)) * 20
    assert whole.seek(0) == whole.offsets[0] and whole.seek(1152 * 2 + 5) == whole.offsets[2] and whole.seek(10**9) is None
    at = whole.offsets[2]
    hurt = mpeg.parse(data[:at] + b"\0\0\0\0" + data[at + 4 :])  # a lost header
    assert hurt.skipped > 0 and set(hurt.offsets) == set(whole.offsets) - {at}
    flipped = bytearray(data)
    flipped[at + 10] ^= 1  # protected side information
    assert mpeg.parse(bytes(flipped)).crc_bad == 1
    junk = mpeg.parse(b"\xff\xfbjunk" + data[whole.offsets[0] :] + b"TAG" + b"Song".ljust(125, b"\0"))
    assert junk.offsets == [o - whole.offsets[0] + 6 for o in whole.offsets] and junk.tags["title"] == "Song"
    assert mpeg.parse(None).samples == mpeg.parse(b"").samples == mpeg.parse(b"\xff" * 50).samples == 0


def test_checksum_covers_all_audio():
    for size in (64, 1000, 4096, 200_000):
        payload = np.random.default_rng(size).bytes(size)
        fields = {"n_bytes": str(size), "payload_bytes": str(size)}
        data = mpeg.frames_of(payload, fields)
        whole = mpeg.parse(data)
        assert mpeg.payload_of(data, whole) == payload and whole.table_ok  # every byte is stored
        audio = b"".join(data[o : o + n] for o, n in zip(whole.offsets, whole.sizes, strict=True))
        at = data.index(b"TPHR0.1") + 32  # after the encoder's 28 bytes and the length
        assert data[at : at + 2] == mpeg.crc16.__wrapped__(audio, 0).to_bytes(2, "big")
        other = mpeg.frames_of(payload[:-1] + bytes([payload[-1] ^ 1]), fields)
        assert other[at : at + 2] != data[at : at + 2]
    sizes = [*range(10), 255, 256, 257, (256 << 10) + 3]
    assert [mpeg.audio_crc(payload.ljust(n, b"y")[:n]) for n in sizes] == [mpeg.crc16.__wrapped__(payload.ljust(n, b"y")[:n], 0) for n in sizes]


def test_streams_of_any_column(spark):
    data = mpeg.frames_of(b"x" * 3000, {"n_bytes": "3000", "payload_bytes": "3000"})
    got = {r.id: r for r in mpeg.streams(spark.createDataFrame([(1, bytearray(data)), (2, None)], "k long, media binary"), id_col="k").collect()}
    assert got[1].seconds == pytest.approx(got[1].samples / 48000) and got[2].n_frames == 0


# 3. mixing


def test_sainte_lague_is_the_highest_quotient_rule():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.integers(0, 9, rng.integers(1, 9)).astype(float)
        caps, seats = rng.integers(0, 12, len(w)), int(rng.integers(0, 40))
        want = np.zeros(len(w), int)
        for _ in range(seats):
            q = np.where((want < caps) & (w > 0), w / (2 * want + 1), -1)
            if q.max() <= 0:
                break
            want[q.argmax()] += 1
        got = mixing.sainte_lague(w, seats, caps)
        assert got.sum() == want.sum() and (got <= caps).all()
        assert np.allclose(np.sort((w / (2 * np.maximum(got, 1) - 1))[got > 0]).min(initial=9), np.sort((w / (2 * np.maximum(want, 1) - 1))[want > 0]).min(initial=9))


def test_targets_fill_up_to_the_cap():
    got = mixing.fill_targets([10, 100, 1000], [5, 2, 1], 3)
    assert got[0] == 30 and got.sum() == pytest.approx(1110) and (got <= [30, 300, 3000]).all()
    assert mixing.fill_targets([], []).sum() == 0 and mixing.fill_targets([0, 0], [5, 2]).sum() == 0


def test_mix_of_documents(docs):
    plan = mixing.plan_mix(docs).toPandas()
    assert (plan["taken"] <= 3 * plan["size"]).all() and len(plan) == docs.count()
    by = plan.groupby("source").agg(t=("target", "first"), n=("taken", "sum"), s=("source_size", "first"))
    assert (abs(by["n"] - by["t"]) <= 64 * 3 + 0.02 * by["t"]).all() and (by["t"] <= 3 * by["s"] + 1e-6).all()
    again = mixing.plan_mix(docs.repartition(7)).toPandas()
    assert plan.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    mixed = mixing.apply_mix(docs, mixing.plan_mix(docs))
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas().set_index("doc_id")["n"]
    taken = plan.set_index("doc_id")["taken"]
    assert words.to_dict() == taken[taken > 0].to_dict()


def test_mix_of_odd_rows(odd):
    got = mixing.plan_mix(odd).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 3 * got["size"]).all()
    assert got[got["size"] == 0]["taken"].sum() == 0 and mixing.plan_mix(odd.limit(0)).count() == 0


def test_stages_keep_clashing_columns(odd, labels):
    for out in (mixing.apply_mix(odd, mixing.plan_mix(odd)), dedup.keep_first(odd), quality.keep_good(odd, labels)):
        assert out.columns == odd.columns and {r.l for r in out.collect()} <= {"clash"}


def test_mix_stage_on_null_and_repeated_ids(spark, folder):
    import corpus_pipeline

    big = 2**60 + 1
    texts = [" ".join(f"{i}.{j}" for j in range(20 + 37 * (i % 7))) for i in range(60)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else big + i, texts[i], "de" if i % 2 else None, None if i % 5 == 0 else "a", i) for i in range(60)]
    rows += rows[:9] * 4 + [(8, None, None, "a", 0), (None, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for p in mixing.plan_mix(docs).where("taken > 0").collect():
        want[p.doc_id, p.source, p.text_sha256] += p.taken
    whole = {}
    for doc_id, text, lang, source, _ in rows:
        for word in (text or "").split():
            whole[word] = doc_id, source, text, lang
    got = Counter()
    mixed = corpus_pipeline.mix_sources(spark, docs, folder).collect()
    for m in mixed:
        doc_id, source, text, lang = whole[m.text.split()[0]]
        assert (m.doc_id, m.source, m.lang, m.n_chars) == (doc_id, source, lang, len(m.text)) and set(m.text.split()) <= set(text.split())
        got[doc_id, source, hashlib.sha256(text.encode()).hexdigest()] += len(m.text.split())
    assert got == want and len(mixed) <= 3 * len(rows)
    assert any(m.doc_id is None for m in mixed) and any(m.doc_id == 7 for m in mixed)


# 4. quality


def test_quality_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.9 and out["score"].between(0, 1).all()


def test_quality_edges(odd, labels, spark):
    got = quality.classify(odd, labels.limit(0)).toPandas()
    assert len(got) == len(ODD) and got["score"].between(0, 1).all()
    assert quality.classify(odd.limit(0), labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_normal_equations_are_the_sum_of_all_rows(docs, labels):
    stats = quality.with_statistics(docs)
    frame = stats.join(labels, "doc_id").select("stats", F.col("quality").cast("double").alias("label"))
    kernel = quality.Kernel(*quality.moments(stats), 16, 5.0, 3)
    zz, zy = quality.normal_equations(frame.repartition(9), kernel)
    rows = frame.collect()
    z, y = kernel(np.array([r.stats for r in rows])), np.array([r.label for r in rows])
    assert np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)


def test_pooling_is_isotonic():
    rng = np.random.default_rng(4)
    n, hits = rng.integers(0, 5, 50), None
    hits = np.array([rng.binomial(k, i / 50) for i, k in enumerate(n)])
    curve = calibrate.pool_adjacent(np.arange(50.0), hits, n, prior=0)
    assert (np.diff(curve(np.linspace(-5, 60, 300))) >= 0).all()
    assert np.average(curve(np.arange(50.0)), weights=n) == pytest.approx(hits.sum() / n.sum(), abs=0.05)
    assert (calibrate.pool_adjacent(np.zeros(0), np.zeros(0), np.zeros(0))(np.zeros(2)) == 0.5).all()


# 5. language


def test_language_on_held_out(docs):
    got = langid.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()


def test_language_edges(odd):
    got = {(r.doc_id, r.lang_pred) for r in langid.classify(odd).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= got
    assert langid.classify(odd.limit(0)).count() == 0
    none = langid.classify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(ODD)


def test_arrays_score_as_the_models_do():
    counts = {"a": langid.count_grams(Counter({"abab": 3, "abba": 1, "c": 2}), 4), "b": langid.count_grams(Counter({"xyx": 2, "ab": 1}), 4)}
    model = langid.build(counts, 4)
    letters = len({g for c in counts.values() for g in c if len(g) == 1})
    words = ["abab", "xyab", "q", "cab"]
    got, n = model.word_scores(words)
    for w, row, k in zip(words, got, n, strict=True):
        marked = langid.START + w + langid.END
        assert k == len(w) + 1
        for lang, value in zip(model.langs, row, strict=True):
            prob, back = langid.kneser_ney(counts[lang], 4, letters)
            assert value == pytest.approx(sum(math.log(langid.prob_of(prob, back, marked[max(0, e - 4) : e])) for e in range(2, len(marked) + 1)), rel=1e-4)
    prob, back = langid.kneser_ney(counts["a"], 4, letters)
    for context in ("", "a", "ab", langid.START):
        seen = {g[-1] for g in counts["a"]} | {c for g in counts["b"] for c in g[-1]}
        assert sum(langid.prob_of(prob, back, context + c) for c in seen) <= 1 + 1e-9


# 6. toxicity


@pytest.mark.parametrize("frequent", [256, 4, 0])
def test_neighbours_are_exact(frequent, monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", frequent)
    rng = np.random.default_rng(6)
    terms = [bytes([97 + i]) for i in range(12)]
    idf = {t: 1.0 + i / 3 for i, t in enumerate(terms)}
    examples = [(1000 - i, int(rng.integers(2)), {t: int(rng.integers(1, 4)) for t in rng.choice(terms, rng.integers(1, 5), replace=False)}) for i in range(700)]
    index = toxicity.Index.build(examples, idf)
    for _ in range(60):
        query = {t: int(rng.integers(1, 3)) for t in rng.choice(terms, rng.integers(1, 4), replace=False)}
        q = index.vector(query)
        cos = np.array([sum(q.get(t, 0) * w for t, w in index.vector(c).items()) for _, _, c in sorted(examples, key=lambda e: e[0])])
        want = [i for i in np.lexsort((np.arange(len(cos)), -cos.round(12))) if cos[i] > 0][:16]
        found, got = index.nearest(query, 16)
        assert found.tolist() == want and np.allclose(got, cos[want])


def test_blocks_below_the_bound_are_not_read(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", 80)
    rng = np.random.default_rng(7)
    halves = [[f"{h}{i}".encode() for i in range(40)] for h in "ab"]
    examples = [(i, i % 2, {t: int(rng.integers(1, 5)) for t in rng.choice(halves[i % 2], 12, replace=False)} | {f"own{i % 100}".encode(): 1}) for i in range(1200)]
    terms = {t for _, _, c in examples for t in c}
    index = toxicity.Index.build(examples, {t: 1.0 if t[:1] in b"ab" else 3.0 for t in sorted(terms)})
    queries = [examples[i][2] for i in range(0, 1200, 7)]
    found = index.nearest_all(queries, 5)
    assert all(f[0][0] == i for f, i in zip(found, range(0, 1200, 7), strict=True)) and 0 < index.read[0] < 0.7 * index.read[1]


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(900):
        words = list(rng.choice(base, 40))
        toxic = int(i % 5 == 0)
        if toxic:
            words[int(rng.integers(40))] = str(rng.choice(["Grub,", "slob."]))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    want = np.array([m[1] for m in marks])
    held = got["held_out"].loc[range(900)].to_numpy()
    assert (got["predicted"].loc[range(900)].to_numpy() == want)[held].all()


def test_toxicity_finds_rare_examples(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{'t' if i % 5 == 0 else 'w'}{x}" for x in rng.integers(0, 10**6, 20))) for i in range(400)]  # no term in five examples
    marks = [(i, int(i % 5 == 0)) for i in range(400)]
    copies = [(1000 + i, text) for i, text in rows]
    docs, labels = spark.createDataFrame(rows + copies, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    assert len(model.index.keys) > 200 and set(model.index.idf) == {t for i, text in rows if i in set(model.index.keys.tolist()) for t in toxicity.terms_of(text)}
    got = toxicity.score(docs, model).toPandas().set_index("doc_id")
    for key, label in zip(model.index.keys, model.index.labels, strict=True):
        copy = got.loc[key + 1000]
        assert copy["neighbours"][0] == key and copy["vote"] == pytest.approx(label, abs=0.35) and len(copy["matched"]) == 16


def test_toxicity_edges(odd, labels):
    got = toxicity.classify(odd, labels).toPandas()
    assert len(got) == len(ODD) and got["score"].between(0, 1).all()
    assert (toxicity.classify(odd, labels.limit(0)).toPandas()["score"].between(0, 1)).all()
    assert toxicity.classify(odd.limit(0), labels).count() == 0


# 7. near duplicates


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        words = normalised(text).split()
        sets[i] = set(zip(*(words[k:] for k in range(5)), strict=False)) or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def varied(seed=8):
    """Groups of near copies of many sizes, chains of them, and documents that share a passage."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 4000, n)]
    rows, passage = [], word(60)
    for size in (1, 2, 3, 40):
        base = word(150)
        for k in range(size):
            copy = list(base)
            for at in rng.integers(0, 150, k % 5):
                copy[at] = f"e{rng.integers(10**6)}"
            rows.append(" ".join(copy))
    chain = word(120)
    for k in range(12):
        chain = chain[3:] + word(3)
        rows.append(" ".join(chain))
    rows += [" ".join(word(100) + passage + word(20)) for _ in range(25)]
    return list(enumerate(rows))


@pytest.mark.parametrize(("block", "elements"), [(512, 400_000), (7, 400_000), (512, 900)])
def test_classes_match_brute_force(spark, block, elements):
    rows = varied()
    got = dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), block=block, elements=elements).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_classes_of_odd_rows(odd):
    got = [(r.doc_id, r.class_id) for r in dedup.near_classes(odd).collect()]
    assert len(got) == len(ODD) and all(a == b for a, b in got) and (None, None) in got
    assert dedup.near_classes(odd.limit(0)).count() == 0
    assert dedup.keep_first(odd).columns == odd.columns


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(9)
    e = np.arange(80, dtype=np.uint64)
    w = rng.integers(0, 7, (2, 80)).astype(float)
    owner, element, weight = np.repeat([0, 1], 80), np.tile(e, 2), w.ravel()
    keep = weight > 0
    s = dedup.signatures(owner[keep], dedup.mix64(element[keep]), weight[keep], 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(*w).sum() / np.maximum(*w).sum(), abs=0.04)
    assert (dedup.signatures(owner[:0], e[:0], weight[:0], 2, 50) == 0).all()


def test_short_and_long_shingles():
    words = Words.of(["a b c", "A, b. C!", "a b c d e f", "", None])
    shingles, bounds = words.shingles()
    assert np.diff(bounds).tolist() == [1, 1, 2, 0, 0] and shingles[0] == shingles[1]


# 8. packed tokens


def test_bits():
    rng = np.random.default_rng(10)
    for width in (1, 5, 8, 15, 16, 17, 31):
        ids = rng.integers(0, 1 << width, 1000).astype(np.uint32)
        data = np.frombuffer(packing.pack_bits(ids, width), np.uint8)
        assert len(data) == -(-1000 * width // 8) and (packing.unpack_bits(data, width, 1000) == ids).all()
        lengths = [0, 300, 700]
        file = packing.TokenFile(np.frombuffer(b"".join(packing.file_bytes([4, 7, 9], lengths, np.tile(ids, 10)[:1000], width)), np.uint8))
        assert (file.ids(123, 987) == ids[123:987]).all() and (file.document(2) == ids[300:]).all() and len(file.document(0)) == 0


def tokens_of(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_rows", [2500, 30])
def test_packed_files_hold_the_tokenizers_ids(docs, file_rows):
    files = packing.write_tokens(docs.repartition(5), tokenizer="byte_bpe_50k.json", end_id=2, file_rows=file_rows)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in packing.read_tokens(files).collect())
    assert got == tokens_of((r.doc_id, r.text) for r in docs.orderBy("doc_id").collect())
    assert files.count() >= docs.count() / file_rows / 2


def test_packing_keeps_large_ids_and_splits_hot_ones(spark):
    top = 2**62 + 1
    rows = [(top, "a b"), (None, "c"), (-(2**63), "d"), *[(7, f"word{i} " * 30) for i in range(300)]]
    made = packing.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer="byte_bpe_50k.json", end_id=2, file_rows=50, file_ids=2_000)
    got = packing.read_tokens(made).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(2**63), *[7] * 300, top] and made.count() > 6 and made.agg(F.max("n_ids")).first()[0] < 2_100
    assert [tuple(r)[:4] for r in got] == tokens_of([(None, "c"), (-(2**63), "d"), *sorted((r for r in rows if r[0] == 7), key=lambda r: r[1]), (top, "a b")])


def test_packing_odd_rows(odd):
    got = packing.read_tokens(packing.write_tokens(odd, tokenizer="byte_bpe_50k.json", end_id=2)).orderBy("start").collect()
    want = tokens_of(sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    assert [tuple(g)[:4] for g in got] == want
    assert packing.read_tokens(packing.write_tokens(odd.limit(0), tokenizer="byte_bpe_50k.json", end_id=2)).count() == 0


def odd_texts(rng, n):
    marks = ["'", "'s", "'ll", "'re", "''", " ", "  ", "\n", "\t", "\r\n", " \n ", ".", "...", "_", "-", "7", "2024", "Haus", " the", "é", "ß", "ÿ", "œ", "’", "€", "º", "x" * 23, "x" * 24, " " * 30, "Zq9" * 4, "=" * 40]
    return ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("bits, block", [(21, 1 << 17), (1, 50)])
def test_parts_have_the_ids_of_whole_texts(bits, block):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = packing.Parts(tokenizer, bits)  # two rows: every part takes another's
    parts.BLOCK = block
    texts = odd_texts(np.random.default_rng(12), 3_000)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [x.tolist() for x in parts.of(texts)] == want
    assert parts.of([]) == [] and [x.tolist() for x in parts.of(["", "a", ""])] == [[], want_of(tokenizer, "a"), []]
    encode, _ = packing.encoder("byte_bpe_50k.json")
    mixed = [*texts[:50], "日本語 text", "a <|endoftext|> b", "x²", "", "nul\0s"]
    assert [x.tolist() for x in encode(mixed)] == [want_of(tokenizer, t) for t in mixed]


def want_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_known_words_cost_little_more_than_a_split(docs):
    import re
    import time

    def best(work):
        taken = []
        for _ in range(5):
            start = time.thread_time()
            work()
            taken.append(time.thread_time() - start)
        return min(taken)

    words = sorted({w for r in docs.collect() for w in (r.text or "").split() if w.isascii()})[:20_000]
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice(words, 500)) for _ in range(600)]
    encode, _ = packing.encoder("byte_bpe_50k.json")
    split = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
    assert best(lambda: list(encode(texts))) < 1.5 * best(lambda: [split(t) for t in texts])


# 9. decontamination


def test_leaks_match_brute_force(spark, folder, docs):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    rng = np.random.default_rng(11)
    items = [r.text for r in bench.collect()]
    planted = []
    for i, text in enumerate(items):
        w = [f"q{x}" for x in rng.integers(0, 10**6, 3000)]
        at, part = int(rng.integers(3000)), text.split()
        part[len(part) // 2] = "changed" if i % 3 == 0 else part[len(part) // 2]
        planted.append((10**6 + i, " ".join(w[:at] + part + w[at:]).upper() if i % 2 else " ".join(w[:at] + part + w[at:])))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id, r.shared) for r in decontaminate.find_leaks(both, bench, block_items=13).collect()}
    sets = [(r.item_id, decontaminate.shingle_set(r.text)) for r in bench.collect()]
    want = set()
    for r in both.collect():
        own = decontaminate.shingle_set(r.text)
        want |= {(r.doc_id, i, len(s & own)) for i, s in sets if s and len(s & own) >= 0.8 * len(s)}
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in decontaminate.drop_leaks(both, bench, block_items=13).collect()}
    assert kept == {r.doc_id for r in both.collect()} - {w[0] for w in want}


def test_short_items_are_not_missed(spark):
    rng = np.random.default_rng(20)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9000, n))
    items = [(i, word(n)) for i, n in enumerate([4, 5, 6, 7, 8, 9, 12, 300] * 25)]
    rows = [(i, word(80) + " " + text + " " + word(500)) for i, text in items] + [(999, word(600))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert found == sorted([(i, i) for i, t in items if len(t.split()) >= 5] + [(i, i) for i, t in items[:3] if len(t.split()) >= 5])
    assert sum(1 for _ in decontaminate.item_blocks(bench, "item_id", "text", 20_000, 4_000)) > 3


def test_leak_edges(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, "too short"), (3, "alpha BETA gamma, delta epsilon zeta")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect()} == {(1, 3)}
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.find_leaks(odd.limit(0), bench).count() == 0


# 10. chat


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(12)
    model = chat.fit([(["User: hi", "more", "AI: yes", "ok?"], [2, 3, 4, 5])])
    for _ in range(20):
        observed = np.column_stack([rng.integers(0, n, 4) for n in chat.SIZES])
        scores = model.scores(observed)
        best = max(model.start[p[0]] + scores[0, p[0]] + sum(model.step[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(p))) for p in itertools.product(range(6), repeat=4))
        assert chat.viterbi(model, observed)[1] == pytest.approx(best)


def test_transcripts_come_back(spark):
    from tephra.llm.queries import op10_chat

    found = op10_chat(spark, "/root/testdata/sf0.1").toPandas()
    assert len(found) == found["conv_id"].nunique() and 0.1 < found["held_out"].mean() < 0.3
    right = found[found["held_out"]].groupby("style")[["roles_match", "turns_match"]].mean()
    assert set(right.index) == set(range(len(chat.STYLES)))
    assert (right.loc[:4].to_numpy() >= 0.99).all() and (right.loc[5].to_numpy() >= 0.9).all(), right


def test_every_style_comes_back_however_long(spark):
    """Transcripts are parsed in batches of any kind: a very long one, repeated ones, ends of blank lines."""
    turns = [("system", "be kind " * 9), ("user", "how " * 20), ("assistant", "\n".join(["so it is " * 30] * 400)), ("user", "and"), ("assistant", "yes " * 120)]
    examples = [chat.example(s, [{"role": r, "text": t.strip()} for r, t in turns]) for s in range(6) for _ in range(5)]
    model = chat.fit(examples)
    texts = [(10 * s + k, "\n".join(chat.example(s, [{"role": r, "text": t.strip()} for r, t in turns])[0]) + "\n" * k) for s in range(5) for k in (0, 1, 3, 3)]
    got = chat.parse(spark.createDataFrame(texts, "conv_id long, transcript string"), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(t.role, t.text.strip()) for t in r.turns] == [(a, b.strip()) for a, b in turns], r.conv_id


def test_summed_counts_make_the_model(spark, folder):
    raw = chat.transcripts(spark.read.parquet(f"{folder}/conversations.parquet")).repartition(5)
    model, rows = chat.fit_on(raw), raw.collect()
    want = chat.fit([chat.example(r.style, r.true_turns) for r in rows])
    assert all(np.allclose(a, b) for a, b in zip((model.start, model.step, *model.emit), (want.start, want.step, *want.emit), strict=True))


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "<|end|> hi"), (None, 0, "bot", "x"), (2, 0, "user", "a\n\nb"), (2, 0, "user", "a\n\nb")], "conv_id long, turn long, role string, text string")
    raw = chat.transcripts(turns)
    got = chat.parse(raw, chat.fit_on(raw)).collect()
    assert len(got) == 3 and all(r.rendered.count("<|end|>") == r.n_turns for r in got)
    empty = spark.createDataFrame([(1, None), (2, "")], "conv_id long, transcript string")
    assert all(r.n_turns == 0 and r.rendered == "" for r in chat.parse(empty, chat.fit([])).collect())
    assert chat.parse(chat.transcripts(turns.limit(0)), chat.fit_on(raw.limit(0))).count() == 0
    blank = spark.createDataFrame([(1, " \n\t\n")], "conv_id long, transcript string")
    assert chat.parse(blank, chat.fit_on(raw)).first().n_turns == 0


# the pipeline


def test_pipeline_stages(spark, folder, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    at = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, folder).cache()
        assert out.columns == docs.columns
        if name != "mix":
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in at.select("doc_id").collect()}
        if name == "near_dedup":
            classes = brute_classes([(r.doc_id, r.text) for r in at.collect()])
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(classes.values())
        at = out
    last = pipeline.STAGES[-1][1](spark, at, folder).orderBy("start").collect()
    assert [tuple(r)[:4] for r in last] == tokens_of((r.doc_id, r.text) for r in at.orderBy("doc_id", "text").collect())


def test_pipeline_stages_on_odd_and_empty_tables(spark, folder, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (odd, odd.limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert out.columns == docs.columns, name
            assert (len(rows) > 0) == (docs is odd), name
        assert stage is not None and (pipeline.STAGES[-1][1](spark, docs, folder).count() == len(ODD)) == (docs is odd)
    # rows of null id are documents of their own: they pass the stages that drop
    kept = pipeline.drop_benchmark(spark, pipeline.near_dedup(spark, odd, folder), folder).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 1 for r in kept) == 2


def test_pipeline_stages_against_their_decisions(spark, folder, docs, labels):
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = {r.doc_id for r in pipeline.filter_quality(spark, docs, folder).collect()}
    assert kept == {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    shingles = lambda t: set(zip(*(normalised(t).split()[i:] for i in range(5)), strict=False))
    items = [s for s in (shingles(t) for _, t in bench) if s]
    clean = {r.doc_id for r in docs.collect() if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in pipeline.drop_benchmark(spark, docs, folder).collect()} == clean


def test_equal_languages_and_neighbours_have_one_answer(spark):
    """Two languages of the same texts, and examples of the same text: the answer does not depend on the order of rows."""
    rows = [(i, "abcd efgh ijkl mnop " * 5, "aa" if i % 2 else "bb") for i in range(40)]
    found = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        found.append(sorted((r.doc_id, r.lang_pred) for r in langid.classify(frame).collect()))
    assert found[0] == found[1] and len({x for _, x in found[0]}) == 1
    index = toxicity.Index.build([(i, i % 2, {b"x": 1, b"y": 2}) for i in range(50)], {b"x": 1.0, b"y": 2.0})
    assert index.nearest({b"x": 1, b"y": 2}, 5)[0].tolist() == [0, 1, 2, 3, 4]
