"""The text operators against plain Python, on edge cases and on the small tables."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat, decontaminate, fingerprint, lm, packing, pii, quality, queries, simhash_dedup, token_counts, warc
from nearfield.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string"
LONG = "lorem ipsum dolor sit amet " * 9000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en"), (2, None, "en"), (3, "", None), (4, LONG, "fr"),
    (4, LONG, "fr"), (None, "null id text here now", None), (None, "null id text here now", None), (7, "<|endoftext|> it's  NFC é ΣΑΣ 5²", "de"),
    (8, " \t\n", "de"), (9, "one", "en"), (10, "The quick brown fox jumps over the lazy dog.", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, g, "s", 0, 5, "w") for i, t, g in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_token_counts(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for df in (docs, odd):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect())
        got = token_counts.token_counts(df, path)
        assert Counter(rows(got.select("doc_id", "n_bytes", "n_tokens"))) == want
        assert rows(got.where("over_limit <> (n_tokens > 2048)")) == []
    assert rows(token_counts.token_counts(none, path)) == []


def test_packing(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path, ranks = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("byte_bpe_50k.tiktoken")
    tok = Tokenizer.from_file(path)
    for df in (docs, odd):
        want = Counter()
        for r in df.collect():
            ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
            at = 0
            for n in packing.cut_points(len(ids), 2048):
                want[r.doc_id, at, n, zlib.crc32(ids[at: at + n].tobytes()), len(ids)] += 1
                at += n
        got = packing.packed(df, path, ranks).collect()
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert rows(packing.packed(none, path)) == []


def test_packing_levels(spark, monkeypatch):
    """Groups hand their rest down until the end, and little is padded."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    sized = spark.range(3000).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"))
    got = sized.join(packing.harmonic(sized, 2048), "uid").toPandas()
    filled = got.groupby("sequence_id").length.sum()
    assert len(got) == 3000 and filled.max() <= 2048 and filled.sum() > 0.8 * 2048 * len(filled)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_lm_score(spark, docs, odd, none):
    train = "crc32(cast(doc_id as string)) % 7 <> 2"
    for df in (docs, odd):
        data = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in df.collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for i, t in data if not held(i) for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in data)
        got = lm.score(df, train).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
        if df is docs:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert rows(lm.score(none, train)) == []


def test_lm_is_a_distribution():
    """For any context the mixture over the vocabulary and one unknown token adds up to one."""
    weights = lm.mixture_weights(np.array([(3 * 301 + 5) * 301 + 20, 7 * 301 * 301 + 12]), np.array([10.0, 3.0]), 0.001)
    assert np.allclose(weights.sum(1), 1) and (weights > 0).all()


def test_simhash_groups(spark, docs, odd, none):
    import xxhash

    def ref(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i: i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))

    for df in (docs, odd):
        data = [(r.doc_id, ref(r.text)) for r in df.collect()]
        fps = sorted({f for _, f in data})
        root = {f: f for f in fps}
        changed = True
        while changed:
            changed = False
            for a in fps:
                for b in fps:
                    if (a ^ b).bit_count() <= 2 and root[a] < root[b]:
                        root[b], changed = root[a], True
        first = {}
        for i, f in data:
            if i is not None:
                first[root[f]] = min(i, first.get(root[f], i))
        want = Counter((i, f"{f:016x}", first.get(root[f])) for i, f in data)
        assert Counter(rows(simhash_dedup.near_duplicates(df))) == want
    assert rows(simhash_dedup.near_duplicates(none)) == []


@pytest.mark.parametrize(("radius", "crowd"), [(2, 0.0), (2, 256.0), (4, 256.0), (3, float("inf"))])
def test_links_have_the_right_components(spark, radius, crowd):
    """A crowd around one fingerprint and scattered ones, with and without the crowd path."""
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**63, 60)}
    for _ in range(80):
        fps.add(12345678901 ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    got = components(simhash_dedup.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, crowd=crowd))
    root = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= radius and root[a] < root[b]:
                    root[b], changed = root[a], True
    size = Counter(root.values())
    assert dict(rows(got)) == {f: r for f, r in root.items() if size[r] > 1}


@pytest.mark.parametrize(("radius", "parts", "crowd"), [(5, 3, 0.0), (5, 3, 20.0), (5, None, 0.0), (3, None, 0.0), (1, None, 0.0), (7, 3, 0.0)])
def test_crowds_with_an_odd_radius_keep_every_link(spark, radius, parts, crowd):
    """Pairs and chains exactly ``radius`` bits apart, away from the least fingerprint of their crowd."""
    rng = np.random.default_rng(2)
    flip = lambda f, n: f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for far in (0, 9, 14, 20):
        centre = flip(12345678901, far)
        for _ in range(25):
            one = flip(centre, int(rng.integers(0, 10)))
            fps |= {one, flip(one, radius)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    got = components(simhash_dedup.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, parts, crowd))
    root = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= radius and root[a] < root[b]:
                    root[b], changed = root[a], True
    size = Counter(root.values())
    assert dict(rows(got)) == {f: r for f, r in root.items() if size[r] > 1}


@pytest.mark.parametrize("crowd", [None, 256.0, 5.0])
def test_an_odd_radius_makes_rows_by_fingerprint(spark, monkeypatch, crowd):
    """A group of near copies five times as large: what is written grows with the fingerprints, not with
    their pairs, however large buckets are, and the components are those of all pairs."""
    sizes, plain = {}, simhash_dedup.written

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash_dedup, "written", counted)
    made = {}
    for n in (40, 200):
        rng = np.random.default_rng(5)
        fps = np.unique(np.concatenate([rng.integers(-(2**63), 2**63, 2 * n), *[
            centre ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 64, (n, 2)), axis=1) for centre in rng.integers(-(2**63), 2**63, 2)]]))
        sizes.clear()
        links = simhash_dedup.near_links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 5, 3, crowd)
        got = dict(rows(components(links)))
        made[n] = sum(sizes.values()) + links.count()
        near = np.bitwise_count((fps[:, None] ^ fps).view(np.uint64)) <= 5
        root = np.arange(len(fps))
        while not np.array_equal(least := np.where(near, root, len(fps)).min(1), root):
            root = least
        size = np.bincount(root, minlength=len(fps))
        assert got == {int(f): int(fps[r]) for f, r in zip(fps, root, strict=True) if size[r] > 1}
        assert made[n] <= (60 if crowd is None else 120) * len(fps)
    assert made[200] < 15 * made[40]  # by pairs it would be 25


def test_representatives(spark, odd, none):
    base = [f"w{i}" for i in range(60)]
    near = base[:58] + ["x", "y"]
    far = base[:20] + [f"v{i}" for i in range(40)]
    df = spark.createDataFrame([(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(far)), (8, " ".join(base)), (8, " ".join(base))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.representatives(df).collect()) == [5, 7]
    kept = simhash_dedup.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "7", "9", "None"]
    assert rows(simhash_dedup.representatives(none)) == []


def test_representatives_of_many_families(spark):
    """More families than a few rounds can name, all with the same words and so in one group."""
    rng = np.random.default_rng(3)
    data, words = [], [f"w{i}" for i in range(60)]
    for _ in range(30):
        text = list(rng.permutation(words))
        for _ in range(4):
            data.append((int(rng.integers(0, 10**6)), " ".join(text)))
            at = int(rng.integers(0, 59))  # drifts, so that the first and the last may differ too much
            text[at], text[at + 1] = text[at + 1], text[at]
    sets = {i: {tuple(w[a: a + 5]) for a in range(56)} for i, t in data for w in [t.split()]}
    want = []
    for i in sorted(sets):
        if all(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for j in want):
            want.append(i)
    got = simhash_dedup.representatives(spark.createDataFrame(data, "doc_id long, text string"))
    assert 30 <= len(want) < len(sets) and sorted(r.doc_id for r in got.collect()) == want


def test_representatives_beyond_the_radius(spark, monkeypatch):
    """Near copies go however many bits their fingerprints differ in."""
    rng = np.random.default_rng(8)
    data = []
    for family in range(40):
        text = [f"f{family}x{i}" for i in range(24)] + ["a line that all of them have in common"]
        for _ in range(3):
            data.append((len(data), " ".join(text)))
            text[int(rng.choice([0, 23]))] = f"n{len(data)}"
    data += [(len(data), "ÉTÉ à la mer"), (len(data) + 1, "été à la mer")]
    sets = {i: {tuple(w[a: a + 5]) for a in range(max(1, len(w) - 4))} for i, t in data for w in [t.lower().split()]}
    near = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    fps = {i: simhash_dedup.fingerprint(t, 1, damped=True) for i, t in data}
    assert sum((fps[i] ^ fps[j]).bit_count() > 5 for i, j in near) > 10
    want = []
    for i in sorted(sets):
        if not any((j, i) in near for j in want):
            want.append(i)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.representatives(df).collect()) == want
    monkeypatch.setattr(simhash_dedup, "SHINGLE_ROWS", 7)
    links = simhash_dedup.shingle_links(df.repartition(5), 0.8, 5)
    key = {r.doc_id: r.k for r in df.selectExpr("doc_id", "xxhash64(text) AS k").collect()}
    root = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert all(root[key[i]] == root[key[j]] for i, j in near)
    assert rows(simhash_dedup.shingle_links(df.limit(0), 0.8, 5)) == []
    batch = lambda *r: pa.RecordBatch.from_pydict({"token": [x for x, _ in r], "text_key": pa.array([y for _, y in r], pa.int64())})
    parts = [batch((1, 4), (1, 4), (1, 6)), pa.RecordBatch.from_pydict({"token": pa.array([], pa.int64()), "text_key": pa.array([], pa.int64())}), batch((1, 7), (2, 7)), batch((2, 8), (3, 8))]
    assert [(r["a"], r["b"]) for b in simhash_dedup._starred(parts) for r in b.to_pylist()] == [(4, 6), (4, 7), (7, 8)]


def test_decontamination(spark, docs, odd, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t or "").split())

    def shingles(t):
        w = norm(t).split()
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}

    texts, asked = [(r.doc_id, shingles(r.text)) for r in docs.collect()], [(r.item_id, shingles(r.text)) for r in items.collect()]
    want = sorted((d, i, len(a & s)) for d, s in texts for i, a in asked if a and len(a & s) >= math.ceil(0.8 * len(a)))
    assert sorted(rows(decontaminate.contained(docs, items).select("doc_id", "item_id", "shared"))) == want
    small = spark.createDataFrame([(1, "Quick, brown"), (2, None), (3, ""), (4, "one"), (5, "fox quick")], "item_id long, text string")
    assert sorted(rows(decontaminate.contained(odd, small).select("doc_id", "item_id"))) == [(1, 1), (9, 4), (10, 1)]
    assert rows(decontaminate.contained(none, small)) == [] == rows(decontaminate.contained(odd, small.limit(0)))
    assert decontaminate.clean(odd, small).count() == len(ODD) - 3


def test_edited_fingerprints(spark, docs, odd, none, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_BYTES", 1 << 16)
    data = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    want = {i: (len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + data[(k + 1) % len(data)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(data)}
    got = fingerprint.edited_fingerprints(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(want)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.1
    got = fingerprint.edited_fingerprints(odd).collect()
    assert len(got) == len(ODD)
    by_text = {r.doc_id: r.fingerprint for r in got}
    assert by_text[1] == by_text[10] and by_text[2] == by_text[3] == "0" * 16
    assert rows(fingerprint.edited_fingerprints(none)) == []


def plain_fingerprint(text):
    """Votes of all terms on each bit, one by one."""
    import regex
    import xxhash

    votes, weight = [0] * 64, 0
    for term in regex.split(r"[^\p{L}\p{N}]+", text.lower()):
        w, h = min(len(term), 31) ** 2, xxhash.xxh64_intdigest(term.encode(), 42)
        weight += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return f"{sum(1 << b for b in range(64) if 2 * votes[b] > weight):016x}"


def test_fingerprints_against_plain_python(spark, docs, odd):
    for df in (docs.where("doc_id < 200"), odd.where("doc_id IS NOT NULL")):
        data = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (-r[0], r[1]))
        likeness = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        want = []
        for k, (i, t) in enumerate(data):
            after = data[(k + 1) % len(data)][1]
            mine, other = plain_fingerprint(t), plain_fingerprint(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
            want.append((i, mine, other, likeness(mine, other), likeness(mine, plain_fingerprint(after))))
        got = rows(fingerprint.edited_fingerprints(df).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
        assert sorted(got) == sorted(want)


def test_block_tables_find_all_neighbours(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 30)]
    fps = base + [f ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 5), replace=False)) for f in base for _ in range(3)]
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = rows(fingerprint.neighbours(spark.createDataFrame([(f,) for f in fps], "fp long"), 3))
    assert set(got) == want and len(got) == len(want)


def test_crowded_keys_are_cut_into_a_grid(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "CROWD", 7)
    rng = np.random.default_rng(3)
    fps = sorted({sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(150)})
    table = spark.createDataFrame([(f, f % 5) for f in fps], "fp long, rest long")
    asked = table.where("rest = 1").select(F.col("fp").alias("q"))
    for radius, blocks in ((3, 5), (3, 6), (2, 4)):
        want = {(a, b, b % 5) for a in fps for b in fps if a % 5 == 1 and (a ^ b).bit_count() <= radius}
        got = rows(fingerprint.within(asked, table, radius, blocks))
        assert set(got) == want and len(got) == len(want) > 100
    assert [fingerprint.block_count(n, 3) for n in (0, 10**8, 10**10, 10**30)] == [5, 5, 6, 10]


def test_near_documents_against_all_pairs(spark, docs, odd, none):
    few = docs.where("doc_id < 300").select("doc_id", "text")
    some = few.unionByName(few.where("doc_id % 3 = 0").selectExpr("doc_id + 1000", "concat(text, ' end')").toDF("doc_id", "text"))
    for df in (some, odd):
        got = rows(fingerprint.edited_fingerprints(df, "doc_id % 2 = 0").select("doc_id", "fingerprint", "n_near"))
        fps = [int(f, 16) for _, f, _ in got]
        want = [sum((fp ^ x).bit_count() <= 3 for x in fps) - 1 if i is not None and i % 2 == 0 else None for (i, _, _), fp in zip(got, fps, strict=True)]
        assert [n for _, _, n in got] == want and any(want)
    assert rows(fingerprint.edited_fingerprints(none)) == []


def test_quality(spark, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = quality.quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()
    assert len(got) == docs.count()
    assert not any(r.keep for r in got if marks.get(r.doc_id) == 0)
    assert np.mean([r.keep for r in got if marks.get(r.doc_id) == 1]) > 0.85
    got = {r.doc_id: r for r in quality.quality(odd, labels.limit(0)).collect()}
    assert len(got) == 9 and got[1].keep and not got[2].keep and got[8].perplexity is None
    assert rows(quality.quality(none, labels)) == []
    assert quality.kept(odd, labels.limit(0)).columns == odd.columns


def test_kneser_ney_sums_to_one(spark):
    counts = spark.createDataFrame([("\x02.", 4), ("\x02.a", 3), ("\x02.b", 1), ("\x02.ab", 2), ("\x02.aa", 1), ("\x02.ab\x03", 2)], "gram string, n long")
    alpha, gamma, floor = quality.kneser_ney(counts)
    one = {r.gram: r.alpha for r in alpha.collect() if len(r.gram) == 1}
    weight = {(r.context, r.k): r.gamma for r in gamma.collect()}[("", 1)]
    assert math.isclose(sum(one.values()) + weight * floor * (len(one) + 1), 1)


def test_pii(spark, odd, none):
    swap = pii.Pseudonyms(b"k")
    card, phone = "4018193518611749", "+1 (523) 555-8941"
    out, n = swap(f"a {card} b {phone}, 10.0.0.7 at 2020-02-29; DE89 3704 0044 0532 0130 00 joe.doe1@mail.example.com 4018193518611748")
    assert n == 6 and card not in out and phone not in out and "joe.doe" not in out and out.endswith(" 4018193518611748")
    new = out.split()[1]
    assert len(new) == 16 and pii.luhn(new[:-1]) == int(new[-1])
    assert swap(f"x {card}.")[0] == f"x {new}."
    assert swap("29.02.2020 29.02.2021 3.14 a:b") != ("29.02.2020 29.02.2021 3.14 a:b", 0) and swap("29.02.2021 3.14")[1] == 0
    for text in ('TOKEN = "9233A8fe77Ab12"', "Api_Key: 9233A8fe77Ab12", "password=9233A8fe77Ab12"):
        out, n = swap(text)
        assert n == 1 and "9233A8" not in out and len(out) == len(text) and out.split("9")[0][:5] == text[:5]
    assert swap("call 000-000-0000 now") == ("call 000-000-0000 now", 0)
    assert swap("523-555-8941")[0] == swap("x 523-555-8941 " * 20000)[0].split()[1]  # linked, also in long texts
    for size in (1, 2, 1000):
        images = [pii.permute(v, size, b"k", "t") for v in range(size)]
        assert sorted(images) == list(range(size)) and [pii.permute(v, size, b"k", "t", True) for v in images] == list(range(size))
    got = pii.pseudonymise(odd, b"k")
    assert got.columns == odd.columns and Counter(r.text for r in got.collect()) == Counter(t for _, t, _ in ODD)
    assert rows(pii.pseudonymise(none, b"k")) == []


def test_warc_audit(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i * 37 % 4000)) for i in range(300)] + [(None, None, None), (5, "http://a/5", "x")], "page_id long, url string, html string")
    records = warc.layout(pages)
    assert rows(warc.audit(warc.manifest(records), warc.manifest(records))) == []
    other = records.where("page_id <> 17 OR page_id IS NULL").withColumn("payload", F.when(F.col("page_id") == 200, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    got = warc.audit(warc.manifest(records), warc.manifest(other)).join(records, ["file", "offset"]).select("page_id", "kind")
    assert sorted(rows(got)) == [(17, "missing"), (200, "corrupt")]
    empty = warc.manifest(records.limit(0))
    assert rows(warc.audit(empty, empty)) == [] and warc.audit(empty, warc.manifest(records)).where("kind <> 'extra'").count() == 0


def test_chat_blocks_equal_one_path(spark, monkeypatch):
    """Composed blocks give the score of the plain path over the whole conversation."""
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "FAN_IN", 2)
    labelled = queries.transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    move, show = chat.train(labelled)
    raw = labelled.drop("role").where("conv_id < 8")
    got = defaultdict(list)
    for r in sorted(chat.decode(raw, (move, show)).collect(), key=lambda r: (r.conv_id, r.seq, r.line)):
        got[r.conv_id].append(r.state)
    score = lambda p, s: sum(move[a, b] + show[b, x] for a, b, x in zip([chat.START, *p], p, s, strict=False))
    for conv in got:
        symbols = [r.symbol for r in chat.lines(raw.where(F.col("conv_id") == conv)).orderBy("seq", "line").collect()]
        assert math.isclose(score(got[conv], symbols), score(chat.viterbi(np.array(symbols), move, show, chat.START), symbols))


def test_chat_roles(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in queries.op9_chat(spark, SF).collect()}
    want = {(r.conv_id, r.turn): r.role for r in conversations.collect()}
    for unseen in (False, True):  # conversations whose labels were held back
        of = [k for k in want if (zlib.crc32(str(k[0]).encode()) % 3 == 1) == unseen]
        assert len(of) > 20 and np.mean([k in got and got[k].role == want[k] for k in of]) > 0.95
    odd = spark.createDataFrame([(1, 0, None), (None, None, "Assistant: hi"), (1, 0, None)], "conv_id long, seq long, text string")
    out = chat.formatted(odd, queries.transcripts(conversations)).collect()
    assert any(r.role == "assistant" and r.text == "hi" for r in out)
    assert rows(chat.formatted(odd.limit(0), queries.transcripts(conversations))) == []
    apart = spark.createDataFrame([(None, 0, "User: a"), (-1, 0, "User: b")], "conv_id long, seq long, text string")
    out = chat.formatted(apart, queries.transcripts(conversations)).collect()
    assert sorted(((r.conv_id, r.text) for r in out), key=str) == [(-1, "b"), (None, "a")]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        data = stage(spark, data, SF)
        assert data.columns == columns, name
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    assert ids == {r.doc_id for r in data.select("doc_id").collect()} and 0 < len(ids) < docs.count()
    leaks = {r.doc_id for r in decontaminate.contained(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not ids & leaks


def test_columns_named_like_the_helpers(spark):
    """Stages keep every column, also those whose names they use inside."""
    names = ["good_key", "leak_id", "leak_hash", "chosen_id", "chosen_key", "row_key", "doc_key", "item_key", "root", "fp", "w", "h"]
    df = spark.createDataFrame([(i, t, g, *[7] * len(names)) for i, t, g in ODD], "doc_id long, text string, lang string, " + ", ".join(f"{c} long" for c in names))
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "Quick, brown")], "item_id long, text string")
    for got in (quality.kept(df, labels), decontaminate.clean(df, items), simhash_dedup.representatives(df), pii.pseudonymise(df, b"k")):
        assert got.columns == df.columns and all(r.good_key == 7 for r in got.collect())


def test_items_that_share_an_id_are_separate(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (None, "alpha"), (None, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "alpha"), (5, "beta"), (5, "beta"), (None, "gamma"), (6, "delta"), (7, None)], "item_id long, text string")
    got = rows(decontaminate.contained(docs, items).select("doc_id", "item_id", "shared", "n_shingles", "containment"))
    assert sorted(got, key=str) == sorted([(1, 5, 1, 1, 1.0), (1, 5, 1, 1, 1.0), (1, None, 1, 1, 1.0), (2, 5, 1, 1, 1.0), (None, 5, 1, 1, 1.0)], key=str)


def test_decontamination_goes_through_the_sketch(spark, monkeypatch):
    """Without sketch rows there are no candidates, however much a document shares."""
    whole = decontaminate.item_shingles
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight")], "doc_id long, text string")
    assert decontaminate.contained(docs, items).count() == 1
    monkeypatch.setattr(decontaminate, "item_shingles", lambda *a: whole(*a).withColumn("sketch", F.lit(False)))
    assert decontaminate.contained(docs, items).count() == 0


def plain_probabilities(counts):
    """Interpolated modified Kneser-Ney over symbol n-grams, by the definition."""
    levels = [{g: n for g, n in counts.items() if len(g) == quality.ORDER}]
    for k in range(quality.ORDER - 1, 0, -1):
        lower = Counter(g[1:] for g in levels[-1])
        if k > 1:
            lower.update({g: n for g, n in counts.items() if len(g) == k})
        levels.append(dict(lower))
    model = {}
    for level in levels:
        k = len(next(iter(level)))
        seen = Counter(level.values())
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] + seen[2] else None
        cut = {i: 0.5 * i if y is None or not seen[i] else min(max(i - (i + 1) * y * seen[i + 1] / seen[i], 0.1 * i), 0.9 * i) for i in (1, 2, 3)}
        total, off = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            off[g[:-1]] += cut[min(n, 3)]
        model[k] = (level, total, off, cut)
    floor = 1 / (len(levels[-1]) + 1)

    def p(g):
        if not g:
            return floor
        level, total, off, cut = model[len(g)]
        n, all_of = level.get(g, 0), total[g[:-1]]
        share = (n - cut[min(n, 3)]) / all_of if n else 0.0
        return share + (off[g[:-1]] / all_of if all_of else 1.0) * p(g[1:])

    return p


def plain_units(text):
    out, last = [], None
    for n, word in enumerate((text or "").split()):
        gap = "." if n == 0 else "=" if word == last else "." if last[-1] in ".!?:" else " "
        out.append(gap + word)
        last = word
    return out


def plain_grams(unit):
    s = quality.BEGIN + unit + quality.END
    return [s[max(0, i - quality.ORDER): i] for i in range(2, len(s) + 1)]


def plain_perplexities(data, trusted):
    counts = Counter(g for i, t in data if i in trusted for u in plain_units(t) for g in plain_grams(u))
    p = plain_probabilities(counts)
    out = {}
    for i, t in data:
        grams = [g for u in plain_units(t) for g in plain_grams(u)]
        out[i] = 10 ** (-sum(math.log10(p(g)) for g in grams) / len(grams)) if grams else None
    return out


def test_perplexities_against_plain_python(spark, docs):
    data = [(r.doc_id, r.text) for r in docs.collect() if all(c not in (r.text or "") for c in "\x1c\x1d\x1e\x1f\x85\xa0")]
    trusted = {i for i, _ in data if i % 3 == 0}
    want = plain_perplexities(data, trusted)
    df = docs.where(F.col("doc_id").isin([i for i, _ in data]))
    got = {r.doc_id: r.perplexity for r in quality.perplexities(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) if want[i] else got[i] is None for i in want)


def test_quality_without_rare_counts(spark):
    """Copies of one trusted text leave count classes empty; the discounts are still defined."""
    text = "aaaa bbbb abab baba aaaa bbbb"
    data = [(i, text) for i in range(1, 7)] + [(9, "zz aa")]
    df = spark.createDataFrame([(i, t, "en") for i, t in data], "doc_id long, text string, lang string")
    want = plain_perplexities(data, set(range(1, 7)))
    got = {r.doc_id: r.perplexity for r in quality.perplexities(df, spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long")).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)
    assert quality.quality(df, spark.createDataFrame([(i, 1) for i in range(1, 7)], "doc_id long, quality int")).count() == 7


def test_grams_of_many_symbols():
    """More symbols than five of them fit in a number are numbered step by step, with the same grams."""
    import pyarrow as pa

    for units in ([".ab", " abc", "=x"], ["." + "".join(map(chr, range(0x4E00, 0x4E00 + 9000))), " aa"], []):
        owner, ids, grams = quality.grams_of(pa.array(units, pa.string()))
        got = [[] for _ in units]
        for o, i in zip(owner.tolist(), ids.tolist(), strict=True):
            got[o].append(grams[i].as_py())
        assert got == [plain_grams(u) for u in units] and len(set(grams.to_pylist())) == len(grams)


def test_grams_of_a_block_take_little_memory():
    """Arrays of symbols are given back as soon as they are used: blocks of 6 MB share an executor's memory."""
    rng = np.random.default_rng(3)
    units = pa.array([" " + "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 14))) for _ in range(20_000)])
    quality.grams_of(units.slice(0, 10))
    tracemalloc.start()
    owner, ids, grams = quality.grams_of(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * len(owner)  # 154 bytes a symbol before
    want = [g for unit in units.to_pylist() for g in plain_grams(unit)]
    assert grams.take(pa.array(ids)).to_pylist() == want
