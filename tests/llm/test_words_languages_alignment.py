"""Spelling variants, language identification and tokenizer alignment against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import alignment, langid, queries, spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, n long, gram string, block long, doc int, radix int, key long, unseen boolean"
HELD = "crc32(cast(doc_id as string)) % 3 = 1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, data):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, "w", 1, "g", 2, 3, 4, 5, True) for i, t, g in data], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_variants(data, least=6, often=5, slip=199, times=5):
    counts = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= often}
    near = {w: set() for w in n}
    without = {}
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1:]
            without.setdefault((rest, i, len(w)), []).append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in without.values():
        for a, b in itertools.permutations(group, 2):
            if a != b:
                near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def test_spelling_variants(spark, docs):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_variants(data, often=2, slip=7, times=2)
    got = rows(spelling.variants(docs, often=2, slip=7, times=2))
    assert got == want and sum(r[1] is not None for r in want) > 100
    assert rows(spelling.variants(docs)) == plain_variants(data)


def test_spelling_of_odd_words(spark):
    """Chains of forms, ties, repeated bigrams, long words, accents, null ids and texts, repeated rows."""
    rng = random.Random(4)
    text = ["garden"] * 700 + ["gardens"] * 100 + ["gardenss"] * 20 + ["gardensss"] * 5 + ["aaaaaa"] * 50 + ["aaaaaaa"] * 50 + ["aaaaaba"] * 5
    text += ["Éclair"] * 30 + ["éclair"] * 6 + ["ECLAIRS"] * 30 + ["z" * 5000] * 30 + ["z" * 4999 + "y"] * 6 + ["abababab"] * 9 + ["babababa"] * 9
    for _ in range(300):  # near words of all kinds over a small alphabet
        text += ["".join(rng.choice("abc") for _ in range(rng.randrange(6, 9)))] * rng.choice((5, 30, 200))
    data = [(1, " ".join(text)), (None, "garden, " * 9), (None, "garden, " * 9), (2, None), (3, ""), (4, "12 ..."), (5, "short words only")]
    assert rows(spelling.variants(frame(spark, [(i, t, "en") for i, t in data]))) == plain_variants(data)
    assert rows(spelling.variants(frame(spark, []))) == []


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(5)
    for _ in range(300):
        cost = [rng.randrange(50) for _ in range(12)]
        prefix = [(rng.randrange(12), p) for p in rng.sample(range(9), rng.randrange(3, 8))]
        a, b = spelling.pivots_of(prefix, cost)
        assert abs(a[1] - b[1]) >= 2
        least = min(cost[x[0]] + cost[y[0]] for x, y in itertools.combinations(prefix, 2) if abs(x[1] - y[1]) >= 2)
        assert cost[a[0]] + cost[b[0]] == least


def test_language_of_unseen_documents(spark, docs):
    want = {r.doc_id: (r.lang, zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs.collect()}
    got = langid.identify(docs.drop("source"), HELD).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: h for i, (_, h) in want.items()} and len(got) == len(want)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id][0] for r in unseen]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == want[r.doc_id][0] for r in unseen if r.accepted]) >= 0.98


def test_languages_of_odd_texts(spark):
    words = {"xx": "kora tumi sela bano", "yy": "wrzk ptsch grmpf zzrk", "zz": "éàü öèê çñõ ãâî"}
    rng = random.Random(6)
    say = lambda g, n: " ".join(rng.choice(words[g].split()) for _ in range(n))
    data = [(k, say(g, 30), g) for k, g in enumerate(list(words) * 40)]
    data += [(1000 + k, t, g) for k, (t, g) in enumerate([(None, "xx"), ("", "xx"), ("12 .,", "xx"), (say("yy", 90_000), None), ("日本", None), ("a", None)])]
    data += [(None, say("zz", 9), None)] * 2
    got = {(r.doc_id, k): r for k, r in enumerate(sorted(langid.identify(frame(spark, data), HELD).collect(), key=lambda r: (str(r.doc_id), r.score)))}
    by_id = {i: r for (i, _), r in got.items()}
    assert len(got) == len(data)
    assert [by_id[1000 + k].lang_pred for k in range(4)] == ["und", "und", "und", "yy"] and by_id[1000].score == 0 and not by_id[1000].accepted
    assert by_id[1004].lang_pred in words and by_id[None].lang_pred == "zz"
    assert np.mean([by_id[k].lang_pred == g for k, _, g in data[:120] if by_id[k].held_out]) == 1
    assert rows(langid.identify(frame(spark, []), HELD)) == []
    unlabelled = langid.identify(frame(spark, [(1, "text", None)]), HELD)
    assert [tuple(r) for r in unlabelled.select("lang_pred", "score", "accepted").collect()] == [("und", 0.0, False)]


def test_subword_sums_do_not_depend_on_stretches(monkeypatch):
    table = np.append(np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)), np.zeros((1, 3)), 0)
    texts = ["", "one two", "x" * 50, "ab, cd ef! " * 20, "é1ü"]
    want = langid.sums(texts, table)
    for size in (7, 16, 64):
        monkeypatch.setattr(langid, "STRETCH", size)
        got = langid.sums(texts, table)
        assert np.allclose(got[0], want[0]) and (got[1] == want[1]).all() and (got[2] == want[2]).all()


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    spell = lambda n: bytes([int(sp.id_to_piece(n)[3:5], 16)]) if sp.is_byte(n) else sp.id_to_piece(n).replace("▁", " ").encode()
    out, counts = [], Counter()
    for text in texts:
        a, b = ([], []) if not text else (tok.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text))
        left, right = [bytes(alignment.BYTE_OF[c] for c in tok.id_to_token(n)) for n in a], [spell(n) for n in b]
        if not text or not b"".join(left) == b"".join(right) == f" {text}".encode():
            out.append((0, 0, [], ""))
            continue
        ends = dict(zip(itertools.accumulate(map(len, left)), range(1, len(a) + 1), strict=True))
        groups, links, i, j = [], [], 0, 0
        for k, at in enumerate(itertools.accumulate(map(len, right)), 1):
            if at in ends:
                groups.append(",".join(map(str, a[i: ends[at]])) + "|" + ",".join(map(str, b[j:k])))
                i, j = ends[at], k
                links.append((a[i - 1], b[k - 1]))
        counts.update(links)
        out.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(n, m, len(x), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), sha) for n, m, x, sha in out]


@pytest.mark.parametrize(("block", "fan_in"), [(4 << 20, 64), (20_000, 2)])
def test_alignment(spark, docs, monkeypatch, block, fan_in):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    rng = random.Random(7)
    pick = lambda: chr(rng.choice([32, 32, 10, 9, rng.randrange(33, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)]))
    data = [(r.doc_id, r.text, None) for r in docs.collect()]
    odd = ["", None, " ", "  a  b ", "<s> </s> <|endoftext|>", "a▁b", "\n\n x", "x" * 3000, "tab\t x \x1c y \x85 z\xa0w", "long words " * 20_000]
    odd += ["".join(pick() for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    data += [(10**6 + k, t, None) for k, t in enumerate(odd)] + [(None, "no id", None)] * 2
    args = [queries.tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    got = alignment.aligned(frame(spark, data).repartition(5), *args)
    want = [(i, *r) for (i, _, _), r in zip(data, plain_alignment([t for _, t, _ in data]), strict=True)]
    assert rows(got) == sorted(want, key=str)
    assert rows(alignment.aligned(frame(spark, []), *args[:2])) == [] == rows(alignment.aligned(frame(spark, [(1, None, None)]).limit(0), *args))
