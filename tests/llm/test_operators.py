"""Each operator against a brute-force version, on small tables with awkward rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiforge.llm import bpe, components, ctw, fingerprint, langid, line_dedup, minhash, packing, queries, token_counts, topk, warc
from lexiforge.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, cid long, _host string, label string"
SEED = "the of and to in is a for on was that with thonre wereth inghat oution estedly".split()


@pytest.fixture(scope="module")
def rows(spark, sf):
    """(doc_id, text) with nulls, empties, copies, near copies, special strings, odd spaces and a long word."""
    rnd = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    base = " ".join(rnd.choice(SEED) + str(rnd.randrange(60)) for _ in range(300))
    words = base.split()
    near = []
    for i in range(25):
        w = words[:]
        for _ in range(rnd.randrange(1, 14)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(1000)}"
        near.append(" ".join(w))
    odd = [None, "", " ", "\n\n", "one", "one two", "ONE  two", "1234 !?", "a<|endoftext|>b <|endoftext|>", " x  y \n z ", "é中文 ½ Ⅷ it's we'll", "w" * 3000, "tail space ", base, base, base.upper(), "﻿ wide space", "12 34 56"]
    texts += odd + near
    out = [(i * 7 % 1009, t, None if i % 9 == 0 else ["en", "fr"][i % 2], None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [(None, "no id here at all", "en", "s0", 17), out[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([r + (1, "k", 2, "h", "l") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def by_text(rows, f):
    return Counter((r[0], *f(r[1])) for r in rows)


def test_bpe_against_library(docs, rows, tok):
    def want(t):
        ids = ids_of(tok, t)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, bpe.encode_decode_digests(docs).collect())) == by_text(rows, want)


def test_bpe_random_strings(tok):
    rnd = random.Random(5)
    parts = [*"abcdefgh  \n\t'sd é中1½Ⅷ\x1c\x85 　!?-_ZQ", "'s", "'ll", "<|endoftext|>", "  ", " \n", "ing", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(4000)] + ["ab" * 3000, " " * 700, "=-" * 900]
    enc, library = bpe.id_encoder(tokenizer_path()), bpe.id_encoder(tokenizer_path(), trie=False)
    for t, got, same, want in zip(texts, enc.encode(texts), library.encode(texts), tok.encode_batch(texts, add_special_tokens=False)):
        assert got == same == bpe.pack_ids(want.ids), t
        assert bpe.decode(tokenizer_path(), got) == tok.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["\n" * 1_100_000 + "x y", " " * 1_100_000, "a " + "\t" * 150_000 + " <|endoftext|>b", "\x1c" * 120_000])
def test_bpe_long_runs(tok, text):
    want = tok.encode(text, add_special_tokens=False).ids
    assert bpe.id_encoder(tokenizer_path()).encode([text]) == bpe.id_encoder(tokenizer_path(), trie=False).encode([text]) == [bpe.pack_ids(want)]
    assert token_counts.Counts(tokenizer_path(), {}).of_text(text) == len(want)


def test_bpe_round_trip_table(docs, rows):
    got = bpe.decode_table(bpe.encode(docs))
    assert Counter(map(tuple, got.collect())) == by_text(rows, lambda t: (t or "",))


def test_token_counts(docs, rows, tok):
    for size in (3, 4096):
        got = token_counts.token_counts(docs, limit=100, table_size=size)
        assert Counter(map(tuple, got.collect())) == by_text(rows, lambda t: (len((t or "").encode()), n := len(ids_of(tok, t)), n > 100))


AWKWARD_SPACES = ["a  b", "a \n b  c ", " \u3000x\x85 y", "tail  ", "it's  don't  12ab--", "x\x1c y\x1d\x1e  z", "<|endoftext|>  a<|endoftext|> ", " ", "  ", "a\u00a0 b", "\t \n"]


def test_token_counts_of_awkward_spaces(spark, tok):
    """Runs of white space meet table and cache as other texts do; what the table holds changes no count."""
    rnd = random.Random(9)
    texts = AWKWARD_SPACES + ["".join(rnd.choice(AWKWARD_SPACES) for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    want = [len(ids_of(tok, t)) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frequent = token_counts.frequent_pre_tokens(df, tokenizer_path(), 5)
    exact = Counter(w for t in texts for part in t.split("<|endoftext|>") for w in bpe.PRE_TOKEN.findall(part))
    assert frequent == sorted(exact, key=lambda w: (-exact[w], w))[:5]
    for table in ({}, {t: len(ids_of(tok, t)) for t in frequent}):
        own = token_counts.Counts(tokenizer_path(), table, most=20)
        assert [own.of_text(t) for t in texts] == want
    assert [r["n_tokens"] for r in token_counts.token_counts(df, table_size=5).orderBy("doc_id").collect()] == want


def test_chunks_end_where_pre_tokens_do():
    """For every code point: the chunks' pre-tokens are the text's."""
    for at in range(0, 0x11000, 97):
        for c in map(chr, range(at, min(at + 97, 0xD800))) if at < 0xD800 else ():
            t = f"a{c} {c}b 1{c}{c} x{c}"
            assert [w for k in token_counts.CHUNK.findall(t) for w in token_counts.pre_tokens(k)] == bpe.PRE_TOKEN.findall(t)


def test_packing(docs, rows, tok):
    got = packing.pack_documents(docs, window=256, max_piece=64, group=40).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 256
    total = sum(len(ids_of(tok, r[1])) + 1 for r in rows)
    assert sum(r["length"] for r in got) == total
    assert len(seqs) * 256 < 1.1 * total
    for doc_id, text, *_ in rows[1:]:
        ids = [*ids_of(tok, text), 1]
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        if doc_id is None or doc_id == rows[0][0]:
            continue
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def plain_difference(sizes, k):
    """Karmarkar-Karp step by step on lists of lists; the sums of its windows."""
    parts = [([[s]] + [[] for _ in range(k - 1)]) for s in sizes]
    spread = lambda p: max(map(sum, p)) - min(map(sum, p))
    while len(parts) > 1:
        parts.sort(key=lambda p: -spread(p))
        a, b = (sorted(p, key=lambda w: -sum(w)) for p in parts[:2])
        parts = [[x + y for x, y in zip(a, reversed(b))], *parts[2:]]
    return sorted(map(sum, parts[0])) if parts else []


def test_differencing_against_plain_steps():
    rnd = random.Random(2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook case
    for _ in range(200):
        k, n = rnd.randrange(1, 5), rnd.randrange(1, 12)
        sizes = rnd.sample(range(1, 10**9), n)  # no two partitions of equal spread, so the steps are given
        got = packing.difference(sizes, k)
        assert sorted(i for w in got for i in w) == list(range(n))
        assert sorted([0] * (k - len(got)) + [sum(sizes[i] for i in w) for w in got]) == plain_difference(sizes, k)


def test_differencing_is_near_equal():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 500) for _ in range(600)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 50)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 60
    assert packing.difference([5], 1) == [[0]] and packing.pack([2048, 2048]) and packing.difference([], 3) == []


def brute_groups(rows, size, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(groups[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("shingle,k", [(4, 64), (5, 16), (5, 64), (5, 10**9)])
def test_near_duplicates(docs, rows, shingle, k):
    got = minhash.near_duplicates(docs, shingle=shingle, k=k).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == brute_groups(rows, shingle, 80)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)


def test_near_duplicates_chain_and_shared_passage(spark):
    """Texts that only neighbours of a chain are linked with, and a passage that dominates texts that aren't linked."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 8 : i * 8 + 200])) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(100))
    shared = [(100 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(30 + i % 3))) for i in range(40)]
    rows = chain + shared
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_groups(rows, 3, 80)


def test_near_duplicates_on_both_sides_of_k(spark):
    """Groups of two near copies, one of at most k = 64 shingles and the other of more: full sets and whole sketches meet."""
    sizes = [(n, more) for n in range(52, 65) for more in (65, 66, 72, 80) if 100 * n >= 80 * more]
    rows = []
    for i, (n, more) in enumerate(sizes):
        words = [f"g{i}w{j}" for j in range(more + 4)]
        rows += [(2 * i, " ".join(words[: n + 4])), (2 * i + 1, " ".join(words))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()))
    assert found == brute_groups(rows, 5, 80)
    assert sum(i != c for i, _, c in found) == len(sizes)


def test_near_duplicates_null_ids(spark):
    """Long texts without an id are linked as others are, and a text without an id joins two texts that aren't linked."""
    words = [f"w{i}" for i in range(300)]
    bridge = [(1, " ".join(words[:200])), (None, " ".join(words[18:218])), (2, " ".join(words[36:236]))]
    pair = [(None, " ".join(f"n{i}" for i in range(100))), (3, " ".join(f"n{i}" for i in range(104)))]
    repeated = [(9, " ".join(f"r{k}x{i}" for i in range(90 + more))) for k in range(3) for more in (0, 5)]
    rows = bridge + pair + repeated
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_groups(rows, 5, 80)


@pytest.mark.parametrize("k,block,least", [(64, 1 << 20, 1 << 11), (64, 3000, 100), (16, 2000, 500)])
def test_near_duplicates_in_parts(spark, monkeypatch, k, block, least):
    """Homes in one block and in many parts: groups whose members are similar, linked or not, and a long text with its copy."""
    monkeypatch.setattr(minhash, "BLOCK_VALUES", block)
    monkeypatch.setattr(minhash, "LEAST_VALUES", least)
    rnd = random.Random(12)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(25):
            w = base[:]
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w)))
    long = [f"l{i % 5000}x{i // 7}" for i in range(60_000)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:-3000])), (1002, " ".join(long[30_000:]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=k)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_groups(rows, 5, 80)


def test_block_links_against_all_pairs():
    """Components of a block, within one side and between two, against the similarity of every pair."""
    rnd = np.random.default_rng(13)
    for trial in range(12):
        base = np.unique(rnd.integers(0, 2**62, 150))
        sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(60, 140), replace=False), rnd.integers(0, 2**62, rnd.integers(0, 25))])) for _ in range(40)]
        for split in (None, 15):
            up = list(range(40))
            find = lambda x: x if up[x] == x else find(up[x])  # noqa: B023, E731
            for i in range(40):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and (split is None or (j < split <= i)):
                        a, b = find(i), find(j)
                        up[max(a, b)] = min(a, b)
            got = minhash.block_links(sets if split is None else sets[:split], None if split is None else sets[split:], 64, 80)
            assert got.tolist() == [find(i) for i in range(40)]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(50, 90)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(90)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}


def test_language_id(spark, sf):
    got = queries.op3_language_id(spark, sf.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(truth, "doc_id").collect()
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_id_awkward(docs, none, rows, spark):
    got = langid.identify_documents(docs).collect()
    assert len(got) == len(rows)
    letters = {t for _, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert Counter(r["lang_pred"] == "und" for r in got) == Counter(r[1] not in letters for r in rows)
    assert langid.identify_documents(none).count() == 0
    one = spark.createDataFrame([(1, "abc def", "xx"), (2, "??", "xx")], "doc_id long, text string, lang string")
    assert {(r[0], r[2], r[3]) for r in langid.identify_documents(one).collect()} == {(1, "xx", 1.0), (2, "und", 0.0)}


def test_language_sample_of_hot_ids(spark):
    """Rows without an id, of one id, or all alike take no other language's place in the sample."""
    hot = [(None, f"words without id {i}", "aa") for i in range(7000)] + [(5, f"words of one id {i}", "bb") for i in range(7000)] + [(6, "all alike", "cc")] * 7000
    rows = hot + [(100 + i, f"words of few {i}", "dd") for i in range(40)]
    got = Counter(lang for lang, _ in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)))
    assert got == {"aa": langid.PER_LANGUAGE, "bb": langid.PER_LANGUAGE, "cc": 1, "dd": 40}


def test_svms_against_plain_descent():
    """The planes' objective is the one that plain gradient descent, one plane at a time, ends in."""
    rnd = np.random.default_rng(6)
    y = rnd.integers(0, 3, 60)
    x = np.concatenate([rnd.normal(size=(60, 5)) + np.eye(3, 5)[y] * 2, np.ones((60, 1))], 1).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    sides = np.stack([np.where(y == 0, 1, -1), (y == 1).astype(int) - (y == 2)], 1)
    w, b = langid.linear_svms(x, sides)

    def objective(plane, side):
        """|w|^2 / 2 and 10 times the mean squared miss of both sides, which weigh the same."""
        total = (plane @ plane) / 2
        for row, s in zip(x.astype(float), side):
            if s:
                total += 10 * 0.5 / (side == s).sum() * max(0, 1 - s * (plane @ row)) ** 2
        return total

    for j in range(2):
        side, plane = sides[:, j], np.zeros(6)
        for _ in range(6000):
            grad = plane.copy()
            for s in (1, -1):
                own = x[side == s].astype(float)
                grad -= 10 / len(own) * s * (np.maximum(0, 1 - s * (own @ plane)) @ own)
            plane -= 0.02 * grad
        assert objective(np.append(w[:, j], b[j]), side) == pytest.approx(objective(plane, side), rel=1e-3)


def test_language_prediction_against_plain_votes():
    """Hand-made planes: the family of the greatest margin, then one vote for each pair within it."""
    rnd = np.random.default_rng(7)
    families = [[0, 3], [1], [2, 4, 5]]
    pairs = [(0, 3), (2, 4), (2, 5), (4, 5)]
    m = langid.LanguageModel(list("abcdef"), families, pairs, rnd.normal(size=(langid.DIMS, 7)), rnd.normal(size=7) * 0.1)
    seen = set()
    for text in ["alpha beta", "gamma", "delta delta é", "one two three", "zeta!", "lorem ipsum dolor", "sit amet", "qu", "x", *map(str.__mul__, "abcdefgh", range(2, 10))]:
        counts = Counter()
        data = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text} ".encode().lower())
        for size in (2, 3, 4):
            for i in range(len(data) - size + 1):
                code = int.from_bytes(data[i : i + size], "big") + (size << 32)
                counts[(code * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        margin = [sum(c * m.weights[g, j] for g, c in counts.items()) / norm + m.bias[j] for j in range(7)]
        family = families[max(range(3), key=lambda f: margin[f])]
        votes = {k: [0, 0.0] for k in family}
        for (a, b), x in zip(pairs, margin[3:]):
            if a in family:
                votes[a if x > 0 else b][0] += 1
                votes[a][1] += math.tanh(x)
                votes[b][1] -= math.tanh(x)
        best = max(family, key=lambda k: votes[k])
        got, score = m.predict(text)
        assert got == "abcdef"[best] and 0 < score < 1
        seen.add(got)
    assert len(seen) > 2


def test_language_id_learns_every_label(spark):
    """Of many languages none is left out, and a text of each is told from the others'."""
    rows = [(f"{chr(97 + i // 26)}{chr(97 + i % 26)}", i) for i in range(250)]
    docs = [(3 * i + j, f"{w}q{w} {w}x " * 5 + f"{j}", w) for w, i in rows for j in range(3)]
    docs.append((None, "long " * 400_000, "zz"))
    m = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True), families={})
    assert len(m.languages) == 251
    with pytest.MonkeyPatch.context() as p:
        p.setattr(langid, "MAX_LANGUAGES", 5)
        with pytest.raises(ValueError):
            langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True))


def pages_fixture(spark):
    html = ["<p>a</p>", "<p>b</p>", None, "", "é" * 50, "<p>a</p>", "x" * 300_000]
    rows = [(i, [None, "", "http://x.org/a b", "http://x.org/ä\n"][i % 4], html[i % 7]) for i in range(30)] + [(None, "u", "<p>b</p>"), (None, "v", "only"), (3, "http://again", "<p>a</p>"), (5, "w", "<p>a</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), rows


def test_warc_round_trip(spark):
    pages, rows = pages_fixture(spark)
    got = warc.pages_through_archives(pages.withColumn("digest", F.lit("clash"))).collect()
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        data, top = (h or "").encode(), best.get(h or "")
        revisit = top is not None and top != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.pages_through_archives(pages.filter("page_id = -1")).count() == 0


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    pages, rows = pages_fixture(spark)
    folder = str(tmp_path / "arc")
    assert warc.write_arc(pages, folder) == len(list((tmp_path / "arc").glob("*.gz")))
    before = warc.read_arc(spark, folder).count()
    lost = next((tmp_path / "arc").glob("*.gz"))
    (tmp_path / "arc" / f"part-000000-00009-lost{''.join(lost.suffixes)}").write_bytes(lost.read_bytes())
    assert before == warc.read_arc(spark, folder).count() == len(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_parser(version):
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello\nworld", b"", b"no header"]
    data = warc.arc_version_block(version, "x.arc", "1996") + b"".join(warc.arc_record(version, f"http://h/{i} x", "1.2.3.4", "19960102030405", "text/html", b) for i, b in enumerate(blocks))
    found = list(warc.parse_arc(data))
    assert [r.block for r in found] == blocks and found[1].fields["URL"] == "http://h/1 x" and found[0].version == version
    headers, block = next(warc.parse_warc(warc.convert(found[0])))
    assert headers["WARC-Date"] == "1996-01-02T03:04:05Z" and block == blocks[0] and headers["WARC-Type"] == "response"
    assert next(warc.parse_warc(warc.convert(found[2])))[0]["WARC-Type"] == "resource"
    for torn in (data[:-4], data.replace(b"filedesc", b"other")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(torn))


def brute_top(vectors, k, step):
    """Every row whose id is divisible asks, and meets all rows but itself."""
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    top = 2**63 - 1
    out = Counter()
    for a, (q, qv) in enumerate(ok):
        if q % step:
            continue
        s = sorted((-max(-top - 1, min(top, sum(x * y for x, y in zip(qv, v)))), i) for b, (i, v) in enumerate(ok) if a != b)[:k]
        for r, (score, i) in enumerate(s):
            out[q, r + 1, i, -score] += 1
    return out


@pytest.mark.parametrize("pivots,block_rows", [(256, None), (8, 40), (3, 7)])
def test_top_k(spark, pivots, block_rows):
    rnd = np.random.default_rng(4)
    vectors = [(i, rnd.normal(size=8).tolist()) for i in range(300)]
    vectors += [(i, vectors[5][1]) for i in range(300, 340)] + [(340, None), (341, [1.0, None]), (342, [float("nan")] * 8), (343, [float("inf")] * 8), (None, [1.0] * 8), (344, []), (345, [1.0, 2.0]), (20, [0.5] * 8), (347, [0.0] * 8)]
    vectors += [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (40, vectors[40][1]), (-20, [2.0] * 8), (3, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash")).withColumn("q", F.lit(1))
    vectors = [(r[0], r[1]) for r in df.collect()]
    assert Counter(map(tuple, topk.exact_top_k(df, pivots=pivots, block_rows=block_rows).collect())) == brute_top(vectors, 20, 20)


def test_top_k_awkward_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert topk.exact_top_k(spark.createDataFrame([], kind)).count() == 0
    # Equal ids are rows of their own: three queries and candidates.
    few = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], kind)
    assert Counter(map(tuple, topk.exact_top_k(few).collect())) == Counter({(20, 1, 3, 4096): 2, (20, 2, 20, 0): 2})
    assert topk.exact_top_k(spark.createDataFrame([(0, [0.0])] * 3, kind)).count() == 6
    # Products that doubles don't hold, beyond a long as well.
    for size in (1e7, 1e12, 1e30, 1e160):
        big = spark.createDataFrame([(i, [size * (i % 5 - 2), -3.0, size / 7]) for i in range(30)], kind)
        assert Counter(map(tuple, topk.exact_top_k(big, k=3, query_step=2, pivots=4, block_rows=6).collect())) == brute_top([tuple(r) for r in big.collect()], 3, 2)


def test_top_k_stops_early():
    """Of clustered vectors of 64 dimensions few products are evaluated."""
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(60, 64)) * 20
    x = np.floor(centres[rnd.integers(0, 60, 6000)] + rnd.normal(size=(6000, 64)))
    table = topk.PivotTable(x[:2000], float(np.abs(x).max()))
    side = {"row": np.arange(6000), "ids": np.arange(6000), "x": x, "norms": table.norms_of(x), "steps": table.distances(x)}
    asks = {key: v[:80] for key, v in side.items()}
    at, ids, scores, evaluated = topk.search(table, asks, side, 10)
    assert evaluated < 0.25 * 80 * 6000
    products = (x[:80] @ x.T).astype(np.int64)
    products[np.arange(80), np.arange(80)] = -(2**62)
    want = [(-s, i) for row in products.tolist() for s, i in sorted((-s, i) for i, s in enumerate(row))[:10]]
    assert list(zip(scores.tolist(), ids.tolist())) == want


def test_top_k_skips_blocks(spark):
    """Blocks whose ranges can't reach any query's k-th score aren't met."""
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(8, 16)) * 2
    rows = [(i, (centres[i % 8] + rnd.normal(size=16) * 0.05).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.exact_top_k(df, k=5, pivots=32, block_rows=50).collect())) == brute_top(rows, 5, 20)


def brute_ctw(train, text, depth):
    """Context-tree weighting with plain recursion over dictionaries."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def steps(s):
        for at in range(len(s)):
            past = (b"\n" * depth + s[:at])[-depth:]
            for j in range(8):
                yield past, (1 << j) | (s[at] >> (8 - j)), (s[at] >> (7 - j)) & 1

    for s in train:
        for past, node, bit in steps(s):
            for d in range(depth + 1):
                counts[past[depth - d :], node][bit] += 1
                if d:
                    kids[past[depth - d + 1 :], node].add(past[depth - d :])
    half = math.log(0.5)

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    memo = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(counts[ctx, node])
            memo[ctx, node] = own if len(ctx) == depth else float(np.logaddexp(half + own, half + sum(weighted(k, node) for k in kids[ctx, node])))
        return memo[ctx, node]

    total = 0.0
    for past, node, bit in steps(text):
        p = None
        for d in range(depth, -1, -1):
            c = counts[past[depth - d :], node]
            e = (c[bit] + 0.5) / (sum(c) + 1)
            if p is None:
                p = e
            else:
                w = math.exp(half + kt(c) - weighted(past[depth - d :], node))
                p = w * e + (1 - w) * p
        total += math.log10(p)
    return total


def test_gram_codes():
    streams = b"ab cd\n\nx\n" + b"longer text here\n"
    for depth in (1, 3, 6):
        want = []
        for s in streams.split(b"\n")[:-1]:
            s = b"\n" * depth + s + b"\n"
            want += [int.from_bytes(s[i : i + depth + 1], "big") for i in range(len(s) - depth)]
        assert ctw.gram_codes(streams, depth).tolist() == want


@pytest.mark.parametrize("depth,most,keys", [(3, 8 << 20, 10**6), (3, 0, 10**6), (5, 60, 0), (5, 600, 10**6)])
def test_lm_scores(docs, rows, monkeypatch, depth, most, keys):
    monkeypatch.setattr(ctw, "SPLIT_BYTES", most)  # none, all or the heaviest endings are split, again and again
    monkeypatch.setattr(ctw, "MOST_KEYS", keys)
    monkeypatch.setattr(ctw, "MOST_CHAINS", keys)
    monkeypatch.setattr(ctw, "GROUP", 2)  # three rounds of sums
    monkeypatch.setattr(ctw, "RETURN_BYTES", 300)
    small = [r for r in rows if len(r[1] or "") < 400]
    ids = [r[0] for r in small]
    df = docs.filter(F.length(F.coalesce("text", F.lit(""))) < 400)
    got = ctw.score_documents(df, depth=depth).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    streams = [(i, ctw.stream(t)) for i, t, *_ in small]
    train = [s for i, s in streams if not held(i)]
    c = Counter(w for s in train for w in [*s.split(), b"\n"])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, s in streams:
        w = [*s.split(), b"\n"]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i].append((held(i), len(w), sum(c[x] > 0 for x in w), n, base, brute_ctw(train, s, depth)))
    assert Counter(r["doc_id"] for r in got) == Counter(ids)
    for r in got:
        found = (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert any(found[:4] == x[:4] and found[4:] == pytest.approx(x[4:], rel=1e-6) for x in want[r["doc_id"]]), r
    assert ctw.score_documents(docs.limit(0)).count() == 0


def test_long_texts(spark, tok):
    """A text of millions of bytes goes through every operator whole."""
    rnd = random.Random(14)
    long = " ".join(rnd.choice(SEED) + str(rnd.randrange(3000)) for _ in range(250_000))
    rows = [(1, long, "en", "s"), (2, long[: len(long) // 2], "en", "s"), (3, long + " and the end", "de", "t"), (4, "short one", "de", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4}
    scores = {r["doc_id"]: r for r in ctw.score_documents(df, depth=2).collect()}
    assert {i: r["n_tokens"] for i, r in scores.items()} == {i: len(t.split()) + 1 for i, t, *_ in rows}
    assert {i: r["n_bytes"] for i, r in scores.items()} == {i: len(t) + 1 for i, t, *_ in rows}
    prints = {r["doc_id"]: r for r in fingerprint.compare_with_next(df).collect()}
    assert {i: r["n_chars"] for i, r in prints.items()} == {i: len(t) for i, t, *_ in rows} and prints[1]["near_next"] > prints[3]["near_next"]
    pieces = packing.pack_documents(df.filter("doc_id > 2")).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    assert {tuple(r) for r in pieces} == {(i, n, n) for i, t, *_ in rows[2:] if (n := len(ids_of(tok, t)) + 1)}


def test_lm_predicts_held_out(spark, sf):
    got = ctw.score_documents(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).filter("held_out")
    r = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_bytes")).first()
    assert r[0] > r[1] and -r[0] / math.log10(2) / r[2] < 3


def test_line_dedup(spark):
    rows = [(i, f"own {i}\nmenu\n\nmore {i}" + ("\nrare" if i < 5 else ""), "a") for i in range(30)]
    rows += [(100 + i, "menu\nmenu\n" if i % 2 else f"x {i}\nmenu", None) for i in range(24)] + [(200, None, "a"), (201, "", "a"), (202, "menu", "a"), (203, "menu\nsmall host", "b")]
    df = spark.createDataFrame([(*r, 5, "h") for r in rows], "doc_id long, text string, source string, n_lines int, _drop string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df, F.col("source")).collect()}
    assert len(got) == len(rows)
    for i, t, s in rows:
        want = t
        if s in ("a", None) and t:
            rest = [x for x in t.split("\n") if x != "menu"]
            want = "\n".join(rest) if any(x.strip() for x in rest) else t
        assert got[i]["text"] == want
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (len(t.split("\n")) if t is not None else 0, t.count("menu") if want != t else 0)
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("source")).count() == 0


def test_line_dedup_limits_off(spark):
    """Without the limits the ratio alone decides, on hosts of any size and for whole pages."""
    rows = [(i, f"own {i}\nfooter", "a") for i in range(3)] + [(3, "footer", "a"), (4, "footer\n\nfooter", "a"), (5, "alone", "b"), (6, "long " * 300_000 + "\nfooter", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = Counter()
    for host in "ab":
        own = [(i, t.split("\n")) for i, t, s in rows if s == host]
        on = Counter(x for _, ls in own for x in set(ls) if x.strip())
        for i, ls in own:
            rest = [x for x in ls if not x.strip() or on[x] <= 0.5 * len(own)]
            plain[i, "\n".join(rest), len(ls), len(ls) - len(rest)] += 1
    got = line_dedup.drop_boilerplate(df, F.col("source"), ratio=0.5, min_pages=1, keep_whole=False)
    assert Counter(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect())) == plain


def plain_entropy(w):
    return round(1000 / 6 * (6 - sum(c * math.log2(c) for c in Counter(w).values()) / 64), 2)


def test_fingerprint_selection():
    rnd = random.Random(8)
    texts = [bytes(rnd.choice(b"abcdefghij  \n") for _ in range(n)) for n in (0, 10, 63, 64, 100, 127, 128, 900)] + [b"a" * 300]
    starts = fingerprint.feature_starts(texts)
    for t, got in zip(texts, starts):
        windows = [t[i : i + 64] for i in range(len(t) - 63)]
        if not windows:
            assert not len(got)
            continue
        e = fingerprint.entropies(np.frombuffer(t, np.uint8))
        assert np.allclose(e, [plain_entropy(w) for w in windows], atol=0.51)
        r = fingerprint.ranks(e).tolist()
        runs = max(1, len(r) - 63)
        points = Counter(min(range(i, min(i + 64, len(r))), key=lambda j: (r[j], j)) for i in range(runs))
        assert got.tolist() == sorted(i for i, n in points.items() if n >= min(16, runs) and r[i] <= 1000)


def plain_filters(text, starts):
    """Chained filters as sets of bits: five 11-bit numbers of each distinct feature's SHA-1, 160 features a filter."""
    features = list(dict.fromkeys(text[s : s + 64] for s in starts)) or ([text] if text else [])
    chain = []
    for i, f in enumerate(features):
        if i % 160 == 0:
            chain.append(set())
        h = hashlib.sha1(f).digest()
        chain[-1] |= {int.from_bytes(h[4 * j : 4 * j + 4], "big") % 2048 for j in range(5)}
    return chain


def plain_likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    best = []
    for x in a:
        each = []
        for y in b:
            chance, most = len(x) * len(y) / 2048, min(len(x), len(y))
            most = max(len(x), len(y)) if most < 64 else most
            cut = chance + 0.3 * (most - chance)
            each.append(min(1, max(0, (len(x & y) - cut) / max(1e-9, most - cut))))
        best.append(max(each))
    return sum(best) / len(best)


def test_fingerprint_filters_and_likeness():
    rnd = random.Random(11)
    words = [rnd.choice(SEED) + str(rnd.randrange(400)) for _ in range(9000)]
    whole = " ".join(words)
    texts = ["", "short", whole, whole[:30_000], whole[20_000:], " ".join(words[::2]), "z" * 500, whole[:400] + "!" + whole[401:700]]
    own = [t.encode() for t in texts]
    starts = [s.tolist() for s in fingerprint.feature_starts(own)]
    plain = [plain_filters(t, s) for t, s in zip(own, starts)]
    prints = fingerprint.fingerprints(own)
    assert max(map(len, plain)) > 3
    for f, chain in zip(prints, plain):
        assert [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in f] == chain
        bits = bytes(sum(1 << (7 - k) for k in range(8) if 8 * i + k in x) for x in chain for i in range(256))
        assert fingerprint.digest(f) == f"{len(chain)}:{base64.b64encode(bits).decode()}"
    for f, x in zip(prints, plain):
        for g, y in zip(prints, plain):
            assert fingerprint.likeness(f, g) == pytest.approx(plain_likeness(x, y), abs=2e-6)


def test_fingerprints_with_next(docs, rows, none):
    got = fingerprint.compare_with_next(docs, rows_per_bucket=9).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        t, x = a[1] or "", b[1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + x[:h]
        f, g, y = fingerprint.fingerprints([t.encode(), e.encode(), x.encode()])
        want[a[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.digest(f), fingerprint.digest(g), fingerprint.likeness(f, g), fingerprint.likeness(f, y)] += 1
    assert Counter(map(tuple, got)) == want
    assert fingerprint.compare_with_next(none).count() == 0
    alone = [r for r in fingerprint.compare_with_next(docs.filter("doc_id = 7")).collect()]
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_empty_tables(none):
    assert bpe.encode_decode_digests(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
