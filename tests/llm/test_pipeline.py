import duckdb
import pytest

import corpus_pipeline
from lexiforge.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_lines", corpus_pipeline.F.lit(1))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert 0.5 * n < docs.count() < n
    assert docs.select("text").distinct().count() == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_language_id_unlabelled(spark):
    """Without a label to learn from, texts with a letter stay."""
    texts = ["some words", "é", "12 ?", "", None]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, None)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1]


def test_near_dedup_repeated_and_null_ids(spark):
    """One row of each group stays, and no row goes for another that shares its id."""
    text = lambda name, n=100: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("a")), (None, text("b")), (None, text("b")), (None, text("b", 104))]
    rows += [(1, text("c")), (7, text("c", 104)), (7, text("d")), (None, text("c", 103)), (8, ""), (8, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, None).select("doc_id", "text", "source").collect()]
    alone = [(i, t, f"s{k}") for k, (i, t) in enumerate(rows) if k in (0, 5, 7, 9, 10, 11, 12)]
    b = [r for r in got if r[1] and r[1].startswith("b0 ")]
    assert len(b) == 1 and b[0][0] is None
    assert sorted(map(repr, got)) == sorted(map(repr, alone + b))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def brute_pipeline(rows):
    """The rows that the first three stages leave, by plain Python: (doc_id, text, source, n_chars)."""
    import itertools
    import unicodedata
    from collections import Counter

    kept = [list(r) for r in rows if r[1] and any(unicodedata.category(c)[0] == "L" for c in r[1])]
    blank = lambda x: not x.strip(" \t\r\f\v")
    for _, own in itertools.groupby(sorted(kept, key=lambda r: r[3] or ""), key=lambda r: r[3] or ""):
        own = list(own)
        on = Counter(x for r in own for x in {y for y in r[1].split("\n") if not blank(y)})
        drop = {x for x, n in on.items() if n >= 10 and n > 0.1 * len(own)}
        for r in own:
            lines = r[1].split("\n")
            rest = [x for x in lines if x not in drop]
            if len(rest) < len(lines) and not all(map(blank, rest)):
                r[1] = "\n".join(rest)
                r[4] = len(r[1])
    shingles = []
    for r in kept:
        w = r[1].encode().lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for g in set(group):
        own = [r for r, x in zip(kept, group) if x == g]
        least = min((r[0] is None, r[0] or 0) for r in own)
        out.append([r for r in own if (r[0] is None, r[0] or 0) == least])
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's effect, and every id packed once."""
    import random
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from lexiforge.llm.common import tokenizer_path

    rnd = random.Random(15)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "am", "et", "con") for b in ("em", "um", "or", "a", "it")]
    rows = []
    for i in range(160):
        text = "\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(6))
        if i % 2:
            text = "menu home about\n" + text + "\nall rights reserved"
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", None][i % 4 % 3], len(text)))
    for i in range(40):
        base = rows[i][1].split(" ")
        if i % 3:
            base[rnd.randrange(len(base))] = f"edit{i}"
        rows.append((200 + i, " ".join(base), "en", "a", len(" ".join(base))))
    long = " ".join(rnd.choices(words, k=200_000))
    rows += [(500, long, "en", "c", len(long)), (501, long + " more", "en", "c", len(long) + 5), (600, None, "en", "a", None), (601, "", None, None, 0), (602, "12 34", "en", "a", 5), (None, "no id " + rows[2][1], "de", "z", 9), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs.withColumn("n_lines", corpus_pipeline.F.lit("clash")).withColumn("first", corpus_pipeline.F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("language_id", "line_dedup", "near_dedup"):
        kept = stages[name](spark, kept, str(tmp_path))
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()}
    want = brute_pipeline(rows)
    assert kept.count() == len(want) == len(got)
    for own in want:
        assert len(got & {(r[0], r[1], r[4]) for r in own}) == 1
    tok = Tokenizer.from_file(tokenizer_path())
    pieces: dict = {}
    windows: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == {i for i, *_ in got}
    for i, text, _ in got:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
