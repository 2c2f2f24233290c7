import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_duplicates import earlier, near
from tokenizers import Tokenizer

import corpus_pipeline
from tidewheel.llm import queries, toxicity
from tidewheel.llm.common import alnum_words

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    sql = c.sql(queries.ORACLE[name])
    at = [sql.columns.index(k) for k in columns]
    assert sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE])
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def own(k, n=90):
    return " ".join(f"d{k}w{i}" for i in range(n))


@pytest.fixture
def planted(spark):
    """Documents of the smallest tables, and some more whose fate is known."""
    passage = " ".join(f"pass{i}" for i in range(70))
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    insults = " idiot scum moron loser stupid trash clown"
    texts = [own(0), own(1) + insults, own(2), own(2) + " extra", own(4) + " " + passage, own(5) + " " + passage, own(6, 20) + " " + bench, None, own(8, 3000) + " " + " ".join(bench.split()[:14])]
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    more = spark.createDataFrame([(10**6 + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], documents.schema)
    return documents.union(more)


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def stage(name, spark, docs, folder=SMALL):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.columns == docs.columns
    return rows_of(out)


def test_toxicity_stage(spark, planted):
    """What stays is what the plain sum over pairs scores below a half, with the machine that the same rows fit."""
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select(COLUMNS).union(planted.where(f"doc_id >= {10**6}"))
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    got = stage("toxicity", spark, docs, MORE)
    machine = toxicity.fit(docs, labels)
    hashes, some = toxicity.WordHashes(), {i: t for i, t in rows_of(docs).items() if i >= 10**6 or i % 10 == 0}
    for i, text in some.items():
        at = [k for k in toxicity.features([(text or "").encode()], hashes)[0] if machine.weights[k] or machine.vectors[k].any()]
        raw = machine.bias + sum(float(machine.weights[k]) for k in at) + sum(float(machine.vectors[a] @ machine.vectors[b]) for n, a in enumerate(at) for b in at[:n])
        assert (i in got) == (raw < 0), (i, raw)
    assert {i for i in some if i >= 10**6 and i not in got} == {10**6 + 1}
    held = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([i in got for i, toxic in held.items() if not toxic]) > 0.99


def test_near_duplicates_stage(spark, planted):
    texts = rows_of(planted)
    want = {i for i, _, _, kept in near(list(texts.items()), 5) if kept}
    got = stage("near_duplicates", spark, planted)
    assert got == {i: texts[i] for i in want} and {i for i in texts if i >= 10**6} - want == {10**6 + 3}


def test_repeated_passages_stage(spark, planted):
    texts, want = rows_of(planted), {}
    hits = earlier(list(texts.items()), 50)
    for i, text in texts.items():
        places = [m.start() for m in WORD.finditer(text or "")] + [len(text or "")]
        gone = hits.get(i, {})
        if not gone:
            want[i] = text
        elif len(gone) < len(places) - 1:
            pieces = [text[: places[0]]] + [text[a:b] for k, (a, b) in enumerate(zip(places, places[1:], strict=False)) if k not in gone]
            want[i] = "".join(pieces).strip()
    got = stage("repeated_passages", spark, planted)
    assert got == want and got[10**6 + 5] == own(5) and 10**6 + 4 in got


def test_decontamination_stage(spark, planted):
    items = [alnum_words(r.text.encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(len(w) - min(13, len(w)) + 1) if w}
    want = {}
    for i, text in rows_of(planted).items():
        w = alnum_words((text or "").encode())
        hit = {k for n in {len(x) for x in windows} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for k in range(a, a + n)}
        if len(hit) < 13 and not (hit and 20 * len(hit) >= len(w)):
            want[i] = text
    got = stage("decontamination", spark, planted)
    assert got == want and {i for i in range(10**6, 10**6 + 9) if i not in got} == {10**6 + 6, 10**6 + 8}


def test_packing_stage(spark, planted):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = {}
    for r in dict(corpus_pipeline.STAGES)["packing"](spark, planted, SMALL).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, r.ids_crc32))
    for i, text in rows_of(planted).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for start, length, total, crc in sorted(pieces[i]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_and_no_rows(spark, docs, odd, name):
    """Nulls, empty, very long and repeated texts, and columns named like the stages' own: all are clean, so all ids stay."""
    df = docs(odd)
    out = dict(corpus_pipeline.STAGES)[name](spark, df, SMALL)
    assert out.columns == df.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in odd} and {(r.n_words, r.row, r.key) for r in rows} == {("x", None, 7)}
    assert dict(corpus_pipeline.STAGES)[name](spark, df.where("false"), SMALL).count() == 0


def test_run(spark, tmp_path):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").where("false").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
