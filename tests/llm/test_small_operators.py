import hashlib
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import decontamination, licenses, packing, sharding, tokenfile
from tidewheel.llm.common import alnum_words
from tidewheel.llm.encoding import ChunkEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


# sharding


def filled(names, size):
    """The table by turns over whole preference lists."""
    import xxhash

    orders = [[(xxhash.xxh64_intdigest(n, seed=1) + i * (xxhash.xxh64_intdigest(n, seed=2) % (size - 1) + 1)) % size for i in range(size)] for n in names]
    table, at = [None] * size, [0] * len(names)
    while None in table:
        for s, order in enumerate(orders):
            while at[s] < size and table[order[at[s]]] is not None:
                at[s] += 1
            if at[s] < size:
                table[order[at[s]]] = s
    return table


def test_table_is_that_of_the_turns_even_and_stable():
    names = [f"n{i}" for i in range(7)]
    assert sharding.lookup_table(names, 251).tolist() == filled(names, 251)
    big = sharding.lookup_table(names, 65_537)
    counts = Counter(big.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 65_537)
    moved = ((big != fewer) & (big != 6)).mean()
    assert moved < 0.1
    weighted = Counter(sharding.lookup_table(names, 65_537, [2, 1, 1, 1, 1, 1, 0]).tolist())
    assert 1.9 < weighted[0] / weighted[1] < 2.1 and 6 not in weighted
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_assign_odd_rows(spark, docs, odd):
    df = docs(odd).withColumn("shard", F.lit("old"))
    got = sharding.assign(df, ["doc_id"], ["a", "b"]).collect()
    assert len(got) == len(odd) and {r.shard for r in got} <= {0, 1}
    table = sharding.lookup_table(["a", "b"])
    assert all(table[r.slot] == r.shard for r in got)
    assert sharding.assign(docs([]), ["doc_id"]).count() == 0


def test_write_shards(spark, docs, tmp_path):
    df = docs([(i, str(i)) for i in range(200)])
    sharding.write_shards(df, str(tmp_path / "out"), ["doc_id"], ["a", "b", "c"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 3


# decontamination


def contaminated(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = alnum_words((text or "").encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words((text or "").encode()), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination_matches_brute_force(spark, docs, odd, block):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, "short One"), (2, long), (3, "short one, W0 w1"), (4, None), (5, "..."), (2, "another a a a"), (9, "é漢字"), (10, " ".join(["w5"] * 14))]
    rows = [*odd, (20, "say short-one W0 W1! and"), (21, "x " * 300 + long), (22, "W3 w4 w5 " + " ".join(f"W{i}," for i in range(10, 30))), (23, "w5 " * 20), (24, "a another a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(docs(rows), bench, block_bytes=block).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == contaminated(rows, items)


def test_spans_are_offsets_of_the_original(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    text = "É, Alpha -- BETA. x"
    r = decontamination.contamination(docs([(1, text)]), bench, carry=["doc_id", "text", "n_words"]).first()
    assert [text[s.first : s.last] for s in r.spans] == ["Alpha -- BETA"] and r.row.n_words == "x"
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs([(1, text)]), empty).first().contaminated is False
    assert decontamination.contamination(docs([]), bench).count() == 0


# encoding, token files


PIECES = ["foo", "Bar", " ", " ", "\n", "\n\n", "'s", "é", "é", "12", ".", "...", " a", "<|endoftext|>", "\t", " ", "x'll", "ABC", "!?", "ß", "漢字", "'", "\r", "\0", "İ", "Σς"]


@pytest.fixture(scope="module")
def encoders():
    return [(ChunkEncoder(path, spaced, slots=128, most=60, most_ids=200), Tokenizer.from_file(path)) for path, spaced in ((BYTE, True), (WORD, False))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(codec="utf-8")), max_size=12).map("".join))
def test_chunks_give_the_ids_of_the_whole_text(encoders, text):
    for encoder, tokenizer in encoders:
        assert [x.tolist() for x in encoder.encode([text, text[1:]])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, text[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.sampled_from([0.5, 0.9, 1.0]))
def test_segments_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    half = len(ids) // 2
    s = tokenfile.Segment(tokenfile.pack(ids, [None, -5], [half, len(ids) - half], percentile))
    assert (s.decode() == ids).all() and s.doc_ids == [None, -5] and s.lengths.tolist() == [half, len(ids) - half]
    for b in range(s.blocks):
        assert (s.decode(b, b + 1) == ids[128 * b : 128 * (b + 1)]).all()


def test_token_files(spark, docs, odd, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(docs(odd), path, BYTE, segment_ids=500)
    tokenizer = Tokenizer.from_file(BYTE)
    want, start = [], 0
    for doc, text in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in tokenfile.read_tokens(spark, path).collect()), key=repr) == sorted(want, key=repr)
    assert tokenfile.read_tokens(spark, path, digest=False).where("doc_id = 7").first().ids[-1] == 2
    tokenfile.write_tokens(docs([]), path, BYTE)
    assert tokenfile.read_tokens(spark, path).count() == 0


# packing


def test_packing_keeps_every_id_once(spark, docs, odd):
    rows = [*odd, *[(100 + i, f"some words number {i} " * (i % 50)) for i in range(120)]]
    tokenizer = Tokenizer.from_file(WORD)
    want = Counter((doc, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])) for doc, text in rows)
    pieces = packing.pack(docs(rows), WORD, with_ids=True).collect()
    sequences = {}
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
    got = Counter()
    order = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    ids = []
    for p in order:  # documents follow one another along the sequences
        assert p.start == len(ids)
        ids += p.ids
        if len(ids) == p.doc_tokens:
            got[p.doc_id, tuple(ids)] += 1
            ids = []
    assert not ids and got == want
    assert packing.pack(docs([]), WORD).count() == 0


def test_hilbert_keys_visit_neighbours():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    walk = grid[np.argsort(packing.hilbert_keys(grid, 4))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    assert len(set(packing.hilbert_keys(np.array([(a, b, c, d) for a in range(4) for b in range(4) for c in range(4) for d in range(4)]), 2).tolist())) == 256


# licenses


def test_license_scan(spark, docs, odd):
    mit = licenses.TEMPLATES[3][1]
    rows = [*odd, (20, "Released under the MIT License.\nApache  License; gnu GENERAL public-license cc-by"), (21, mit.replace("copy of", "copy\nof")), (22, " ".join(mit.split()[: len(mit.split()) // 3])), (23, "mit license mit license"), (24, "mitlicense mit licenses")]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    assert len(licenses.scan(docs(rows)).collect()) == len(rows)
    r = got[20]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (13, 4, 3, 11, "apache,cc-by,gpl,mit") and "mit-notice" in r.labels and r.score == 1.0
    assert (got[21].n_base, got[21].labels, got[21].first_word) == (0, "mit-notice", None) and got[21].score == 1.0
    assert got[22].labels == "" and got[22].score == 0.0
    assert (got[23].n_base, got[23].first_word, got[23].last_word) == (2, 0, 2)
    assert got[24].n_base == 0
    assert (got[1].n_words, got[1].labels, got[1].score) == (0, "", 0.0) and got[4].n_words == 30_000
    assert licenses.scan(docs([])).count() == 0
    assert licenses.scan(docs(rows[:3]), templates=[("t", "one two")]).count() == 3


def test_license_join_is_exact(spark, docs):
    """Blocks of every size class against plain sets; some templates have words that a match must have."""
    rng = np.random.default_rng(1)
    words = [f"t{i}" for i in range(60)]
    templates = []
    for i in range(14):
        own = list(rng.choice(words, rng.integers(3, 15) if i < 10 else rng.integers(20, 40), replace=False))
        templates.append((f"l{i}", " ".join(own), own[0]) if i % 2 else (f"l{i}", " ".join(own)))
    rows = [(i, " # ".join(rng.choice(words + ["z"] * 40, rng.integers(1, 300)))) for i in range(120)]
    got = {r.doc_id: r.labels for r in licenses.scan(docs(rows), templates=templates, threshold=0.7).collect()}
    seen = set()
    for i, text in rows:
        w, want = text.split(" # "), set()
        for label, t, *must in templates:
            span = max(16, 1 << (len(t.split()) - 1).bit_length())
            for at in range(0, len(w), span):
                block = set(w[at : at + 2 * span])
                if len(block & set(t.split())) >= 0.7 * len(set(t.split())) - 1e-9 and set(must) <= block:
                    want.add(label)
        assert got[i] == ",".join(sorted(want))
        seen |= want
    assert len(seen) > 8


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "      "])
def test_wrapped_notices_are_found(docs, mark):
    """However a notice is broken into lines, and whatever they begin with."""
    before, after = "some words of a file that come first " * 9, " and then others follow" * 9
    rows = []
    for i, (_, text, *_) in enumerate(licenses.TEMPLATES):
        lines = textwrap.wrap(before + text + after, 72)
        rows.append((i, "\n".join(mark + line for line in lines)))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs(rows)).collect()}
    assert all(label in got[i] for i, (label, *_) in enumerate(licenses.TEMPLATES))


def test_licenses_that_differ_in_a_word_are_told_apart(docs):
    scattered = "released " + "word " * 40 + "under " + "word " * 40 + "the mit " + "word " * 40 + "license"
    rows = [(1, "Licensed under CC BY 4.0"), (2, "Licensed under CC BY-SA 4.0"), (3, "This work is licensed under the GNU General Public License, version 2"), (4, scattered), (5, "Released under the Apache License"), (6, "Licensed under CC BY-NC 4.0")]
    got = {r.doc_id: r.labels for r in licenses.scan(docs(rows)).collect()}
    assert got == {1: "cc-by", 2: "cc-by", 3: "gpl", 4: "", 5: "apache", 6: "cc-by,cc-by-nc-4.0"}
