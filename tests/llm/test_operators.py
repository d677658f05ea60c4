"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and odd columns."""

import dataclasses
import hashlib
import math
import random
import struct
import time
import zlib
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import chat, components, embed_dedup, mixing, ngram_join, packing, pii, quality, sharding, storage, textscan, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(rng, n_groups, copies, length):
    out = []
    for _ in range(n_groups):
        base = words(rng, rng.randrange(5, length))
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


ODD = [None, "", "   \n\t ", "one", "one", "One two", "a b c", "A b C", " ", "é " * 70, "x" * 5000, "same line\n" * 60, "\x1c a\x1fb \x85 c", "1" * 3000, "##" * 30 + " word"]


def odd_docs(spark, texts, extra=False):
    rows = [(i * 3 % 101 + 1000 * (i // 101), t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1]]  # repeated rows
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return (df.withColumn("c", F.lit(1)).withColumn("a", F.lit("x")).withColumn("component_id", F.lit(5)).withColumn("_ID", F.lit(6)).withColumn("_h", F.lit("h")).withColumn("_spans", F.lit(7)).withColumn("_rows", F.lit(8)), rows) if extra else (df, rows)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [*ODD, *near_copies(rng, 40, 7, 260)]


def test_ngram_components(spark, texts):
    df, rows = odd_docs(spark, texts, extra=True)
    for n, t in ((3, "0.9"), (5, "0.8")):
        got = sorted((tuple(r) for r in ngram_join.components(df, n, t).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
        assert got == brute.ngram_components([(r[0], r[1]) for r in rows], n, int(100 * Fraction(t)))
    assert ngram_join.components(empty(spark)).count() == 0


def test_large_cluster_is_dealt_to_cells(spark, monkeypatch):
    rng = random.Random(8)
    base = words(rng, 120, 10**6)
    texts = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{k}_{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "CELL", 12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.components(df, 3, "0.9").select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute.ngram_components(list(enumerate(texts)), 3, 90)


def thue_morse(n, flip=0):
    """Words of two letters that sums of powers modulo 2**64 can't tell apart, whatever the base."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


def test_hashes_have_no_algebra(spark):
    for n in (64, 200, 250, 1024, 4096):
        text = f"{thue_morse(n)} {thue_morse(n, 1)} {thue_morse(n)}".encode()
        buf = np.frombuffer(text, np.uint8)
        a, b, c = textscan.span_hash(buf, *textscan.words(buf, np.array([0, len(text)]))[:2])
        assert a == c != b
    rows = [(k, thue_morse(1024, k) + "\n" + thue_morse(1024, 1 - k)) for k in (0, 1)] + [(k, thue_morse(1024, k)) for k in (2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.components(df, 3, "0.9").collect()} == {k: k for k in range(4)}
    assert {r.n_dup_lines for r in quality.quality(df).collect()} == {0}


def test_classes_whose_digests_begin_alike(spark, texts):
    df, rows = odd_docs(spark, texts)
    got = sorted((tuple(r) for r in ngram_join.components(df, 3, "0.9", bits=3).collect()), key=repr)
    assert got == brute.ngram_components([(r[0], r[1]) for r in rows], 3, 90)


def test_signatures_of_many_classes(spark, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_RUN", 2)
    monkeypatch.setattr(ngram_join, "CELL", 3)
    df, rows = odd_docs(spark, texts)
    got = sorted((tuple(r) for r in ngram_join.components(df, 5, "0.8").collect()), key=repr)
    assert got == brute.ngram_components([(r[0], r[1]) for r in rows], 5, 80)


def test_keep_one(spark, texts):
    df, rows = odd_docs(spark, texts, extra=True)
    kept = ngram_join.keep_one(df, 5, "0.8")
    assert kept.columns == df.columns
    found = brute.ngram_components([(r[0], r[1]) for r in rows], 5, 80)
    groups = {c for _, n, c in found if n}
    blank = sum(n == 0 for _, n, _ in found)
    assert kept.count() == len(groups) + blank
    assert ngram_join.keep_one(empty(spark)).count() == 0


def test_keep_one_of_rows_without_an_id_of_their_own(spark):
    rng = random.Random(8)
    base = [words(rng, 60, 10**6) for _ in range(6)]
    text = [" ".join(w) for w in base]
    near = [" ".join([*w[:-1], "other"]) for w in base]
    rows = [(None, text[0]), (None, text[1]), (None, near[1]), (None, text[2]), (None, text[2]), (None, " "), (None, None)]
    rows += [(7, text[3]), (7, text[4]), (7, text[4]), (7, near[4]), (None, near[3]), (9, text[5]), (8, near[5]), (None, text[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(df, 5, "0.8").collect()]
    # of each component one row, of the smallest id; empty texts all stay
    assert sorted(i or 0 for i, t in kept if t and t.strip()) == [0, 0, 0, 7, 7, 8]
    found = [k for _, t in kept for k in range(6) if t in (text[k], near[k])]
    assert sorted(found) == list(range(6)) and len(kept) == 8 and set(kept) <= set(rows)


def test_signatures_meet_and_tree_finds():
    rng = np.random.default_rng(2)
    for t in (Fraction("0.9"), Fraction("0.8")):
        for _ in range(500):
            a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 700)), dtype=np.uint64))
            k = int(rng.integers(0, len(a) // 8 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[k:], rng.integers(0, 2**64, int(rng.integers(0, k + 1)), dtype=np.uint64))))
            if len(b) and ngram_join.linked(a, b, t):
                assert len(np.intersect1d(ngram_join.signatures(a, t), ngram_join.signatures(b, t)))
                v, n = np.array([ngram_join.count_vector(b)] * 40), np.array([len(b)] * 40)
                assert len(ngram_join.CountVectorTree(v, n).search(ngram_join.count_vector(a), len(a), t)) == 40


def test_small_sets_share_no_signature_by_empty_groups():
    rng = np.random.default_rng(4)
    for t in (Fraction("0.9"), Fraction("0.8")):
        shared = Counter()
        for _ in range(400):
            shared.update(set(ngram_join.signatures(np.sort(rng.integers(0, 2**64, int(rng.integers(60, 240)), dtype=np.uint64)), t).tolist()))
        assert max(shared.values()) < 8


def test_empty_groups_still_lead_to_partners():
    """Sets that crowd into few groups, where a difference may lie in each that isn't empty."""
    rng = np.random.default_rng(6)
    for t in (Fraction("0.9"), Fraction("0.8")):
        for _ in range(300):
            n = int(rng.integers(20, 230))
            groups = rng.integers(0, 64, int(rng.integers(1, 12)), dtype=np.uint64) << np.uint64(58)
            a = np.unique(rng.choice(groups, n) + rng.integers(0, 2**58, n, dtype=np.uint64))
            k = n // 20 if t > Fraction("0.85") else n // 9
            b = np.unique(np.concatenate((rng.permutation(a)[k:], rng.choice(groups, k) + rng.integers(0, 2**58, k, dtype=np.uint64))))
            if ngram_join.linked(a, b, t):
                assert len(np.intersect1d(ngram_join.signatures(a, t), ngram_join.signatures(b, t)))


def test_large_cluster_of_texts_that_share_a_passage_is_cut(spark, monkeypatch):
    rng = random.Random(9)
    passage = " ".join(words(rng, 280, 10**6))
    texts = [passage + " " + " ".join(words(rng, 60, 10**6)) for _ in range(60)]  # similar by 0.7
    texts += [texts[7] + " end", texts[8] + " end"]
    dealt = []
    across = ngram_join._across
    monkeypatch.setattr(ngram_join, "CELL", 12)
    monkeypatch.setattr(ngram_join, "_across", lambda large, *more: dealt.append(large.count()) or across(large, *more))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.components(df, 5, "0.8").collect()), key=repr)
    assert got == brute.ngram_components(list(enumerate(texts)), 5, 80)
    assert not dealt
    # where signatures are too many for a look, the cluster stays and its cells are compared
    monkeypatch.setattr(ngram_join, "FINE_RUN", 2)
    assert got == sorted((tuple(r) for r in ngram_join.components(df, 5, "0.8").collect()), key=repr)
    assert dealt


def test_tables_leave_no_shuffle_files(spark):
    def files():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(disk.getAllFiles().apply(k).getName().startswith("shuffle_") for k in range(disk.getAllFiles().size()))

    before, setting = files(), spark.conf.get(storage.CLEANUP)
    table = storage.materialize(spark.range(1000).groupBy(F.col("id") % 7).count(), "cleaned")
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and table.count() == 7 and spark.conf.get(storage.CLEANUP) == setting


def test_keep_one_leaves_only_what_it_reads(spark, texts, monkeypatch):
    df, _ = odd_docs(spark, texts)
    made = []
    real = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda *x: made.append(real(*x)) or made[-1])
    kept = ngram_join.keep_one(df, 5, "0.8")
    place = spark._jvm.org.apache.hadoop.fs.Path
    there = [x for x in made if place(x.table_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(place(x.table_path))]
    assert len(made) > 3 and there == made[-1:] and kept.count() > 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 120)
    edges = [(ids[i], ids[i + 1]) for i in range(60) if i != 30] + [(ids[61], x) for x in ids[62:]] + [(ids[5], ids[5])]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (ids[:31], ids[31:61], ids[61:]):
        assert {got[x] for x in part} == {min(part)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, texts):
    df, rows = odd_docs(spark, texts + ["ok fine words here " * 3 + " ".join(f"u{i}" for i in range(80)), "a | b % c " * 40], extra=True)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((r.doc_id, *(getattr(r, x) for x in names)) for r in quality.quality(df).collect())
    assert got == sorted((r[0], *brute.quality_base(r[1])) for r in rows)
    kept = {(r.doc_id, r.kept) for r in quality.quality(df).collect()}
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == sorted(r[0] for r in rows if (r[0], True) in kept)
    assert quality.quality(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_encoder_equals_tokenizer():
    e, plain = tokens.ChunkEncoder(tokens.default_tokenizer(), keep=60), Tokenizer.from_file(tokens.default_tokenizer())
    assert plain.encode("x<|endoftext|>y", add_special_tokens=False).ids == [343, 49407, 344]
    rng = random.Random(3)
    pieces = ["Hello", "don't", "ÉTÉ", "İx", "ΟΔΟΣ", "a.b,c", "...", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>Y", "<|", "日本語", "12,5", "\x1c", "\x85", " ", "\n\n", "\t", "ſ", "ß", ".", "x.", "ŉ", "😀!"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(0, 30)))
        assert list(struct.unpack(f"<{len(e.encode(text)) // 4}I", e.encode(text))) == plain.encode(text, add_special_tokens=False).ids, text
        assert list(e.encode_all([text, None, text], 5)) == [e.encode(text), b"", e.encode(text)]


def test_token_tree_follows_edits():
    e = tokens.ChunkEncoder(tokens.default_tokenizer())
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join(rng.choice(["Ab", "don't", "x.y", "été", "12"]) for _ in range(rng.randrange(0, 200)))
        tree = tokens.TokenTree(text, e, leaf_chunks=4)
        for _ in range(12):
            a = rng.randrange(0, len(text) + 1)
            b = min(len(text), a + rng.choice([0, 1, 5, 60, 10**6]))
            new = rng.choice(["", " ", "zz", " q ", "long new words " * rng.randrange(1, 40), "'s"])
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text == text and tree.length == len(text)
            assert tree.count == len(e.encode(text)) // 4
    tree = tokens.TokenTree("word " * 5000, e)
    spent = tree.encoded_chars
    tree.replace(12_000, 12_001, "Q")
    assert tree.encoded_chars - spent < 50
    with pytest.raises(ValueError):
        tree.replace(0, 10**7, "")
    with pytest.raises(ValueError):
        tree.apply([(0, 5, ""), (3, 6, "")])


def test_token_counts_query(spark, texts):
    df, rows = odd_docs(spark, [*texts, "write to me.x@y.org or a@b.co now"], extra=True)
    e = tokens.ChunkEncoder(tokens.default_tokenizer())
    want = []
    for r in rows:
        text = r[1] or ""
        edited = tokens.EMAIL.sub("[email]", text) + "\n-- end of document --"
        want.append((r[0], len(e.encode(text)) // 4, len(e.encode(edited)) // 4))
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in tokens.count_after_edits(df, tokens.redact_and_sign).collect()) == sorted(want)
    assert tokens.count_after_edits(empty(spark), tokens.redact_and_sign).count() == 0


def test_best_fill_is_the_closest():
    rng = random.Random(6)
    for _ in range(200):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))]
        reach = {max(lengths)}
        left = sorted(lengths)[:-1]
        for x in left:
            reach |= {r + x for r in reach if r + x <= 100}
        picked = packing.best_fill(Counter(lengths), 100)
        assert sum(picked) == max(reach) and not Counter(picked) - Counter(lengths)


def test_packing(spark, texts):
    df, rows = odd_docs(spark, [*texts, "many words " * 9000], extra=True)
    e = tokens.ChunkEncoder(tokens.default_tokenizer())
    got = packing.pack(df, with_ids=True, capacity=512, window=16).collect()
    filled = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id] and r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
        filled[r.sequence_id] += r.length
    assert all(n <= 512 and (n == 512 or n & (n - 1) == 0) for n in filled.values())
    want = Counter()
    for r in rows:
        ids = e.encode(r[1]) + (2).to_bytes(4, "little")
        want[r[0]] += len(ids) // 4
        pieces = [x for x in got if x.doc_id == r[0]]
        one = {x.start: x.ids for x in pieces}
        if len({x.start for x in pieces}) == len(pieces):
            assert b"".join(one[k] for k in sorted(one)) == ids and {x.doc_tokens for x in pieces} == {len(ids) // 4}
    assert Counter({k: sum(x.length for x in got if x.doc_id == k) for k in want}) == want
    assert packing.pack(empty(spark)).count() == 0


def test_mixing(spark, texts):
    df, rows = odd_docs(spark, texts, extra=True)
    p = mixing.MixParams(shards=4, blocks=8, words_per_block=150)
    got = mixing.mix(df, p).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(5), p).collect()), key=repr)
    size = Counter()
    for r in rows:
        size[r[3]] += len(brute.WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = mixing.share([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    assert sum(target) == pytest.approx(sum(size.values()))
    for s, t in zip(order, target):
        own = [r for r in got if r.source == s]
        assert {r.target for r in own} == {t} and {r.source_size for r in own} == {size[s]}
        assert abs(sum(r.taken for r in own) - t) <= 1
        assert all(0 <= r.taken <= 3 * r.size and r.taken == sum(d.words for d in r.draws) for r in own)
    drawn = mixing.mix_documents(df, p)
    assert drawn.columns == df.columns
    assert Counter(len(brute.WORD.findall(r.text)) for r in drawn.collect()) == Counter(d.words for r in got for d in r.draws if True)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_mixing_by_size(spark, texts):
    df, rows = odd_docs(spark, texts)
    p = mixing.MixParams(shards=2, words_per_shard=300, blocks=1, words_per_block=100, docs_per_block=1)
    got = mixing.mix(df, p).collect()
    words_ = sum(r.size for r in got)
    places = Counter(d.shard for r in got for d in r.draws)
    assert max(places) < -(-words_ // 300) and len(places) > words_ / 300 / 3
    assert abs(sum(r.taken for r in got) - words_) < len({r.source for r in got})
    for broadcast_rows in (0, 10**6):
        again = mixing.mix(df, dataclasses.replace(p, broadcast_rows=broadcast_rows)).collect()
        assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    with pytest.raises(ValueError, match="most_sources"):
        mixing.mix(df, dataclasses.replace(p, most_sources=2))
    with pytest.raises(ValueError, match="most_quotas"):
        mixing.mix(df, dataclasses.replace(p, most_quotas=20))


def test_mixing_of_very_many_equal_rows(spark):
    """Equal rows share a block, but no task has to hold them to say which of them the mix still takes."""
    rows = [(7, "a b c", "s0")] * 3000 + [(i, "d e", "s0") for i in range(20)] + [(i, "x y z", "s1") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    p = mixing.MixParams(shards=2, blocks=1)
    out = mixing.mix(df, p)
    got = out.collect()
    target = {r.source_size: r.target for r in got}
    assert len(got) == len(rows) and set(target) == {9040, 1200}
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
        assert r.taken <= 3 * r.size and sum(d.words for d in r.draws) == r.taken
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sorted(map(tuple, mixing.mix(df.repartition(2), p).collect())) == sorted(map(tuple, got))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sum(size" not in "".join(x for x in plan.splitlines() if "windowspecdefinition" in x)


def test_large_draws():
    rng = np.random.default_rng(5)
    for good, bad, need in ((300, 700, 200), (5, 2000, 1500), (40, 3, 20), (1, 1, 1)):
        plain, own = ([f() for _ in range(4000)] for f in (lambda: int(rng.hypergeometric(good, bad, need)), lambda: mixing._draw(rng, good, bad, need, 0)))
        assert abs(np.mean(plain) - np.mean(own)) < 0.15 * max(np.std(plain), 0.1) and abs(np.std(plain) - np.std(own)) < 0.1 * max(np.std(plain), 0.1)
        assert max(0, need - bad) <= min(own) and max(own) <= min(good, need)
    far = [mixing._draw(rng, 10**11, 3 * 10**11, 10**10) for _ in range(20)]
    assert abs(np.mean(far) - 2.5 * 10**9) < 10**5 and len(set(far)) == 20


def test_share_and_split():
    assert mixing.share([10, 100, 1000], [5, 2, 1], 3.0)[0] == 30
    assert mixing.share([0, 0], [5, 2], 3.0) == [0, 0]
    counts = np.array([7, 0, 1000, 3])
    parts = mixing.split_quotas(counts, 6, 1)
    assert (parts.sum(0) == counts).all() and (parts >= 0).all() and max(parts.sum(1)) - min(parts.sum(1)) <= 2
    assert (mixing.split_quotas(counts, 6, 1) == parts).all()


def test_sharding(spark, texts):
    df, rows = odd_docs(spark, texts + ["hot text"] * 300, extra=True)
    got = sharding.shard(df, shards=7, ranges_per_shard=3).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((r[0], len((r[1] or "").encode()) + 16, brute.crc(r[1])) for r in rows)
    total, by = Counter(), {}
    for r in got:
        total[r.shard] += r.size
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(total.values()) - min(total.values()) <= 2 * max(r.size for r in got)
    assert sharding.shard(empty(spark)).count() == 0


def test_sharding_splits_equal_keys(spark, monkeypatch):
    rows = [(5, "hot text")] * 30_000 + [(None, "cold text")] * 30_000 + [(k, f"text {k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    drawn = []
    sample = sharding._sample
    monkeypatch.setattr(sharding, "_sample", lambda *a: drawn.append(sample(*a)) or drawn[-1])
    placed = []
    kept = sharding.materialize
    monkeypatch.setattr(sharding, "materialize", lambda table, name: placed.append(kept(table, name)) or placed[-1])
    got = sharding.shard(df, shards=10, ranges_per_shard=8, samples_per_range=4).cache()
    assert sum(map(len, drawn)) < 1.5 * 10 * 8 * 4
    assert placed[-1].groupBy("range").count().agg(F.max("count")).first()[0] < 5 * len(rows) / 80
    by = {r.shard: r for r in got.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("slot"), F.countDistinct("slot").alias("slots")).collect()}
    assert max(r["size"] for r in by.values()) - min(r["size"] for r in by.values()) <= 60
    assert all(r.n == r.slots == r.slot + 1 for r in by.values()) and sum(r.n for r in by.values()) == len(rows)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    rows = [(i, (x[i % 20] + 0.12 * x[i] / 4).tolist(), i) for i in range(60)]
    rows += [(100 + i, x[0].tolist(), 0) for i in range(40)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None, 1.0], 1), (204, [], None), (205, [1.0, 2.0], 3), (206, [2.0, 4.0], 3), (206, [2.0, 4.0], 3), (207, [float("inf")] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("c", F.lit(1))
    got = sorted(map(tuple, embed_dedup.embedding_links(df, recall=0.9999, bucket=16).collect()))
    good = [k for k, (_, v, _) in enumerate(rows) if v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    unit = {k: np.float32(rows[k][1]).astype(float) / np.linalg.norm(np.float32(rows[k][1]).astype(float)) for k in good}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.95] for k in good}
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen)
        want.append((i, len(near.get(k, [])), least, i == least))
    assert got == sorted(want)
    assert embed_dedup.embedding_links(df.limit(0)).count() == 0


def test_embeddings_in_double_precision(spark):
    near = 1 + 1e-9  # a cosine that floats can't tell from the threshold
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0]), (2, at(0.95 * near)), (3, at(0.95 / near)), (4, [1e200, 1e200, 0.0]), (5, [1e200, 1.1e200, 0.0]), (6, [3e-200, 3e-200, 0.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.embedding_links(df, recall=0.999999).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7)}


def test_embeddings_recall_as_shipped(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = rng.uniform(0.945, 0.97, len(x))[:, None]  # pairs near the threshold, the hardest to meet
    x = np.concatenate((x, c * x + np.sqrt(1 - c * c) * side))
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = Counter()
    for k in range(0, len(x), 1000):
        near = x[k : k + 1000] @ x.T >= 0.95
        want.update({ids[k + i]: int(n) - 1 for i, n in enumerate(near.sum(1)) if n > 1})
    got = {r.vec_id: r.n_links for r in embed_dedup.embedding_links(df).collect()}
    assert all(got[i] <= want[i] for i in got)  # none wrong
    assert sum(want.values()) > 2000 and sum(got.values()) >= 0.97 * sum(want.values())


PII = [
    "mail a.b@c.org, d@e.f.g.c_d@h.i and @x.y z@w", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 49927398716000", "+1 (555) 123-4567 +12 ++49 30 1234567890123 +1.....2",
    "é😀 a@b.c é 10.0.0.1", "a@b" * 50, "1" * 20000, "a" * 20000, "+" + "1(" * 5000, "1.1." * 3000, "- 4111111111111111 -", "٣.1.1.1.1",
]


def test_pii(spark, texts):
    df, rows = odd_docs(spark, texts + PII, extra=True)
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_pii(df).collect())
    assert got == sorted((r[0], *brute.pii_row(r[1])) for r in rows)
    assert pii.find_pii(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0
    names = list(brute.PII)
    for r in pii.redact(df).where(F.col("text").contains("<")).select("doc_id", "text").collect():
        source = next(x[1] for x in rows if x[0] == r.doc_id)
        out, at = "", 0
        for a, k, b in brute.pii_spans(source):
            if a >= at:
                out += source[at:a] + f"<{names[k]}>"
            at = max(at, b)
        assert r.text == out + source[at:]


def test_pii_patterns_find_more(spark):
    rng = random.Random(2)
    known = [f"{rng.choice(words(rng, 3))} phone +1 555 01{i:02d} {rng.randrange(1000, 9999)} and more" for i in range(30)]
    new = ["please phone 555-0199-77 today", "the word 555-0199-77 elsewhere", "version 2.0.11 is out"]
    df = spark.createDataFrame(list(enumerate(known + new)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert found[30].spans == "phone:13:24" and found[30].n_phone == 0 and found[30].n_added == 1
    assert found[31].spans == "" and found[32].spans == ""
    assert pii.redact(df).where("doc_id = 30").first().text == "please phone <phone> today"


def test_pii_secrets_by_their_context(spark):
    rng = random.Random(6)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [f'{words(rng, 1)[0]} token = "{hexed(39)}7" {words(rng, 1)[0]}' for _ in range(40)]
    rows += [f"the api_key={hexed(30)}9a, {words(rng, 1)[0]}" for _ in range(20)] + [f"commit {hexed(38)}a1 done" for _ in range(40)]
    # a random number after random words, and a word of chance before one kind
    rows += [f"{words(rng, 1)[0]} {rng.randrange(10**15, 10**16)} x" for _ in range(40)] + [f"rare a{i}@b.org" for i in range(4)] + ["rare 1234567 y"]
    asked = ['zz token = "SHORT-99" q', "the api_key=12-34-56.", f"commit {hexed(40)}"]
    df = spark.createDataFrame(list(enumerate(rows + asked)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for i, text in enumerate(rows + asked):
        own = [x.split(":") for x in found[i].spans.split(",") if x.startswith("secret")]
        if i < 60 or len(rows) <= i < len(rows) + 2:
            (_, a, b), body = own[0], text[int(own[0][1]) : int(own[0][2])]
            assert len(own) == 1 and text.count(body) == 1 and body[0] not in '"=' and text[int(b) : int(b) + 1] in ('"', ",", "."), text
        else:
            assert not own and found[i].n_added == 0, text
    assert pii.redact(df).where(f"doc_id = {len(rows)}").first().text == 'zz token = "<secret>" q'


def test_pii_finds_what_no_seed_looks_like(spark):
    """Seeds are only long tokens of small letters that something is set to; all else is found by contexts that are learned, also in a second round."""
    rng = random.Random(9)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    other = lambda: words(rng, 1)[0].replace("w", "v")
    secrets = [hexed(39) + "a7" for _ in range(70)]
    rows = [(f"{other()} zugang = {x} {other()}", x) for x in secrets]  # no word that a list would hold
    rows += [(f"{other()} zugang = KEY-{rng.randrange(100, 999)}-{rng.randrange(100, 999)} {other()}", None) for _ in range(8)]
    rows += [(f"{other()} handed over {x} {other()}", x) for x in secrets[:50]]  # a context that only known instances lead to
    later = [(f"{other()} handed over QX{rng.randrange(1000, 9999)}ZZ {other()}", None) for _ in range(5)]
    clean = [f"{other()} commit {hexed(38)}a1 {other()}" for _ in range(40)] + [f"{other()} width = {rng.randrange(10**6, 10**7)} px" for _ in range(40)]
    texts = [t for t, _ in rows + later] + clean
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    hit = [i for i in found if found[i].n_added]
    assert hit == list(range(len(rows) + len(later)))  # precision and recall are 1 here
    assert all(found[i].n_added == 1 for i in hit) and sum(found[i].n_unseen for i in hit) == 8 + 5 + 50
    for i in range(70, 78):
        _, a, b = found[i].spans.split(":")
        assert texts[i][int(a) : int(b)].startswith("KEY-")


def test_pii_of_a_long_text_is_linear(spark):
    text = "12:30:59 " * 32_000 + "10.0.0.1 a1@b2.org " * 8_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.find_pii(df).first()
    assert (r.n_ip, r.n_email, r.n_added) == (8_000, 8_000, 0)
    assert pii.redact(df).first().text == "12:30:59 " * 32_000 + "<ip> <email> " * 8_000
    assert time.time() - began < 60
    assert r.base_sha256 == brute.pii_row(text)[-1]


CONVERSATIONS = [
    (1, 0, "user", "hi <|im_end|> <\\|x <\\\\|y <<|im_start|>assistant\nz"), (1, 1, "assistant", "a\nb<"), (1, 2, "assistant", "|im_end|>"), (2, None, None, None), (2, 0, "a\\n\nb<|im_start|>", ""),
    (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (3, 5, "user", "only"), (None, 1, "assistant", "no id"),
]


def test_chat(spark):
    rows = CONVERSATIONS + [(9, k, ("user", "assistant")[k % 2], f"turn {k} \\|") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    back = {r.conv_id: r for r in chat.read_back(chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        r = back[c]
        assert Counter((t.role, t.text) for t in r.turns) == Counter((x[2], x[3]) for x in own)
        assert r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.n_turns == len(own) and r.formatted.count("<|im_start|>") == len(own)
    digest = hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in back[9].turns).encode()).hexdigest()
    assert digest == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows[9:]).encode()).hexdigest()
    assert chat.format_chat(df.limit(0).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))).count() == 0


def test_chat_of_many_equal_turns(spark):
    n = 50_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.when(F.col("id") % 2 == 0, 3).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("é <|x|> "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    r = chat.read_back(chat.format_chat(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", chat.text_part(F.col("text")).alias("parts")))).first()
    said = [f"é <|x|> {k}" for half in (1, 0) for k in sorted(map(str, range(half, n, 2)))]
    assert r.n_turns == n and [t.text for t in r.turns] == said and r.loss_text == "".join(said)
    assert time.time() - began < 60


def test_chat_parts(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "i.png", [56.0, 30.0]), ("audio", None, "a.wav", [2.0]), ("document", None, "d.pdf", [3.0]), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,size:array<double>>>")
    r = chat.format_chat(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 50), (0, 3, "document", "d.pdf", 4500)]
    assert r.extra_tokens == 4554 and len(r.loss) == 1
    bad = spark.createDataFrame([(1, 0, "user", [("video", None, None, None)])], df.schema)
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_chat(bad).collect()


def test_automaton_equals_levenshtein():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["idiot", "worthless", "disgusting", "scum", "pathetic"]
    auto, rng = toxicity.LexiconAutomaton(terms), random.Random(7)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "i", "zz"])
        w = "".join(w)
        exact = any(w.startswith(t) for t in terms)
        best = min((distance(w, t) for t in terms if w[:1] == t[0] and distance(w[1:], t[1:]) <= toxicity.distance_for(t)), default=-1)
        got = auto.match(w)
        assert got == 0 if exact else (got > 0) == (best > 0), w


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["grumblor", "snarkwit", "foulbeak"]
    rows, labels = [], []
    for i in range(900):
        w = words(rng, 40, 3000)
        toxic = i % 6 == 0
        if toxic:
            for b in rng.sample(bad, 2):
                w[rng.randrange(40)] = b
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    extra = [(9001, "grumblr and snarkvit here"), (9002, 'he said "you grumblor" aloud'), (9003, "GRUMBLOR! snarkwit, foulbeak."), (9004, None), (9005, ""), (9006, "w1 w2 w3")]
    docs = spark.createDataFrame(rows + [(i, t, None, None, None) for i, t in extra], DOCS).withColumn("score", F.lit(3))
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    assert set(model.terms) == set(bad)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i in range(900):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(got[i].predicted, int(i % 6 == 0)) for i in range(900) if got[i].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert got[9001].n_near == 2 and got[9002].n_quoted == 1 and got[9002].score < got[9003].score
    assert got[9004].score == got[9005].score == got[9006].score < 0.3
    flipped = table.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert again == {k: r.score for k, r in got.items()}  # held-out labels play no part
    none = toxicity.fit(docs, table.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, none).collect()} < {0.0, none.score(np.zeros((1, 5)))[0]} | {0.0}
    assert toxicity.score(empty(spark), model).count() == 0


def labelled(spark, rows):
    """Documents and labels of (text, toxic), with ids that are learned from."""
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i, *r) for i, r in zip(ids, rows, strict=False)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")


def test_weak_terms_are_told_by_rates(spark):
    rng = random.Random(3)
    rows = [(" ".join([*words(rng, 12), *(["you", "grumblex"] if i < 20 else [])]), 1) for i in range(40)]
    rows += [(" ".join([*words(rng, 12), *(["grumblex"] if i < 6 else [])]), 0) for i in range(400)]
    model = toxicity.fit(*labelled(spark, rows))
    assert any(t.startswith("gru") for t in model.weak)  # 20 of 40 toxic and 6 of 400 clean texts: 0.03 of the rate


def test_no_term_is_left_out():
    stems = [a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    counts = [(t, 30, 0) for t in stems] + [(t[::-1] + "z", 10, 0) for t in stems] + [("x" + t, 30, 20) for t in stems]
    strong, weak = toxicity.choose_terms(counts, 100, 1000, toxicity.ToxicityParams())
    assert set(strong) == set(stems) and set(weak) == {"x" + t for t in stems}


def test_scores_do_not_depend_on_the_cap(spark):
    rng = random.Random(4)
    rows = [(" ".join([*words(rng, 12), *(["grumblex"] if i < 70 else [])]), 1) for i in range(100)]
    rows += [(" ".join([*words(rng, 12), *(["grumblex"] if i % 25 == 0 else [])]), 0) for i in range(1600)]
    docs, labels = labelled(spark, rows)
    whole, capped = (toxicity.fit(docs, labels, toxicity.ToxicityParams(sample=k)) for k in (6000, 100))
    assert whole.weak and whole.weak == capped.weak
    assert abs(whole.weights[0] - math.log(30 / 1536)) < 0.5  # what all labels say of a text without hits
    assert abs(whole.weights[0] - capped.weights[0]) < 0.5


def test_one_labelled_id_of_many_rows_is_one_row_of_the_fit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, worth, f=toxicity._logistic: seen.append(worth) or f(x, y, worth))
    rng = random.Random(4)
    rows = [(" ".join([*words(rng, 12), *(["grumblex"] if i < 70 else [])]), 1) for i in range(100)] + [(" ".join(words(rng, 12)), 0) for _ in range(400)]
    docs, labels = labelled(spark, rows)
    many = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(3000)).select("doc_id", "text"))
    once, often = (toxicity.fit(d, labels).weights for d in (docs, many))
    assert len(seen[0]) == len(seen[1]) < 500 and seen[1].max() > 1000 > seen[0].max() and once[1] > 0 < often[1]


def test_what_automaton_and_window_decide(spark):
    """Misspelt abuse and quoted terms, scored with and without near spellings and without quotation windows."""
    rng = random.Random(12)
    bad = ["grumblor", "snarkwit", "foulbeak", "mudlickle"]

    def misspelt(t):
        k = rng.randrange(1, len(t) - 1)
        return t[:k] + rng.choice(["", rng.choice("aeiou") + t[k], t[k] * 2 + t[k]][:2]) + t[k + 1 :]

    def text(*own):
        w = words(rng, 30, 3000)
        for x in own:
            w.insert(rng.randrange(len(w)), x)
        return " ".join(w)

    abuse = lambda f: text(*(f(b) for b in rng.sample(bad, 3)))
    rows = [(abuse(str), 1) for _ in range(150)] + [(abuse(misspelt), 1) for _ in range(60)]
    rows += [(text(), 0) for _ in range(1200)] + [(text(f'said "{rng.choice(bad)}"'), 0) for _ in range(4)]
    model = toxicity.fit(*labelled(spark, rows))
    assert set(bad) <= set(model.terms)
    bent, quoting = [abuse(misspelt) for _ in range(60)], [text(f'he said "you {b}" to them') for b in bad * 10]
    flagged = lambda texts, change: sum(float(model.score(np.array([model.features(change(model.hits(t)))]))[0]) >= 0.3 for t in texts)
    exact, plain = lambda hits: [h for h in hits if h[1] != 1], lambda hits: [(*h[:3], False) for h in hits]
    assert flagged(bent, lambda h: h) >= 57 and flagged(bent, exact) <= 6  # 60 misspelt ones: the automaton finds them
    kept = lambda change: np.mean([model.score(np.array([model.features(change(model.hits(t)))]))[0] for t in quoting])
    assert kept(lambda h: h) < kept(plain) and flagged(quoting, lambda h: h) < flagged(quoting, plain) == 40


def test_logistic_ends_where_classes_are_apart():
    x, y = np.zeros((60, 5)), np.arange(60.0) < 20
    x[:20, 0] = 3
    for many in (1.0, 1e4, 1e9):
        worth = np.where(y, 1.0, many)
        w = toxicity._logistic(x, y.astype(float), worth)
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        slope = np.array([(worth * (y - p)).sum() - 1e-3 * w[0], (worth * (y - p)) @ x[:, 0] - 0.05 * w[1]])
        assert np.isfinite(w).all() and (np.abs(slope) < 1e-3).all()


def test_shared_folder_is_the_sessions(spark, tmp_path):
    old = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert folder and (old is None or folder == old.rstrip("/"))
