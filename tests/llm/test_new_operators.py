"""The prefix trie, the streaming dedup and the collocations against brute force, with nulls, ties, repeats, odd columns and empty tables."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import collocations, prefix_trie, queries, stream_dedup, storage

TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(convs):
    """convs: conv_id to a tuple of (role, text). The contract's nodes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in inside if q)
        ends = ",".join(map(str, sorted(c for c in own if convs[c] == p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), up, len(own), kids[p], sum(not kids[q] for q in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted((tuple(r[x] for x in NODE) for r in df.collect()), key=repr)


def turn_rows(convs):
    return [(c, k if k else None, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]


@pytest.mark.parametrize("least", [prefix_trie.LEAST_TURNS, 25, 1])
def test_trie(spark, least):
    rng = random.Random(3)
    shared = [("user", "hi"), ("assistant", "é" * 40), ("user", "the same")]
    convs = {}
    for c in range(0, 900, 4):
        kind = rng.randrange(4)
        own = [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "c c"])) for _ in range(rng.randrange(0, 6))]
        convs[c] = tuple([*shared, *own] if kind == 0 else shared if kind == 1 else own if kind == 2 else [*shared, ("user", f"only {c}")])
    df = spark.createDataFrame(turn_rows(convs), TURNS).withColumn("key", F.lit(1)).withColumn("n_convs", F.lit("x")).repartition(3)
    paths = prefix_trie.conversation_paths(df)
    turnless = spark.createDataFrame([(c,) for c, t in convs.items() if not t], "conv_id long").withColumn("turns", F.lit(None).cast(paths.schema["turns"].dataType))
    got = prefix_trie.prefix_trie(paths.unionByName(turnless), least_turns=least)
    assert nodes(got) == plain_trie(convs)
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in prefix_trie.with_texts(got, df).collect()}
    assert len(texts) == got.count() and all(texts[c, d] == (convs[c][d - 1] if d else (None, None)) for c, d in texts)


def test_trie_of_one_long_and_one_very_common_conversation(spark):
    long = tuple(("user", f"t{k}") for k in range(3000))
    convs = {c: long if c in (5, 6) else (*long[:2990], ("user", str(c))) if c < 20 else (("user", "common"),) for c in range(5000)}
    rows = [(c, *t) for c, t in convs.items()]
    df = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], TURNS)
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(prefix_trie.conversation_paths(df)).collect()}
    assert len(got) == 1 + 1 + 2990 + 10 + 18 and len(rows) == 5000
    common = got[20, 1]
    assert (common.n_convs, common.parent_conv_id, common.n_leaves, common.saved_tokens) == (4980, 0, 1, 4979 * 6)
    assert common.ends_sha256 == hashlib.sha256(",".join(map(str, range(20, 5000))).encode()).hexdigest()  # ids of several blocks
    assert (got[0, 2990].n_children, got[0, 2990].n_leaves, got[0, 1].n_leaves, got[5, 3000].n_convs) == (19, 19, 19, 2)
    assert got[0, 1].saved_tokens == sum(19 * len(t) for _, t in long[:2990]) + sum(len(t) for _, t in long[2990:])


def test_trie_of_odd_rows(spark):
    rows = [(1, 2, None, None), (1, None, "user", "x"), (1, 2, None, ""), (None, 1, "user", "lost"), (2, None, "user", "x"), (2, 7, "", ""), (-3, 1, "user", None)]
    same = [("user", "x"), ("", ""), ("", "")]
    assert nodes(prefix_trie.prefix_trie(prefix_trie.conversation_paths(spark.createDataFrame(rows, TURNS)))) == plain_trie({1: tuple(same), 2: tuple(same[:2]), -3: (("user", ""),)})
    empty = prefix_trie.prefix_trie(prefix_trie.conversation_paths(spark.createDataFrame([], TURNS)))
    assert empty.collect() == [] and set(NODE) <= set(empty.columns)


def test_rebuilt(spark):
    rng, convs = random.Random(8), {}
    for c in rng.sample(range(120), 70):
        convs[c] = tuple((rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randrange(1, 12)))
    want = {}
    for c, own in convs.items():
        h = brute.zlib.crc32(str(c).encode()) % 9
        want[c] = convs.get(c - c % 5, ())[:h] + own[h:]
    df = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)], TURNS)
    assert nodes(prefix_trie.prefix_trie(queries.rebuilt(prefix_trie.conversation_paths(df)))) == plain_trie(want)


DOCS = "doc_id long, text string, lang string"


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute.lowered(t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        first = False
        for i in ids:
            stays = i == keep and not first
            first = first or stays
            out.append((i, keep, len(ids), stays, sha))
    return sorted(out, key=repr)


TEXTS = [None, "", "A b", "a B", "É x", "é x", "É X", "x" * 5000, "X" * 5000, "one", "One", "ONE", "two\n", "Two\n", "K" + "K", "kK"]


def found(seen):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in seen.documents().collect()), key=repr)


# texts of one length have one digest in the second case, and are told apart by their bytes
@pytest.mark.parametrize("digest", [stream_dedup.sha256_digest, lambda text, level: F.length(text)])
def test_stream_dedup(spark, digest):
    rng = random.Random(4)
    rows = [(rng.randrange(60) if k % 9 else None, rng.choice(TEXTS)) for k in range(160)]
    base = f"{storage.shared_folder(spark)}/test-{random.randrange(10**12)}"
    columns = F.lit(7).alias("place"), F.lit("d").alias("digest"), F.lit("f").alias("file_path"), F.lit(1).alias("_metadata")
    make = lambda part: spark.createDataFrame([(*r, "en") for r in part], DOCS).select("*", *columns)
    make(rows[:90]).repartition(3).write.parquet(f"{base}/in")
    seen = stream_dedup.StreamDedup(spark, f"{base}/in", f"{base}/state", digest=digest)
    seen.absorb()
    assert found(seen) == plain_dedup(rows[:90])
    make(rows[90:]).repartition(2).write.mode("append").parquet(f"{base}/in")
    again = stream_dedup.StreamDedup(spark, f"{base}/in", f"{base}/state", digest=digest)  # goes on with the state of the first
    again.absorb()
    again.absorb()  # nothing new
    assert found(again) == plain_dedup(rows)
    assert (again.deeper is not None) == (digest is not stream_dedup.sha256_digest)


def test_stream_dedup_keeps_its_state_on_disk_and_only_writes_what_changed(spark):
    base = f"{storage.shared_folder(spark)}/test-{random.randrange(10**12)}"
    spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 20).alias("text")).write.parquet(f"{base}/in")
    seen = stream_dedup.StreamDedup(spark, f"{base}/in", f"{base}/state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen.absorb()
    spark.createDataFrame([(99, "T3"), (98, "new")], "doc_id long, text string").write.mode("append").parquet(f"{base}/in")
    seen.absorb()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert sorted(r.n for r in spark.read.parquet(f"{base}/state/changed/batch=1").collect()) == [1, 4]
    kept = spark.read.format("statestore").load(f"{base}/state/checkpoint")
    assert kept.count() == 21
    assert {r.id: r.kept for r in seen.documents().collect()}[99]


def test_stream_dedup_of_an_empty_table(spark):
    base = f"{storage.shared_folder(spark)}/test-{random.randrange(10**12)}"
    spark.createDataFrame([], DOCS).write.parquet(f"{base}/in")
    seen = stream_dedup.StreamDedup(spark, f"{base}/in", f"{base}/state")
    seen.absorb()
    assert seen.documents().collect() == []


def plain_collocations(rows, least, longest, cover, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in collocations_split(brute.lowered(text or "")):
            n[lang] += len(piece)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(piece[i : i + m]) for i in range(len(piece) - m + 1))
    out = []
    for lang, f in counts.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        good = []
        for p, a in own.items():
            subs = [q for q in own if len(q) > len(p) and 100 * own[q] >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not subs:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                good.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(good)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def collocations_split(text):
    for piece in brute.re.split("[.,;:!?\x0a-\x0d]", text):
        yield brute.re.findall("[^\x20\x09]+", piece)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(6)
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("...!?", "en"), ("\x1c \xa0 \x85", "en")]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 60)):
            words += rng.choice([["New", "york", "City"], ["as", "well", "as"], ["a"], ["b"], ["é"], ["É"], [f"w{rng.randrange(40)}"], ["the", "end", "of", "the", "day"], ["the", "the", "the"]])
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for w in words)
        rows += [(text, rng.choice(["en", "en", "de", None, "und", "en\0x"]))]
    return rows + rows[:3]


@pytest.mark.parametrize("parameters", [(3, 4, 80, 2000), (5, 4, 30, 7), (2, 2, 80, 5), (2, 6, 60, 2000)])
def test_collocations(spark, phrase_rows, parameters):
    df = spark.createDataFrame(phrase_rows, "text string, lang string").select("*", F.lit(1).alias("phrase"), F.lit(2).alias("f"), F.lit(3).alias("salt")).repartition(3)
    got = collocations.collocations(df, *parameters)
    assert sorted(map(tuple, got.collect())) == plain_collocations(phrase_rows, *parameters)


def test_collocations_with_a_bitmap_of_wrong_bits_and_small_slices(spark, phrase_rows, monkeypatch):
    """A bitmap so full that most phrases pass, and texts cut where pieces end, give the same counts."""
    full = collocations._bitmap
    monkeypatch.setattr(collocations, "_bitmap", lambda level: full(level) | 0xFE)
    df = spark.createDataFrame(phrase_rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(df, 3).collect())) == plain_collocations(phrase_rows, 3, 4, 80, 2000)
    text = ". ".join(t or "" for t, _ in phrase_rows).encode()
    buf = collocations.np.frombuffer(text, dtype="uint8")
    monkeypatch.setattr(collocations, "SLICE", 1000)
    parts = list(collocations._short(buf, collocations.np.array([0, len(buf)])))
    assert len(parts) > 5 and b"".join(p.tobytes() for p, _ in parts) == text
    assert list(itertools.chain(*(collocations_split(p.tobytes().decode()) for p, _ in parts if p.size))) and sum(len(x) for p, _ in parts for x in collocations_split(p.tobytes().decode())) == sum(len(x) for x in collocations_split(text.decode()))


def test_collocations_in_exact_arithmetic(spark):
    a = 9_000_000_000_000
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(a).alias("l"), F.lit(a + 1).alias("r"))
    assert row.select(F.expr(collocations.SCORE)).first()[0] == 2_000_000 * a // (2 * a + 1)


def test_collocations_of_empty_tables(spark):
    for rows in ([], [("", "en"), (None, None)]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []
