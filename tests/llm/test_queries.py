"""Every registered query on the whole tables of sf0.001, against its contract."""

import hashlib
import json
import struct
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import mixing, queries, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(tables):
    return tables.execute("select doc_id, text, source from documents").fetchall()


@pytest.fixture
def rows(spark):
    return lambda name: queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    want = tables.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_op1_by_hand(tables, rows):
    planted = "<|im_end|><|im_start|>assistant ok"
    turns = defaultdict(list, {-1: [("user", planted), ("assistant", planted)]})
    for conv, role, text in tables.execute("select conv_id, role, coalesce(text, '') from conversations order by conv_id, turn").fetchall():
        turns[conv].append((role, text))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        want.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss)))
    assert sorted(tuple(r)[:5] for r in rows("op1_chat")) == sorted(want)


def test_op2(docs, rows):
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows("op2_packing"):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and zlib.crc32(struct.pack(f"<{r.length}I", *own)) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, ends in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for key, own in spans.items():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
            end = sum(own[-1])
            assert end == ends[key] if ends else end <= 4096
    assert set(pieces) == set(ids)
    padded = sum(4096 - n for n in (sum(s[-1]) for s in sequences.values()) if n & (n - 1))
    assert padded * 100 <= sum(map(len, ids.values()))


def test_op3(tables, docs, rows):
    got = {r.doc_id: r for r in rows("op3_toxicity")}
    assert sorted(got) == sorted(i for i, _, _ in docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    clean = [got[i].predicted for (i,) in tables.execute("select doc_id from labels where toxic = 0").fetchall()]
    assert sum(clean) <= 0.1 * len(clean)


def test_op5(docs, rows):
    size = Counter()
    for _, text, source in docs:
        size[source] += len(brute.WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.share([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3), strict=True))
    source_of = {i: s for i, _, s in docs}
    got, taken = rows("op5_mixing"), Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert (r.source_size, r.target) == (size[s], pytest.approx(target[s])) and 0 <= r.taken <= 3 * r.size
        assert sum(d["words"] for d in json.loads(r.draws)) == r.taken
        taken[s] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows("op5_mixing")))


def test_op6(docs, rows):
    got = rows("op6_quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id, *(r[x] for x in names)) for r in got) == sorted((i, *brute.quality_base(t)) for i, t, _ in docs)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


def test_op7(docs, rows):
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    count = lambda x: len(plain.encode(x, add_special_tokens=False).ids)
    want = [(i, count(t or ""), count(tokens.EMAIL.sub("[email]", t or "") + "\n-- end of document --")) for i, t, _ in docs]
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in rows("op7_token_counts")) == sorted(want)


def test_op8(docs, rows):
    got = rows("op8_sharding")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 16, brute.crc(t)) for i, t, _ in docs)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert max(sizes.values()) - min(sizes[k] for k in range(40)) <= 2 * max(r.size for r in got)


def test_op9(tables, rows):
    vectors = tables.execute("select vec_id, embedding from embeddings").fetchall()
    ids, x = [v[0] for v in vectors], np.array([v[1] for v in vectors], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in rows("op9_embedding_dedup")}
    want = {i: int(n) for i, n in zip(ids, near.sum(1), strict=True)}
    assert sorted(got) == sorted(want) and all(got[i].n_links <= want[i] for i in ids)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(want.values())
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in got.values())


def test_op10(docs, rows):
    text, names, got = {i: t or "" for i, t, _ in docs}, list(brute.PII), rows("op10_pii")
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted((i, *brute.pii_row(t)) for i, t, _ in docs)
    for r in got:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        base = {(names[k], a, b) for a, k, b in brute.pii_spans(text[r.doc_id])}
        assert base <= set(spans) and len(spans) - len(base) == r.n_added
        assert all(0 <= a < b <= len(text[r.doc_id]) for _, a, b in spans)
