"""Best-fit packing, whitening and the prefix trie: brute force, defined edges, whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from journeyspark.llm import packing, prefix_trie, whitening

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- packing


def one_by_one(counts, limit):
    """Best-two-fit with every bin made anew from a list of pieces."""
    left = sorted(Counter(counts).elements(), reverse=True)
    bins = []
    while left:
        own, gap = [], limit
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        if gap and len(own) > 1 and left:
            least, best = own[-1], None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if least < a + b <= gap + least and a != least != b and (best is None or a + b > sum(best)):
                        best = (a, b)
            if best:
                own.remove(least)
                for n in best:
                    left.remove(n)
                    own.append(n)
                left = sorted([*left, least], reverse=True)
        bins.append(own)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_whole_and_tight(seed):
    r = random.Random(seed)
    limit = r.choice([10, 37, 100])
    counts = Counter(min(limit, 1 + int(r.expovariate(4 / limit))) for _ in range(400))
    plan = packing.packing_plan(counts, limit)
    places = defaultdict(list)
    for n, count in counts.items():
        runs = plan[plan[:, 0] == n]
        for rank in range(count):
            run = runs[np.searchsorted(runs[:, 1], rank, "right") - 1]
            at, turn = divmod(rank - run[1], run[2])
            places[run[3] + at].append((run[4] + turn * n, n))
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= limit
    slow = one_by_one(counts, limit)
    assert len(slow) - 1 <= len(places) <= len(slow) + 1
    assert len(places) <= -(-sum(n * c for n, c in counts.items()) // limit) * 1.03 + 1


def test_two_replace_the_smallest():
    b = packing.BestTwoFit({6: 1, 3: 1, 2: 2}, 10)
    assert next(b.bins()) == ({6: 1, 2: 2}, 1) and b.left == {6: 0, 3: 1, 2: 0}


def test_many_equal_bins_are_one_run():
    plan = packing.packing_plan({700: 3_000_000_000, 600: 2_000_000_000, 48: 10**9}, 2048)
    assert len(plan) < 40


def test_plan_is_bounded_by_the_limit():
    r = np.random.default_rng(1)
    sizes = [len(packing.packing_plan({n: int(c) for n, c in enumerate(r.poisson(rate, 2048), 1)}, 2048)) for rate in (3, 300, 300_000)]
    assert sizes[2] < 4 * sizes[1] and sizes[2] < 60_000


TEXTS = [None, "", " ", "one two three", "Éa ç<|endoftext|> x  \n\n y\t z  w", "漢字 и кириллица 😀 'll don't", "a" * 3000, " " * 2500, "word " * 5000, "no gap\x1c\x85x", "one two three"]


def test_ids_are_the_tokenizers(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)] + [(None, "null id")], "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset", "rank", "row", "order")})
    got = defaultdict(list)
    for r in packing.pack(packing.token_pieces(docs)).collect():
        got[r.doc_id].append(r)
    for i, x in [*enumerate(TEXTS), (None, "null id")]:
        want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted(got[i], key=lambda r: r.piece)
        assert [v for r in own for v in r.ids] == want
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and all(r.length == len(r.ids) for r in own)
        assert all(r.length == 2048 for r in own[1:]) and len(own) == -(-len(want) // 2048)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)


def test_query_packs_the_whole_table(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op11_best_fit_packing(spark, DATA).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert {d.doc_id for d in docs} == set(by_doc)
    for d in docs:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for r in by_doc[d.doc_id]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in by_doc[d.doc_id]) == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 40)) for i in range(300)], "doc_id int, text string")
    packed = packing.pack(packing.token_pieces(docs, limit=128), 128)
    seqs = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
    assert sum(s.n_tokens for s in seqs.values()) == sum(r.length for r in packed.collect()) and max(s.n_tokens for s in seqs.values()) <= 128


def test_packing_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(packing.token_pieces(none)).count() == 0
    with pytest.raises(ValueError, match="2 pieces"):
        packing.pack(spark.createDataFrame([(1, 0, 5), (2, 0, 0), (3, 0, None)], "doc_id int, piece int, length long"), 5, order=("doc_id",)).count()
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("length"))
    got = packing.pack(hot, 64, order=("doc_id",)).collect()
    assert len({r.sequence_id for r in got}) == -(-5000 // 9) and len({(r.sequence_id, r.offset) for r in got}) == 5000


# ---- whitening


def check_white(rows, vectors, weights="one", components=4):
    """rows: (x, n, deviation, whitened, explained, identity_error) by brute force."""
    dim = max(map(len, vectors))
    full = [tuple(v) + (0,) * (dim - len(v)) for v in vectors]
    fit = list(dict.fromkeys(full)) if weights == "one" else full
    x = np.array(fit, float)
    n, sums = len(fit), [sum(v[i] for v in fit) for i in range(dim)]
    c = x - np.array(sums, float) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, dim)
    signs, seen = [None] * k, []
    for r in rows:
        own = tuple(r.x) + (0,) * (dim - len(r.x))
        d = sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
        assert r.n == n and r.deviation == (d if d < 1 << 63 else None) and len(r.whitened) == k
        for i in range(k):
            assert r.explained[i] == pytest.approx(e[i] / np.trace(v), rel=1e-9)
            if e[i] > 1e-9 * e[0]:
                z = float((np.array(own, float) - np.array(sums, float) / n) @ q[:, i] / np.sqrt(e[i]))
                if signs[i] is None and abs(z) > 1e-6:
                    signs[i] = np.sign(z) * np.sign(r.whitened[i])
                assert r.whitened[i] * (signs[i] or 1) == pytest.approx(z, abs=1e-6)
            else:
                assert r.whitened[i] is None
        assert r.identity_error < 1e-8
        seen.append(own)
    assert sorted(seen) == sorted(full)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_by_brute_force(spark, weights):
    r = np.random.default_rng(3)
    vectors = [(r.integers(-500, 500, 6) * np.array([9, 5, 3, 2, 1, 1])).tolist() for _ in range(120)]
    vectors += [vectors[0]] * 200 + [vectors[1]] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, x array<bigint>").withColumns({c: F.lit("old") for c in ("n", "deviation", "_x", "_w", "_h", "z")})
    out = whitening.whiten(df, weights=weights)
    assert set(out.columns) == {*df.columns, *whitening.OUT} and out.where("z = 'old' and _x = 'old'").count() == len(vectors)
    check_white(out.collect(), vectors, weights)


def test_whitening_edges(spark):
    def of(rows, **named):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, x array<bigint>"), **named).collect()

    assert of([]) == [] and of([(1, None), (2, [1, None])]) == []
    (one,) = of([(1, [5, 7])])
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, [None, None], [None, None], None)
    same = of([(1, [5]), (None, [5])])
    assert [r.n for r in same] == [1, 1] and {r.vec_id for r in same} == {1, None}
    assert of([(1, [])])[0].whitened == []
    mixed = [[1, 2], [4], [3, 9, 0], [2, 2, 2, 1, 7], []]
    check_white(of([(i, v) for i, v in enumerate(mixed)]), mixed)
    big = [[1 << 62, 0], [-(1 << 62), 5], [(1 << 62) - 9, 1]]
    check_white(of([(i, v) for i, v in enumerate(big)], components=1), big, components=1)


def test_scaled_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, [nan]), (2, [inf]), (3, [None]), (4, None), (5, [3e38]), (6, [-0.0])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "vec_id int, v array<float>").select("vec_id", whitening.scaled("v")).collect()}
    assert got == {0: [128, -1], 1: None, 2: None, 3: None, 4: None, 5: [(1 << 63) - 1], 6: [0]}


def test_query_whitens_the_whole_table(spark):
    rows = whitening.op12_embedding_whitening(spark, DATA).collect()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = {r.vec_id: [int(np.floor(256 * float(np.float32(c)))) for c in r.embedding] for r in table}
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    assert set(by) == set(x) and all(sorted(c) == [1, 2, 3, 4] for c in by.values())

    class Row:
        pass

    out = []
    for i, c in by.items():
        row = Row()
        row.x, row.n, row.deviation, row.identity_error = x[i], c[1].n, c[1].deviation, c[1].identity_error
        row.whitened, row.explained = [c[j].whitened for j in (1, 2, 3, 4)], [c[j].explained for j in (1, 2, 3, 4)]
        out.append(row)
    check_white(out, list(x.values()))


# ---- tree contraction and the prefix trie


@pytest.mark.parametrize("shape", ["chain", "star", "random", "brush", "forest", "one"])
def test_subtree_sums(spark, shape):
    r = random.Random(shape)
    n = {"chain": 700, "one": 1}.get(shape, 400)
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: r.randrange(i), "brush": lambda i: i - 1 if i % 2 else max(0, i - 2), "forest": lambda i: None if i % 50 == 0 else i - r.randrange(1, i % 50 + 1)}.get(shape)
    up = [None] + [parent(i) for i in range(1, n)] if n > 1 else [None]
    value = [r.randrange(-5, 100) for _ in range(n)]
    want, leaves = list(value), [0 if i in up else 1 for i in range(n)]
    for i in reversed(range(n)):
        if up[i] is not None:
            want[up[i]] += want[i]
            leaves[up[i]] += leaves[i]
    tree = spark.createDataFrame([(i, u, v, int(i not in up)) for i, (u, v) in enumerate(zip(up, value, strict=True))], "id bigint, up bigint, v bigint, leaf bigint")
    got = {x.id: (x.v, x.leaf) for x in prefix_trie.subtree_sums(tree, "id", "up", ["v", "leaf"]).collect()}
    assert got == {i: (want[i], leaves[i]) for i in range(n)}


def test_circles_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_ROUNDS", 5)
    ring = spark.createDataFrame([(0, 1, 1), (1, 0, 1)], "id bigint, up bigint, v bigint")
    with pytest.raises(ValueError, match="circle"):
        prefix_trie.subtree_sums(ring, "id", "up", ["v"])


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    out = set()
    for k, who in nodes.items():
        below = [q for q in nodes if q[: len(k)] == k]
        kids = [q for q in below if len(q) == len(k) + 1]
        ends = ",".join(map(str, sorted(c for c in who if len(seqs[c]) == len(k))))
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        leaves = sum(not any(p[: len(q)] == q and len(p) == len(q) + 1 for p in nodes) for q in below)
        out.add((min(who), len(k), min(nodes[k[:-1]]) if k else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df):
    return [tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns_of(df))).select(*COLUMNS).collect()]


def test_trie_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    r = random.Random(5)
    rows = [(0, t, "user", f"turn {t} of nought") for t in range(60)]
    for c in range(1, 120):
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(["hello there", "a b c", "", None, "x"])) for t in range(r.randrange(0, 6))]
    rows += [(140, None, "user", "first"), (140, 0, "user", "second"), (140, 0, "user", "second"), (161, 0, None, None), (None, 0, "user", "lost"), (21, 0, "user", "more"), (21, 0, "system", "more")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(9) for c in ("conv", "at", "words", "id", "up", "part", "order", "depth")})
    got = trie(df)
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")) == []


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "only") for c in range(25, 40)]  # the base is absent, so some are left without turns
    got = trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert set(got) == brute_trie(rows) and any(g[1] == 0 and g[3] == 15 for g in got)


def test_trie_query_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    ran = duck.execute(prefix_trie.ORACLE_SQL)
    names = [c[0] for c in ran.description]
    want = sorted(map(repr, ran.fetchall()))
    df = prefix_trie.op13_prefix_trie(spark, DATA)
    assert sorted(names) == sorted(df.columns) and all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want
