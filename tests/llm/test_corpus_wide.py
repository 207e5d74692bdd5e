"""Operators over the whole table, against brute force: near-duplicates, mixing, packing, top-k, token store, pipeline."""

from __future__ import annotations

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from loomtext.llm import bpe, buckets, embedding_dedup, mixing, packing, pii, simhash, token_ids, topk
from loomtext.llm.graph import components
from tests import oracle
from tests.llm.samples import AWKWARD, LONG, docs, prose

CODER = bpe.load(bpe.VOCAB_PATH)
VECTORS = "vec_id bigint, embedding array<float>, rank string, keep_id int"


def parts(edges):
    """Least member of the connected part of each node."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@given(st.lists(st.tuples(st.integers(-5, 25), st.integers(-5, 25)), max_size=30))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 1), (2, None)], "a bigint, b bigint")).collect()}
    assert got == {x: r for x, r in parts(edges).items() if x != r}


def near_copies(rng, n):
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(60, 200)).split()
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(len(words) // 25):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def test_simhash_groups_against_all_pairs(spark):
    rows = near_copies(random.Random(3), 250)
    prints = np.array([np.unpackbits(np.frombuffer(simhash.fingerprint(t), np.uint8)) for _, t, _ in rows], int)
    far = prints @ (1 - prints).T
    want = [(i, j) for i, j in np.argwhere(far + far.T <= simhash.DISTANCE).tolist() if i < j]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    together = sum(i in got and j in got and got[i].keep_id == got[j].keep_id for i, j in want)
    assert want and together >= 0.95 * len(want)
    true = parts(want)
    assert all(r.keep_id >= true[i] and true[i] == true[r.keep_id] for i, r in got.items())
    assert all(r.is_kept == (i == r.keep_id) for i, r in got.items())


@pytest.mark.parametrize("n", [500, 10_000, 1_000_000, 15_000_000])
def test_tables_meet_the_recall_at_the_full_distance_for_any_size(n):
    rng = np.random.default_rng(n)
    far = rng.permuted(np.tile(np.arange(simhash.BITS) < simhash.DISTANCE, (4000, 1)), axis=1)
    met = np.any([~far[:, order].any(axis=1) for order in simhash.layout(n)], axis=0)
    assert met.mean() > simhash.RECALL - 0.02


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.integers(0, 40)), min_size=1, max_size=60), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_gray_index_equals_all_pairs_in_a_bucket(rows, distance):
    rng = np.random.default_rng(1)
    bucket = np.array([b for b, _, _ in rows])
    hi = np.array([np.uint64(h & 0xFF) for _, h, _ in rows], np.uint64)
    lo = np.array([np.uint64(int(rng.integers(1 << 62)) & ((1 << k) - 1)) for _, _, k in rows], np.uint64)
    index = simhash.GrayIndex(bucket, hi, lo)
    a, b = index.pairs(np.arange(len(rows)), distance)
    got = {frozenset((int(index.order[x]), int(index.order[y]))) for x, y in zip(a, b)}
    want = {frozenset((i, j)) for i in range(len(rows)) for j in range(i) if bucket[i] == bucket[j] and int(np.bitwise_count(hi[i] ^ hi[j])) + int(np.bitwise_count(lo[i] ^ lo[j])) <= distance}
    assert got == want
    assert parts([tuple(p) for p in want if len(p) > 1]) == {x: r for x, r in parts([(int(x), int(y)) for x, y in zip(*index.forest(distance, 64))]).items()}


@pytest.mark.parametrize("seed", range(3))
def test_hot_buckets_cut_in_chunks_are_connected_like_whole_ones(spark, monkeypatch, seed):
    monkeypatch.setattr(buckets, "VISITORS", 7)
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 62, 12)
    rows = []
    for i in range(400):  # two thirds in one bucket, most of them near one centre
        bucket = 5 if i % 3 else int(rng.integers(0, 30))
        bits = sum(1 << int(b) for b in rng.choice(40, int(rng.integers(0, 4)), replace=False))
        rows.append((bucket, i, int(centres[0 if rng.random() < 0.6 else int(rng.integers(0, 12))] ^ bits), 0))
    want = [(a, b) for k, a, x, _ in rows for j, b, y, _ in rows if a < b and k == j and (x ^ y).bit_count() <= 3]

    def forest(table, known):
        bucket, hi, lo = (table.column(c).to_numpy() for c in ("bucket", "hi", "lo"))
        return simhash.GrayIndex(bucket, hi.view(np.uint64), lo.view(np.uint64)).forest(3, known=known)

    df = spark.createDataFrame(rows, "bucket bigint, id bigint, hi bigint, lo bigint")
    got = {r.node: r.root for r in buckets.connected(df, ["id"], forest, 15, 25).collect()}
    assert got == {x: r for x, r in parts(want).items() if x != r}


@given(st.lists(st.integers(0, 4), max_size=80), st.integers(1, 9), st.integers(1, 12), st.integers(0, 6))
@settings(max_examples=100, deadline=None)
def test_chunks_keep_order_and_mark_cuts(keys, size, chunk, more):
    keys = np.sort(np.array(keys, np.int64))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size])], names=["bucket"]) for i in range(0, len(keys), size)]
    got = list(buckets.chunks(iter(batches), chunk, chunk + more))
    assert [k for t, *_ in got for k in t.column(0).to_pylist()] == keys.tolist()
    assert all(t.num_rows <= chunk + more for t, *_ in got)
    assert not got or (got[0][1] and got[-1][2])
    for (t, _, cut), (u, opened, _) in zip(got, got[1:]):
        assert cut == opened == (t.column(0)[-1].as_py() == u.column(0)[0].as_py())


def test_codes_alone_leave_every_near_pair():
    rng = np.random.default_rng(9)
    x = clusters(rng, 400).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x @ embedding_dedup.rotation(64)
    second = embedding_dedup.rotation(64, 908)
    (bits, f), (other, g) = embedding_dedup.Codes.of(a), embedding_dedup.Codes.of(a @ second)
    pairs = embedding_dedup.Pairs(bits, other, f, g, embedding_dedup.COSINE, second)
    near = x @ x.T >= embedding_dedup.COSINE
    np.fill_diagonal(near, False)
    likely = pairs.likely(slice(0, len(x)), slice(0, len(x)))
    assert near.any() and likely[near].mean() > 0.99 and likely[~near].mean() < 0.05
    found = pairs.partnered(0, len(x))
    assert found[near.any(axis=1)].mean() > 0.99
    error = (pairs.x @ pairs.y.T - x @ x.T)[~np.eye(len(x), dtype=bool)]
    assert abs(error.mean()) < 2e-3


def test_fingerprints_of_similar_documents_are_near_and_of_others_far():
    """Over all pairs of sf0.1 that share words enough: word-triple Jaccard of 0.7 or more against the distance."""
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.1/documents.parquet' where text is not null").fetchall()
    triples, prints = [], []
    for _, t in rows:
        w = t.split()
        triples.append(frozenset(hash((a, b, c)) for a, b, c in zip(w, w[1:], w[2:])))
        prints.append(simhash.fingerprint(t) or bytes(16))
    codes = np.frombuffer(b"".join(prints), "<u8").reshape(-1, 2)
    size = np.array([len(t) for t in triples])
    order = np.argsort(size, kind="stable")
    rare = Counter(x for t in triples for x in t)
    index = defaultdict(list)
    similar = near = wrong = 0
    for i in order[np.searchsorted(size[order], 5) :].tolist():  # prefix filter: a pair of 0.7 shares one of the rarest triples of either
        own = sorted(triples[i], key=lambda x: (rare[x], x))
        seen = set()
        for x in own[: len(own) - int(np.ceil(0.7 * len(own))) + 1]:
            seen.update(j for j in index[x] if size[j] >= 0.7 * size[i])
            index[x].append(i)
        for j in seen:
            both = len(triples[i] & triples[j])
            if both >= 0.7 * (size[i] + size[j] - both):
                similar += 1
                near += int(np.bitwise_count(codes[i] ^ codes[j]).sum()) <= simhash.DISTANCE
    for i in range(0, len(codes), 500):
        far = np.bitwise_count(codes[i : i + 500, None, 0] ^ codes[None, :, 0]).astype(np.int16) + np.bitwise_count(codes[i : i + 500, None, 1] ^ codes[None, :, 1])
        for a, b in np.argwhere(far <= simhash.DISTANCE):
            a = int(a) + i
            if a < b and size[a] > 4 and size[b] > 4:
                both = len(triples[a] & triples[b])
                wrong += both < 0.4 * (size[a] + size[b] - both)
    assert similar > 1000 and near >= 0.99 * similar and wrong <= 0.01 * similar, (similar, near, wrong)
    print(similar, near, wrong)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    for i in range(300):
        g_hi, g_lo = simhash.gray_rank(np.array([0], np.uint64), np.array([i ^ (i >> 1)], np.uint64))
        assert (int(g_hi[0]), int(g_lo[0])) == (0, i)


def test_simhash_on_awkward_rows(spark):
    got = {r.doc_id: r.keep_id for r in simhash.near_duplicates(docs(spark, AWKWARD)).collect()}
    assert got == {1: 1, 7: 1}
    kept = simhash.drop_near_duplicates(docs(spark, AWKWARD))
    assert kept.columns == docs(spark, []).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def clusters(rng, n, dims=64):
    base = rng.standard_normal((n, dims))
    near = np.repeat(base[: n // 4], 3, axis=0) + 0.12 * rng.standard_normal((3 * (n // 4), dims))
    return np.concatenate([base, near]).astype(np.float32)


def test_embedding_groups_against_all_pairs(spark):
    x = clusters(np.random.default_rng(4), 300)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(i, j) for i, j in np.argwhere(unit @ unit.T >= embedding_dedup.COSINE).tolist() if i < j]
    got = {r.vec_id: r.keep_id for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist(), "r", 1) for i, v in enumerate(x)], VECTORS)).collect()}
    assert len(want) > 100 and sum(got.get(i, -1) == got.get(j, -2) for i, j in want) >= 0.95 * len(want)
    true = parts(want)
    assert all(true[i] == true[k] for i, k in got.items())


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ embedding_dedup.rotation(64)
    bits, factor = embedding_dedup.Codes.of(x[:1000])
    codes = embedding_dedup.Codes(bits, factor, 64)
    error = codes.estimates(np.arange(1000), x[1000:]) - x[:1000] @ x[1000:].T
    assert abs(error.mean()) < 1e-3
    assert (np.abs(error) <= codes.bound[:, None]).mean() > 0.999


ODD_VECTORS = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "a", 1), (2, None, "a", 1), (3, [], "a", 1), (4, [float("nan"), 1.0], "a", 1), (5, [1.0, 2.0, 3.0], "a", 1), (6, [0.0, 0.0], "a", 1), (None, [1.0, 0.0], "a", 1), (7, [2.0, 0.0], "a", 1), (8, [0.0, 1.0], "a", 1), (9, [None, 1.0], "a", 1)]


def test_vectors_on_awkward_rows(spark):
    odd = spark.createDataFrame(ODD_VECTORS, VECTORS)
    assert {r.vec_id: r.keep_id for r in embedding_dedup.near_duplicate_vectors(odd).collect()} == {1: 1, 7: 1}
    top = {(r.vec_id, r["rank"]): r.other_id for r in topk.top_products(odd, 2, 1).collect()}
    assert top == {(1, 1): 7, (1, 2): 6, (6, 1): 1, (6, 2): 7, (7, 1): 1, (7, 2): 6, (8, 1): 1, (8, 2): 6}
    assert embedding_dedup.near_duplicate_vectors(odd.limit(0)).count() == 0 and topk.top_products(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "part_bytes", "every"), [(2048, 8 << 20, 1), (64, 8000, 1), (16, 3000, 3)])
def test_top_products_equal_brute_force(spark, monkeypatch, block, part_bytes, every):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PART_BYTES", part_bytes)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 2)
    rng = np.random.default_rng(5)
    x = (clusters(rng, 200, 16) * rng.lognormal(0, 1, (350, 1))).astype(np.float32).astype(float)
    x[10] = x[11] = x[12]
    got = defaultdict(list)
    for r in topk.top_products(spark.createDataFrame([(i, v.tolist(), "r", 1) for i, v in enumerate(x)], VECTORS), every=every).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.other_id)
    product = np.round(x @ x.T, topk.PLACES)
    assert set(got) == {i for i in range(len(x)) if i % every == 0}
    for i in got:
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-product[i, j], j))[: topk.K]
        assert got[i] == want


def test_top_products_of_doubles_in_parts_of_few_ranges(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("PART_BYTES", 2000), ("MOST_RANGES", 3), ("QUERY_BLOCKS", 2), ("GROUPS", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.standard_normal((200, 8)), 2, axis=0) * (1 + 1e-8 * np.arange(400)[:, None])  # floats would tie
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r["rank"], r.other_id) for r in topk.top_products(vecs, every=3).collect()]
    product = np.round(x @ x.T, topk.PLACES)
    want = [sorted((j for j in range(400) if j != i), key=lambda j: (-product[i, j], j))[: topk.K] for i in range(0, 400, 3)]
    assert sorted(got) == [(3 * n, at + 1, j) for n, others in enumerate(want) for at, j in enumerate(others)]


LITTLE_DRIVER = """
from pyspark.sql import SparkSession, functions as F
from loomtext.llm import topk
spark = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "3m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 4).getOrCreate()
vecs = spark.range(0, 64_000, 1, 64).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, 64), i -> float(sin(id * 64 + i)))").alias("embedding"))
print("rows", topk.top_products(vecs, every=6400).count())
"""


def test_top_products_send_no_vectors_of_every_partition_to_the_driver():
    said = subprocess.run([sys.executable, "-B", "-c", LITTLE_DRIVER], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert "rows 100" in said.stdout, said.stderr[-800:]


def test_lengths_leave_most_blocks_out():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 16)) * rng.lognormal(0, 1.5, (20_000, 1))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    now = topk.Running(np.arange(20_000, 20_100), rng.standard_normal((100, 16)), 10)
    met = [now.meet(np.arange(at, at + 500), x[at : at + 500]) for at in range(0, 20_000, 500)]
    assert met == sorted(met, reverse=True) and sum(met) < 15 and now.products < 0.1 * 100 * 20_000


def test_mixture_sizes_expectations_and_awkward_rows(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 3000), rng.choice("aaaaabbc")) for i in range(600)]
    n = Counter(s for _, _, s in rows)
    taken = mixing.mix(docs(spark, rows), 300, {"a": 1, "b": 2, "c": 3})
    assert {r.source: r.n for r in taken.groupBy("source").agg({"__copies": "sum"}).toDF("source", "n").collect()} == {"a": 50, "b": 100, "c": 150}
    by_id = {r.doc_id: r["__copies"] for r in taken.select("doc_id", "__copies").collect()}
    x = {i: len(t).bit_length() for i, t, _ in rows}
    for s, size in (("a", 50), ("b", 100), ("c", 150)):
        total = sum(x[i] for i, _, t in rows if t == s)
        assert all(by_id[i] - size * x[i] // total in (0, 1) for i, _, t in rows if t == s)
    inclusion = Counter()
    for seed in range(6):
        inclusion.update(r.doc_id for r in mixing.mix(docs(spark, rows), 300, {"a": 1}, f"s{seed}").where("__copies > 0").select("doc_id").collect())
    assert sum(inclusion.values()) == 6 * min(300, n["a"])
    odd = mixing.mixed(docs(spark, AWKWARD))
    assert odd.columns == docs(spark, []).columns
    assert not {2, 3} & {r.doc_id for r in odd.collect()}
    assert mixing.mixed(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, AWKWARD), 5, {}).where("__copies > 0").count() == 0


def test_packing_fills_sequences_with_every_token_once(spark):
    rng = random.Random(1)
    rows = [*((i + 100, prose(rng, rng.randrange(1, 600)), "s") for i in range(120)), *AWKWARD]
    got = packing.pack(docs(spark, rows), 256).collect()
    spans, fill = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.token_start, r.token_end))
        fill[r.sequence_id].append((r.position, r.token_end - r.token_start))
    tokens = Counter()
    for i, t, _ in rows:
        tokens[i] += CODER.count(t) if t else 0
    assert {i: sum(e - s for s, e in v) for i, v in spans.items()} == {i: n for i, n in tokens.items() if n}
    for k, pieces in fill.items():
        at = 0
        for position, n in sorted(pieces):
            assert position == at
            at += n
        assert at == 256 or k == max(fill)
    keys = [r.key for r in sorted(got, key=lambda r: (r.sequence_id, r.position))]
    assert keys == sorted(keys)
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_equals_filling_documents_one_by_one(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(0, 400)) if i % 9 else None, "s") for i in range(80)] + [(3, "same", "s")] * 3
    line = []
    for i, t, _ in rows:
        if t and CODER.count(t):
            cell = packing.grid(packing.vectors([t]))
            line.append((int(packing.hilbert(cell)[0]), i, CODER.count(t)))
    want, seq, at = [], 0, 0
    for key, i, n in sorted(line):
        start = 0
        while start < n:
            take = min(n - start, 100 - at)
            want.append((seq, at, i, start, start + take, key))
            start, at = start + take, at + take
            if at == 100:
                seq, at = seq + 1, 0
    got = packing.pack(docs(spark, rows), 100).select("sequence_id", "position", "doc_id", "token_start", "token_end", "key").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hilbert_keys_are_a_walk_through_neighbouring_cells():
    depth = 3
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = cells[np.argsort(packing.hilbert(cells, depth))]
    assert sorted(packing.hilbert(cells, depth)) == list(range(512))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("entries", [1000, 50])
def test_token_store_round_trip(spark, tmp_path, entries):
    rng = random.Random(6)
    rows = [*((rng.randrange(-(1 << 62), 1 << 62), prose(rng, rng.randrange(1, 300)), "s") for _ in range(400)), *((77, f"copy {i}", "s") for i in range(200)), *AWKWARD]
    token_ids.write_files(token_ids.token_files(docs(spark, rows), blocks=3, shard_bytes=20_000, file_entries=entries), str(tmp_path))
    store = token_ids.TokenStore(str(tmp_path))
    want = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            want[i].append(None if t is None else CODER.encoding.encode_ordinary(t))
    for i, lists in want.items():
        got = [None if a is None else a.tolist() for a in store.get(i)]
        assert sorted(got, key=repr) == sorted(lists, key=repr)
    assert sum(bool(store.get(rng.randrange(1 << 62))) for _ in range(2000)) == 0
    assert token_ids.token_files(docs(spark, [])).count() == 0


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=300, unique=True))
@settings(max_examples=30, deadline=None)
def test_index_is_minimal_and_perfect(keys):
    k = np.array(keys, np.int64)
    block = token_ids.IndexBlock(token_ids.build_index(k, np.arange(len(k)), np.arange(len(k)) * 2, np.arange(len(k)) * 3))
    slots = token_ids._slots(k.view(np.uint64), block.sizes, block.bits, block.ranks)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert all(block.find(x) == [(i, 2 * i, 3 * i)] for i, x in enumerate(keys))


@pytest.mark.parametrize("name", ["op2_embedding_near_duplicates", "embedding_copies_near_duplicates", "op3_mixture", "op8_top_products"])
def test_queries_against_sql(spark, name):
    from loomtext.llm.queries import ORACLES, QUERIES

    assert oracle.difference(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) == ""


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {"start": now.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        assert name == "packing" or out.columns == now.columns
        now = spark.createDataFrame(seen.setdefault(name, out.toPandas()))
    assert set(seen["toxicity"].doc_id) <= set(seen["start"].doc_id)
    gone = set(seen["toxicity"].doc_id) - set(seen["simhash"].doc_id)
    groups = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(seen["toxicity"])).collect()}
    assert gone == {i for i, r in groups.items() if not r.is_kept}
    before = dict(zip(seen["simhash"].doc_id, seen["simhash"].text))
    assert all(t == pii.redact(before[i]) for i, t in zip(seen["pii"].doc_id, seen["pii"].text))
    assert len(seen["mixing"]) == (seen["pii"].text.str.len() > 0).sum()
    tokens = Counter()
    for i, t in zip(seen["mixing"].doc_id, seen["mixing"].text):
        tokens[i] += CODER.count(t)
    packed = Counter()
    for r in seen["packing"].itertuples():
        packed[r.doc_id] += r.token_end - r.token_start
    assert packed == tokens
    assert LONG
    assert corpus_pipeline.run(spark, sf).count() == len(seen["packing"])
