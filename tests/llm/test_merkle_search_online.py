import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import merkle, search, sumsquares
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES
from ledgerloom.llm.sumsquares import Levels, Piece, close, fill, pack_online
from ledgerloom.llm.tokens import word_vocabulary

from .helpers import odd_documents, saved


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    return sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_impact_search"])
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert same(got[sorted(got.columns)].itertuples(index=False, name=None), want[sorted(got.columns)].itertuples(index=False, name=None))


# Merkle manifest


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def manifest_of(rows):
    groups = defaultdict(list)
    for r in rows:
        own, changed = ("".join(shown(x[c]) for c in merkle.FIELDS) for x in (r, r | {"n_chars": None if r["n_chars"] is None else r["n_chars"] + 1}))
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, digest(own), digest(changed if hit else own)))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(groups[k])]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    for at, k in enumerate(names):
        for place, (known, name, leaf, changed) in enumerate(sorted(groups[k])):
            siblings = []
            for levels, pos in ((trees[k], place), (top, at)):
                for nodes in levels[:-1]:
                    siblings.append(nodes[pos ^ 1] if pos ^ 1 < len(nodes) else "")
                    changed = digest(siblings[-1] + changed if pos & 1 else changed + siblings[-1])
                    pos >>= 1
            yield name if known else None, leaf, trees[k][-1][0], top[-1][0], digest("".join(siblings)), changed, changed == top[-1][0]


@pytest.mark.parametrize(("bucket", "few"), [(2, 0), (4, 4096), (4096, 0)])
def test_manifest_of_odd_rows(spark, bucket, few):
    docs = odd_documents(spark).withColumnsRenamed({"shard": "bucket"}).selectExpr("*", "1 as tree", "2 as id", "3 as leaf")
    assert same(merkle.manifest(spark, docs, bucket, few).collect(), manifest_of([r.asDict() for r in docs.collect()]))


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2, 3, 1], [8, 9, 7, 17], [33]])
def test_manifest_of_groups_of_any_size(spark, sizes):
    rows = [(100 * g + i, f"src{i % 3}", None if g == 2 else f"l{g}", i, "same" if i % 2 else None) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(spark, docs, 8).collect()
    assert same(got, manifest_of([r.asDict() for r in docs.collect()]))
    assert {r["verified"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7} <= {True}
    assert not any(r["verified"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark, odd_documents(spark, True)).collect() == []


# Search


def ranking_of(documents, items, top=10):
    """All scores by the definition, with dictionaries."""
    terms_of = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    docs = [(name, Counter(t), len(t)) for name, text in documents if (t := terms_of(text))]
    df, total = Counter(t for _, c, _ in docs for t in c), sum(n for _, _, n in docs)
    for item, text in items:
        scores = []
        for name, counts, n in docs:
            m = 25 + 75 * n * len(docs) // total
            scores.append(sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms_of(text) if t in counts))
        order = sorted(((-s, d[0] is not None, d[0] or 0) for s, d in zip(scores, docs, strict=True) if s > 0))[:top]
        yield from ((item, rank, name if known else None, -s) for rank, (s, known, name) in enumerate(order, 1))


QUESTIONS = [(1, "the last line"), (2, None), (3, ""), (4, "!!"), (5, "x X x"), (6, "İSTANBUL ſecret abc123xyz"), (7, "a b c a"), (7, "a b c a"), (8, "nowhere")]


@pytest.mark.parametrize(("shard", "block"), [(8 << 20, 1 << 20), (20, 150)])
def test_search_of_odd_rows(spark, shard, block):
    docs = odd_documents(spark).selectExpr("*", "1 as ids", "2 as terms", "3 as item_id")
    items = spark.createDataFrame(QUESTIONS, "item_id long, text string").selectExpr("*", "0 as doc_id", "0 as score", "0 as rank")
    got = search.Index(spark, docs, shard=shard).search(items, block=block).drop("uid").collect()
    assert same(got, ranking_of([(r["doc_id"], r["text"]) for r in docs.collect()], QUESTIONS))


def test_search_keeps_ties_in_order(spark):
    texts = [(i, "common word") for i in range(300, 0, -1)] + [(1000, "word"), (1001, "other text of some length")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    items = [(1, "word"), (2, "common other")]
    got = search.Index(spark, docs, shard=200).search(spark.createDataFrame(items, "item_id long, text string")).drop("uid").collect()
    assert same(got, ranking_of(texts, items))


def test_search_matches_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert same(QUERIES["op12_impact_search"](spark, sf_dir).collect(), ranking_of(docs, items))


def test_search_of_nothing(spark):
    none, some = odd_documents(spark, True), spark.createDataFrame(QUESTIONS, "item_id long, text string")
    assert search.Index(spark, none).search(some).collect() == []
    assert search.Index(spark, odd_documents(spark)).search(some.limit(0)).collect() == []


def test_impacts_beyond_64_bits():
    lengths, documents, terms = np.array([1, 1 << 30]), 1 << 36, 1 << 45
    want = [1000000000 * 3 // (3000 + 8 * (25 + 75 * n * documents // terms)) for n in lengths.tolist()]
    assert search.impacts(np.array([3, 3]), lengths, documents, terms).tolist() == want


@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_best_is_safe_with_ties(scores, top):
    ids = np.array(random.Random(len(scores)).sample(range(100), len(scores)), np.int64)
    got = search.best(np.array(scores, np.int64), ids, top)
    want = sorted((-s, i) for s, i in zip(scores, ids.tolist(), strict=True) if s > 0)[:top]
    assert [(-s, i) for s, i in zip(got[0].tolist(), got[1].tolist(), strict=True)] == want


# Online packing


def squares(windows, capacity):
    return sum(n * n for f, n in Counter(windows).items() if 0 < f < capacity)


@given(st.lists(st.integers(1, 31), max_size=80))
@settings(max_examples=150, deadline=None)
def test_a_piece_goes_where_the_sum_of_squares_grows_least(sizes):
    levels, mine = Levels(32), []
    for k, size in enumerate(sizes):
        choices = {0} | {f for f in mine if f + size <= 32}
        cost = {f: squares([*mine, size] if f == 0 else [*[x for x in mine if x != f], *[f] * (mine.count(f) - 1), f + size], 32) for f in choices}
        at = levels.level(size)
        assert at == max(f for f in choices if cost[f] == min(cost.values()))
        if at:
            mine.remove(at)
        if at + size < 32:
            mine.append(at + size)
        levels.place(Piece(k, 0, size, np.zeros(size, np.uint16)))
        assert Counter(mine) == Counter({f: int(n) for f, n in enumerate(levels.counts) if n})
        assert levels.tokens == sum(mine)


@given(st.lists(st.lists(st.integers(1, 10), min_size=1, max_size=4), max_size=12))
@settings(max_examples=150, deadline=None)
def test_closed_windows_need_no_padding(windows):
    windows = [w for w in windows if sum(w) < 64]
    made = [[Piece(f"{i}-{k}", 0, n, np.arange(n) + 100 * i) for k, n in enumerate(w)] for i, w in enumerate(windows)]
    out = close(sorted(made, key=fill, reverse=True), 64)
    assert all(fill(w).bit_count() == 1 and fill(w) <= 64 for w in out)
    rest = sorted((p.doc_id, p.start, len(p.ids)) for w in out for p in w)
    ends = defaultdict(int)
    for name, start, n in rest:
        assert start == ends[name] and n > 0
        ends[name] += n
    assert ends == {f"{i}-{k}": n for i, w in enumerate(windows) for k, n in enumerate(w)}


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(word_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, texts, ids_of, capacity):
    """Every id in one piece, sequences gapless, no padding; texts may repeat, also with their ids."""
    left, sequences, starts = Counter((name, tuple(ids_of(t))) for name, t in texts), defaultdict(list), defaultdict(Counter)
    known = defaultdict(list)
    for name, ids in left:
        known[name].append(ids)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        fits = [i for i in known[r["doc_id"]] if len(i) == r["doc_tokens"] and crc(i[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]]
        assert fits and r["length"] > 0 and r["start"] + r["length"] <= r["doc_tokens"]
        starts[r["doc_id"], fits[0]].update(range(r["start"], r["start"] + r["length"]))
    for key, times in left.items():
        assert starts[key] == Counter(dict.fromkeys(range(len(key[1])), times))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at.bit_count() == 1 and at < capacity
    return len(sequences)


@pytest.mark.parametrize(("capacity", "cell"), [(64, 1 << 8), (2048, 1 << 22)])
def test_packing_of_odd_rows(spark, ids_of, capacity, cell):
    docs = odd_documents(spark).selectExpr("*", "1 as uid", "2 as cell", "3 as ids")
    check_packing(pack_online(spark, docs, word_vocabulary(), capacity, cell=cell).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], ids_of, capacity)


def test_packing_query(spark, sf_dir, ids_of):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = QUERIES["op13_sum_of_squares"](spark, sf_dir)
    assert {t for c, t in rows.dtypes} == {"bigint"}
    sequences = check_packing(rows.collect(), texts, ids_of, 2048)
    assert sequences <= -(-sum(len(ids_of(t)) for _, t in texts) // 2048) + 11


def test_sizes_that_never_fit_are_held_in_bounded_windows(spark, ids_of):
    texts = [(i, " ".join(["word"] * 40)) for i in range(500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    sequences = check_packing(pack_online(spark, docs, word_vocabulary(), 64, cell=640).collect(), texts, ids_of, 64)
    assert sequences <= 500 * 41 / 64 + 6 * (500 * 41 / 640 + 1)
    held = []
    placed = sumsquares._online(word_vocabulary(), 64, 1, 640)
    import pyspark

    class Here:
        partitionId = staticmethod(lambda: 0)

    old, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(lambda: Here)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts])], ["doc_id", "text"])
        held = [b for b in placed(iter([batch]))]
    finally:
        pyspark.TaskContext.get = old
    assert sum(b.num_rows for b in held) == 500


def test_packing_of_nothing(spark, tmp_path):
    assert QUERIES["op13_sum_of_squares"](spark, saved(odd_documents(spark, True), tmp_path)).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        pack_online(spark, odd_documents(spark), word_vocabulary(), 100)
