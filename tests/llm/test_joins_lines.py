import hashlib
import random
import re

import numpy as np
import pyarrow.compute as pc
import pytest

from ledgerloom.llm import jaccard, linededup
from ledgerloom.llm.common import Workspace, join_hot_apart, without_keys
from ledgerloom.llm.components import components

from .helpers import ODD, odd_documents, saved


def brute_components(docs, n, num, den):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = {}
    for name, text in docs:
        w = words(text)
        sets[name] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def cloud(seed, size, edits):
    """Near copies of a few texts at distances around the threshold, short texts, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for b in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 200]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.2:
                own += passage
            docs.append(" ".join(own))
    docs += [" ".join(passage + [f"y{i}" for i in range(rng.randrange(30))]) for _ in range(size)]
    docs += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6))) for _ in range(size)]
    docs += rng.sample(docs, 20)
    return [*enumerate(docs)]


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (3, 50)])
def test_jaccard_components(spark, n, num):
    docs = cloud(n, 40, 9)
    got = jaccard.Join(spark, spark.createDataFrame(docs, "doc_id long, text string"), n, num, 100).components()
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_components(docs, n, num, 100)


def joined_rows(spark, run):
    """What each join of the queries that ``run`` starts has put out, by Spark's own metrics."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = []
    for i in range(store.executionsList().size()):
        e = store.executionsList().apply(i)
        if e.executionId() not in before:
            values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
            for k in range(nodes.size()):
                if "Join" in nodes.apply(k).name():
                    metrics = nodes.apply(k).metrics()
                    for m in range(metrics.size()):
                        if metrics.apply(m).name() == "number of output rows":
                            found = values.get(metrics.apply(m).accumulatorId())
                            made.append(int(found.get().replace(",", "")) if found.isDefined() else 0)
    return out, made


@pytest.mark.parametrize("size", [500, 2000])
def test_a_large_group_of_near_copies_makes_few_pairs(spark, size):
    rng = random.Random(size)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(size):  # 0 to 9 words changed: pairs lie around 0.85
        own = list(base)
        for _ in range(rng.randrange(10)):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got, made = joined_rows(spark, lambda: {r[0]: (r[1], r[2]) for r in jaccard.Join(spark, frame, 4, 85, 100).components().collect()})
    if size <= 500:
        assert got == brute_components(docs, 4, 85, 100)
    assert made and max(made) <= 120 * size, max(made)


def test_jaccard_over_the_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: (r[1], r[2]) for r in jaccard.op4_prefix_join(spark, sf_dir).collect()} == brute_components(docs, 4, 85, 100)


def test_jaccard_odd_rows(spark, tmp_path):
    rows = jaccard.op4_prefix_join(spark, saved(odd_documents(spark), tmp_path)).collect()
    want = brute_components([(d[0], d[1]) for d in ODD if d[0] is not None], 4, 85, 100)
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["component_id"] is None if r["doc_id"] is None else (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.op4_prefix_join(spark, saved(odd_documents(spark, True), tmp_path)).count() == 0


def test_filters_never_reject_similar_sets():
    rng = np.random.default_rng(2)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        a = np.unique(np.concatenate([rng.choice(base, rng.integers(100, 200), replace=False), rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        b = np.unique(np.concatenate([rng.choice(base, rng.integers(100, 200), replace=False), rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert jaccard.suffix_distance(a, b) <= apart
        odd = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(jaccard.parities(a), jaccard.parities(b), strict=True))
        assert odd <= apart
        assert (jaccard._long(jaccard._short(a)) == a >> np.uint64(16)).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(500 + rng.randrange(40), 500 + rng.randrange(40)) for _ in range(30)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for few in (0, 10**6):
        got = components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long"), "t", few).collect()
        assert {r[0]: r[1] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
        assert components(Workspace(spark, "t"), spark.createDataFrame([(1, 1)], "u long, v long").limit(0), "t", few).count() == 0


def brute_lines(docs):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")]
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    held = {}
    for name, text in docs:
        for k in keys(text):
            if len(k) >= 10 and name is not None:
                held.setdefault(low(k), set()).add(name)
    out = []
    for name, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x, k in zip(lines, keys(text), strict=True) if name is None or len(held.get(low(k), ())) < 2 or len(k) < 10 or name == min(held[low(k)])]
        out.append((name, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = [(5, "A shared line here\nown line of five\nA shared line here"), (3, "  a SHARED line here \t\nown"), (9, "a shared line here"), (9, "a shared line here"), (7, "own line of seven\n\n\nÄÖ shared éé line"), (8, "äÖ shared éé line\nÄÖ shared éé line"), (1, None), (2, ""), (None, "a shared line here")]


def test_line_dedup(spark, sf_dir, tmp_path):
    for folder in (sf_dir, saved(odd_documents(spark), tmp_path), saved(spark.createDataFrame(LINES, "doc_id long, text string"), tmp_path)):
        docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        assert sorted((tuple(r) for r in linededup.op2_cuckoo_lines(spark, folder).collect()), key=str) == brute_lines(docs)
    assert linededup.op2_cuckoo_lines(spark, saved(odd_documents(spark, True), tmp_path)).count() == 0


@pytest.mark.parametrize(("broadcast", "probes", "keys"), [(0, 7, 250_000), (1 << 24, 2_000_000, 30)])
def test_inserts_and_deletes_leave_the_same_index(spark, monkeypatch, broadcast, probes, keys):
    monkeypatch.setattr(linededup, "BROADCAST", broadcast)
    monkeypatch.setattr(linededup, "PROBES", probes)
    monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
    monkeypatch.setattr(linededup, "SHARDS", 4)
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["", f"common line {rng.randrange(30)}", f"line of its own {i} {rng.randrange(9)}"]) for _ in range(12))) for i in range(60)]
    frame = lambda xs: spark.createDataFrame(xs, "doc_id long, text string")
    index = linededup.LineIndex(spark)
    for a, b in ((0, 20), (20, 45), (45, 60)):
        index.insert(frame(docs[a:b]))
    assert index.shards == 4 if keys > 1000 else index.shards > 4
    gone = docs[0:5] + docs[30:40]
    index.delete(frame(gone))
    left = [d for d in docs if d not in gone]
    whole = linededup.LineIndex(spark)
    whole.insert(frame(left))
    refs = lambda x: sorted((bytes(r["key"]), r["refs"], r["owner"]) for r in x.refs.collect())
    assert refs(index) == refs(whole)
    rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in index.apply(frame(left)).collect()]
    assert sorted(rows, key=str) == brute_lines(left)
    prints = {r["shard"]: linededup.CuckooFilter(r["buckets"], bytes(r["cells"])) for r in index.seen.collect()}
    assert sum(int((f.cells > 0).sum()) for f in prints.values()) == len(refs(index))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(10, "one shared line", "a", "b", 5, "c"), (11, "One shared line \nown", "a", "b", 6, "d")], "id long, body string, owner string, Gone string, doc_id int, text string")
    index = linededup.LineIndex(spark, "id", "body")
    index.insert(docs)
    out = index.apply(docs, other_columns=True)
    assert out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) == [(10, "one shared line", "a", "b", 5, "c"), (11, "own", "a", "b", 6, "d")]


def test_cuckoo_filter():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    f = linededup.CuckooFilter.of(keys)
    assert f.may_have(keys).all() and int((f.cells > 0).sum()) == len(keys)
    other = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    assert f.may_have(other).mean() < 0.001
    f.remove(keys[:5000])
    assert f.may_have(keys[5000:]).all() and f.may_have(keys[:5000]).mean() < 0.001
    assert not linededup.CuckooFilter(4).add(keys[:100])


def test_hot_joins_and_few_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(i, 0) for i in range(2, 9)] + [(None, 1)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (77, "c")], "k int, y string")
    want = sorted(map(str, left.join(right, "k", "left").collect()))
    assert sorted(map(str, join_hot_apart(left, right, "k", 3).collect())) == want
    kept = without_keys(left, right, "k", 0).collect()
    assert len(kept) == 7 and len(without_keys(left, right, "k").collect()) == 7


def test_shingles_of_few_members_are_looked_at_once(spark, monkeypatch):
    """Their pairs are made in one join; no round carries their rows along."""
    carried, real = {}, jaccard.Workspace.table

    def table(self, name, df, codec="zstd"):
        out = real(self, name, df, codec)
        if name.startswith("state-") and "token" in out.columns:
            carried[name] = out.count()
        return out

    monkeypatch.setattr(jaccard.Workspace, "table", table)
    words = [f"w{i}" for i in range(40)]
    docs = [(10 * g + i, " ".join(f"{w}g{g}" for w in words) + f" end{g}x{i}") for g in range(12) for i in range(3)]
    docs += [(1000 + g, " ".join(f"{w}g{g}" for w in words[:20]) + f" other{g} " * 20) for g in range(12)]
    got = {r[0]: r[2] for r in jaccard.Join(spark, spark.createDataFrame(docs, "doc_id long, text string"), 4, 85, 100).components().collect()}
    assert got == {d: d if d >= 1000 else d // 10 * 10 for d, _ in docs}
    assert not any(carried.values())


def test_shingles_of_one_document_are_not_dealt_back(spark, monkeypatch):
    """A batch is thousands of documents, so rows don't grow with batches times ranges; what occurs once isn't sent back to it."""
    made, counted, real = {}, [], jaccard.Workspace.table

    def table(self, name, df, codec="zstd"):
        made[name] = real(self, name, df, codec)
        return made[name]

    monkeypatch.setattr(jaccard.Workspace, "table", table)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(2000)] + [(5000 + i, " ".join(f"same{j}" for j in range(40)) + f" end{i}") for i in range(2)]
    join = jaccard.Join(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 4, 85, 100)
    _, prefixes = join.prefixes()
    assert made["sets"].count() <= 1 + 4 and {r[0] for r in prefixes.select("doc_id").collect()} == {5000, 5001}
    parts = made["sets"].where("part >= 0").toArrow().select(["batch", "part", "held"])
    for p in range(4):
        found = jaccard._count(parts.filter(pc.equal(parts["part"], p)))
        counted += [c for x in found["counts"].to_pylist() for c in np.frombuffer(x, "<u4").tolist()]
    assert counted and set(counted) == {2}
