import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, tokenfile
from ledgerloom.llm.common import rows
from ledgerloom.llm.tokens import ChunkIds, word_vocabulary

from .helpers import ODD, odd_documents, saved


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(word_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


STRANGE = ["á ́b", "İ ſ K ﬁ", "don't I'LL 've", "<|endoftext|>x <|startoftext|>", "\x1c\x85 tab\tx", "한글 각", "1234 ½ ²", "  ", "a" * 5000, None, "", "Ä×Ö÷ß É", "a<b>c", "É" * 8, "É" * 9, "!" * 17, "ÀÁ...--##", "zzxqjkwvzzxqjkwv " * 3]


def check_encoder(ids_of, texts, plain):
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        ids, cuts = ids_of.encode(pa.array(part, pa.string()))
        for text, a, b in zip(part, cuts, cuts[1:], strict=False):
            assert [*ids[a:b].tolist(), 1] == plain(text), text


@pytest.mark.parametrize("sets", [2, 1 << 16])
def test_runs_give_the_librarys_ids(spark, sf_dir, plain, sets):
    ids_of = ChunkIds(word_vocabulary(), sets)
    assert ids_of.plain
    rng = random.Random(4)
    letters = "ab cdEFÉéßÿ×÷'<|>.,-_!1\n\t\u6f22\u0301"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    check_encoder(ids_of, STRANGE + made + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:150], plain)
    ids_of.plain = False
    check_encoder(ids_of, STRANGE, plain)


def test_a_worker_remembers_in_a_fixed_space():
    ids_of = ChunkIds(word_vocabulary())
    before = ids_of.memory.nbytes
    assert before <= 16 << 20
    marks = ["word" + "!?" * 5000 + str(i) for i in range(20)]
    for at in range(5):
        ids_of.encode(pa.array(marks + [f"w{chr(97 + at)}" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(20000)], pa.string()))
    assert ids_of.memory.nbytes == before
    held = [x for x in vars(ids_of).values() if isinstance(x, (dict, list))]
    assert held == []


def test_batches_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 500, "z" * 90, "z" * 10, ""], pa.string())], ["i", "text"])
    parts = list(rows([batch, batch.slice(0, 0)], 4, most=100))
    assert [p.column("i").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert [p.num_rows for p in rows([batch.select(["i"])], 4)] == [4, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check_ids(spark, folder, plain):
    docs = sorted(((r["doc_id"] is not None, r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=lambda d: (d[0], d[1] or 0, np.array(d[2], "<u2").tobytes()))
    want, at = [], 0
    for _, name, ids in docs:
        want.append((name, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in tokenfile.op5_huffman_ids(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_ids_files_round_trip(spark, sf_dir, plain, tmp_path):
    check_ids(spark, sf_dir, plain)
    check_ids(spark, saved(odd_documents(spark), tmp_path), plain)


def test_ids_of_an_empty_table(spark, tmp_path):
    assert tokenfile.op5_huffman_ids(spark, saved(odd_documents(spark, True), tmp_path)).count() == 0


def test_code_lengths_are_limited_and_optimal():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = tokenfile.code_lengths(np.array([0, *fib]), 8)
    assert lengths[0] == 0 and lengths.max() == 8
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1
    free = tokenfile.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 18)
    assert free.tolist() == [4, 4, 3, 3, 3, 1]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70001])
def test_blocks_decode_alone_and_together(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 5000).astype(np.uint16)
    counts = np.bincount(ids, minlength=5000)
    lengths = tokenfile.code_lengths(counts)
    codes, table = tokenfile.canonical_codes(lengths), tokenfile.decoding_table(lengths)
    payload, checks = tokenfile.encode_block(ids, codes, lengths)
    one, two = ids[:100], ids[: n // 2]
    blocks = [tokenfile.encode_block(x, codes, lengths) for x in (ids, one, two)]
    for x, y in zip((ids, one, two), tokenfile.decode_blocks([b[0] for b in blocks], [b[1] for b in blocks], [len(ids), len(one), len(two)], table), strict=True):
        assert (x == y).all()
    assert (tokenfile.decode_blocks([payload], [checks], [n], table)[0] == ids).all()


def check_packing(rows, docs, plain):
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"]), []).append(r)
    want = []
    for name, text in docs:
        ids = plain(text)
        want += [(name, p, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for p, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_places_every_piece(spark, sf_dir, plain, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(packing.op6_genetic_packing(spark, sf_dir).collect(), docs, plain)
    odd = packing.op6_genetic_packing(spark, saved(odd_documents(spark), tmp_path)).collect()
    check_packing(odd, [(d[0], d[1]) for d in ODD], plain)


def test_packing_over_levels(spark, sf_dir, plain, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 20)
    monkeypatch.setattr(packing, "FAN", 3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(packing.op6_genetic_packing(spark, sf_dir).collect(), docs, plain)


def test_packing_of_an_empty_table(spark, tmp_path):
    assert packing.op6_genetic_packing(spark, saved(odd_documents(spark, True), tmp_path)).count() == 0


def test_genetic_steps_beat_best_fit_decreasing():
    rng, plain_bins, evolved = np.random.default_rng(3), 0, 0
    for seed in range(12):
        sizes = []
        for _ in range(8):  # triplets that fill a bin exactly
            a = int(rng.integers(380, 490))
            b = int(rng.integers(max(251, 1000 - a - 370), min(499, 1000 - a - 251)))
            sizes += [a, b, 1000 - a - b]
        plain_bins += len(packing.best_fit(list(range(len(sizes))), sizes, [], 1000))
        found = packing.evolve(sizes, 1000, [], np.random.default_rng(seed), 300)[0]
        assert sorted(i for b in found for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 1000 for b in found)
        evolved += len(found)
    print(plain_bins, evolved)
    assert evolved < plain_bins
