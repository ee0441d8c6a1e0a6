import hashlib
import random
import re
import time

import numpy as np

import corpus_pipeline
from ledgerloom.llm import decontamination as dc
from ledgerloom.llm import language

from .helpers import ODD, odd_documents, saved


def brute_tiles(item, text, least):
    """Greedy string tiling by its definition: the longest free common run first."""
    a, b, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        a[i : i + k] = b[j : j + k] = [True] * k
        out.append(best)


def test_tiles_match_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.randrange(40) for _ in range(rng.randrange(3, 40))]
        text = [rng.randrange(40) for _ in range(20)]
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(item))
            text += item[i : i + rng.randrange(3, 20)] + [rng.randrange(40)]
        got = dc.tiles(np.array(item), np.array(text), 3)
        assert sum(k for _, _, k in got) == sum(k for k, _, _ in brute_tiles(item, text, 3))
        for i, j, k in got:
            assert item[i : i + k] == text[j : j + k]


def test_tiles_of_repetitive_texts():
    rng = random.Random(8)
    for _ in range(40):
        item = [rng.randrange(2) for _ in range(rng.randrange(5, 30))]
        text = [rng.randrange(-1, 2) for _ in range(rng.randrange(5, 40))]
        assert dc.tiles(np.array(item), np.array(text), 3) == [(i, j, k) for k, i, j in brute_tiles(item, [x if x >= 0 else -9 - n for n, x in enumerate(text)], 3)]


def test_leaks_match_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        items = [(k, " ".join(str(rng.randrange(9)) for _ in range(rng.randrange(3, 30)))) for k in range(12)]
        text = []
        for _ in range(rng.randrange(6)):
            w = items[rng.randrange(12)][1].split()
            at = rng.randrange(len(w))
            text += w[at : at + rng.randrange(3, 25)] + [str(rng.randrange(12))]
        want = []
        for k, item in items:
            w = item.split()
            tiled = sum(n for n, _, _ in brute_tiles(w, text, 5))
            if len(w) >= 5 and tiled >= 0.6 * len(w):
                want.append((k, len(w), tiled))
        assert [x[:3] for x in dc.Index(items).leaks(" ".join(text), 0.6)] == want


def test_costly_benchmarks():
    shared = " ".join(f"s{i}" for i in range(200))
    rng = random.Random(7)
    index = dc.Index([(k, f"{shared} " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(300))) for k in range(2000)])
    long = [f"w{i}" for i in range(4000)]
    swapped = dc.Index([(1, " ".join(long))])
    same = dc.Index([(1, "la " * 2000)])
    for found, text, want in ((index, " ".join(shared.split()[:10]), 0), (index, shared, 0), (swapped, " ".join(long[2000:] + long[:2000]), 4000), (same, "la " * 2000, 2000)):
        least = 9.0
        for _ in range(3):
            began = time.process_time()
            leaks = found.leaks(text, 0.6)
            least = min(least, time.process_time() - began)
        assert [x[2] for x in leaks] == [want] * bool(want)
        assert least < 0.3, least


def test_reordered_passages_leak():
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    index = dc.Index([(1, item), (2, "too short item"), (3, None)])
    moved = "Before it. " + " ".join(w[8:]).upper() + "; then other words come, and " + " ".join(w[:8]) + " at last"
    assert [x[:3] for x in index.leaks(moved, 0.6)] == [(1, 16, 16)]
    assert index.leaks("one two three four five and nothing else of it", 0.6) == [] and index.leaks("", 0.6) == []
    assert index.leaks(" ".join(w[::-1]), 0.6) == []


def test_leaks_over_the_table(spark, sf_dir):
    items = [(r["item_id"], dc.words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = dc.words(r["text"])
        runs = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for name, words in items:
            if any(tuple(words[i : i + 5]) in runs for i in range(len(words) - 4)):
                tiled = sum(k for k, _, _ in brute_tiles(words, text, 5))
                if tiled >= 0.6 * len(words):
                    want.add((r["doc_id"], name, tiled))
    got = {(r["doc_id"], r["item_id"], r["tiled_words"]) for r in dc.op1_string_tiling(spark, sf_dir).collect()}
    assert got == want and want
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert {(r["doc_id"], r["item_id"], r["tiled_words"]) for r in dc.find_leaks(docs, benchmark, block_bytes=2000).collect()} == want
    kept = dc.without_leaks(docs, benchmark, block_bytes=2000)
    assert kept.schema == docs.schema and {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {d for d, _, _ in want}


def test_leaks_of_odd_rows(spark, tmp_path):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i"), (2, None), (3, ""), (1, "a b c d e f g h i"), (None, "one")], "item_id long, text string")
    docs = odd_documents(spark)
    assert sorted(r["doc_id"] for r in dc.find_leaks(docs, benchmark).collect()) == [3, 3, 4, 4, 4, 4]
    assert dc.without_leaks(docs, benchmark).count() == len(ODD) - 3
    assert dc.find_leaks(docs, benchmark.limit(0)).count() == 0 and dc.without_leaks(docs, benchmark.limit(0)).count() == len(ODD)
    assert dc.find_leaks(odd_documents(spark, True), benchmark).count() == 0


def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # every fourth label is hidden from the model and from the evidence
    hidden = docs.selectExpr("doc_id", "text", "case when doc_id % 4 = 0 then null else lang end as lang", "source")
    told = {r["row_id"]: r for r in language.identify(spark, hidden).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    unseen = [d for d in truth if d % 4 == 0]
    assert len(told) == len(truth)
    assert sum(told[d]["language"] == truth[d] for d in unseen) >= 0.95 * len(unseen)
    assert all(r["accepted"] for r in told.values())


def brute_languages(labelled, rows):
    """Language and posterior by the module's text, from (label, text) and (id, text, declared, address)."""
    names = sorted({label.lower() for label, text in labelled if label and re.search("[A-Za-z]|[^\\x00-\\x7f]", text or "")})
    table = np.zeros((language.CELLS, len(names) + 1), np.float32)
    for k, name in enumerate(names):
        counts = sum(np.bincount(language.trigrams(t or ""), minlength=language.CELLS) for label, t in labelled if label and label.lower() == name)
        table[:, k] = np.log((counts + 0.02) / (counts.sum() + 0.02 * language.CELLS))
    table[:, -1] = -np.log(language.CELLS)
    n, common, seen = len(names) + 1, {x for x, _ in ((label.lower(), 0) for label, _ in labelled if label)}, []
    for name, text, declared, address in rows:
        cells, d = language.trigrams(text or ""), (declared or "").lower()
        ll = table[cells].sum(0, dtype=np.float64).round(6) if len(cells) else np.zeros(n)
        d = d if d in common or d == "" else (re.match("([a-z]{2,3})[-_]", d) or ["", ""])[1] or "?"
        host = re.match(r"(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", (address or "").lower())[1]
        parts = host.split(".")
        levels = [parts[-1] if len(parts) > 1 else "", ".".join(parts[-2:]), host]
        seen.append((name, len(cells), ll, int(ll.argmax()), d if d in common or d == "" else "?", levels))
    heard = [s for s in seen if s[1]]
    count = lambda f: np.bincount([s[3] for s in heard if f(s)], minlength=n).astype(float)
    totals = count(lambda s: True)
    values, out = len(common | {"", "?"}), {}
    smooth = lambda c, p: (c + 10 * p) / (c.sum() + 10)
    for name, size, ll, guess, d, levels in seen:
        prior = (totals + 1) / (totals.sum() + n)
        for i in (0, 1, 2):
            own = count(lambda s, i=i, levels=levels: s[5][: i + 1] == levels[: i + 1])
            if i == 2 and size:
                own[guess] -= 1
            prior = smooth(own, prior)
        score = ll * 0.3 + np.log((count(lambda s, d=d: s[4] == d) + 0.5) / (totals + 0.5 * values)) + np.log(prior)
        k = int(score.argmax())
        out[name] = ([*names, "und"][k], 1 / np.exp(score - score.max()).sum()) if size else ("und", 0.0)
    return out


def test_fusion_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()
    labelled = [(r["lang"], r["text"]) for r in docs[:30]]
    hosts = ["https://a.x.de/q", "http://b.x.de", "c.x.de", "https://u@d.com:80/", "srv", "", None]
    said = [None, "", "de", "DE-at", "xx", "en", "fr_FR"]
    rows = [(i, r["text"][:40] if i % 3 else r["text"], said[i % 7], hosts[i * 5 % 7]) for i, r in enumerate(docs)] + [(900, "12 34", "de", "a.x.de"), (901, None, None, None)]
    want = brute_languages(labelled, rows)
    frame = spark.createDataFrame(rows, "id long, text string, lang string, url string")
    got = language.identify(spark, frame, "id", host_col="url", labelled=spark.createDataFrame(labelled, "label string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["language"] == want[r["row_id"]][0] and abs(r["posterior"] - want[r["row_id"]][1]) < 2e-4, (r, want[r["row_id"]])


def test_languages_of_pages(spark, sf_dir):
    told = language.language_of_pages(spark, sf_dir).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"] for r in told} == set(pages) and len(told) == len(pages)
    written = [(r["language"], re.search('<html lang="([a-z]+)"', pages[r["page_id"]]["html"])) for r in told]
    written = [(a, b[1]) for a, b in written if b]
    assert sum(a == b for a, b in written) >= 0.9 * len(written) and {r["host"].rsplit(".", 1)[-1] for r in told} - {""}


def test_languages_use_all_evidence(spark):
    rows = []
    for i in range(40):
        rows.append((i, "der die und nicht ist auf mit sich ein haus in", "de", f"https://www{i % 2}.kurz.de/x"))
        rows.append((100 + i, "the and that with this from house they have in", "en", f"http://a{i % 2}.brief.co.uk/y?q=1"))
    rows += [(900, "in", "", "https://neu.kurz.de/"), (901, "in", "", "http://new.brief.co.uk"), (902, "in", "de", ""), (903, "12 34 !!", "de", "x"), (904, "漢字仮名交じり文の文章を長く書き続ける", None, None), (905, None, "en", None)]
    told = {r["row_id"]: r for r in language.identify(spark, spark.createDataFrame(rows, "row long, text string, lang string, url string"), "row", host_col="url").collect()}
    assert all(told[i]["language"] == "de" and told[100 + i]["language"] == "en" for i in range(40))
    assert (told[900]["language"], told[901]["language"], told[902]["language"]) == ("de", "en", "de")
    assert told[900]["host"] == "neu.kurz.de"
    assert [told[i]["accepted"] for i in (900, 901, 902, 903, 904, 905)] == [True, True, True, False, False, False]


def test_rare_languages_are_learnt(spark):
    rng = random.Random(5)
    speech = {"en": "the and that with this from house they have river", "xx": "zuqo wexi qazu voxi juwe kezu"}
    rows = [(i, " ".join(rng.choices(speech["en"].split(), k=12)), "en", "a.b") for i in range(6000)]
    rows += [(6000 + i, " ".join(rng.choices(speech["xx"].split(), k=12)), "xx" if i < 3 else "", "c.d") for i in range(5)]
    # the frequent label is sampled, the rare one (1/2000) isn't; one block of languages, and blocks of one
    for block in (64, 1):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
        told = {r["row_id"]: r for r in language.identify(spark, docs, sample=50, block=block).collect()}
        assert len(told) == len(rows)
        assert all(told[6000 + i]["language"] == "xx" and told[6000 + i]["accepted"] for i in range(5))
        assert {told[6000 + i]["declared"] for i in range(5)} == {"xx", ""}
        assert all(told[i]["language"] == "en" for i in range(6000))


def test_languages_of_odd_rows(spark, tmp_path):
    rows = language.op3_language_fusion(spark, saved(odd_documents(spark), tmp_path)).collect()
    assert len(rows) == len(ODD) and not any(r["accepted"] for r in rows if r["doc_id"] in (0, 1, 6))
    assert language.op3_language_fusion(spark, saved(odd_documents(spark, True), tmp_path)).count() == 0
    unlabelled = odd_documents(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    told = language.identify(spark, unlabelled).collect()
    assert {r["language"] for r in told} == {"und"} and sum(r["accepted"] for r in told) == len(ODD) - 3


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        if name != "packing":
            assert out.columns == columns, name
        out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
        if name == "language":
            assert ids(after) == ids(before)
        if name == "lines":
            assert after.count() == before.count()
            from .test_joins_lines import brute_lines

            want = {(d, digest) for d, _, _, digest in brute_lines([(r["doc_id"], r["text"]) for r in before.collect()])}
            assert {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in after.collect()} == want
            seen = {}
            for r in after.collect():
                for line in {x.strip(" \t\x0b\x0c\r").lower() for x in r["text"].split("\n")}:
                    if len(line) >= 10:
                        assert line not in seen or not line.isascii(), (line, seen[line], r["doc_id"])
                        seen[line] = r["doc_id"]
        if name == "near_duplicates":
            from .test_joins_lines import brute_components

            groups = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
            assert ids(after) == {c for _, c in groups.values()}
        if name == "decontamination":
            items = [dc.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            leaky = set()
            for r in before.collect():
                text = dc.words(r["text"] or "")
                runs = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
                near = [w for w in items if any(tuple(w[i : i + 5]) in runs for i in range(len(w) - 4))]
                if any(sum(k for k, _, _ in brute_tiles(w, text, 5)) >= 0.6 * len(w) for w in near):
                    leaky.add(r["doc_id"])
            assert ids(after) == ids(before) - leaky and leaky
        if name == "packing":
            from tokenizers import Tokenizer

            from ledgerloom.llm.tokens import word_vocabulary

            from .test_tokens import check_packing

            tokenizer = Tokenizer.from_file(word_vocabulary())
            check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
        before = after


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir, tmp_path):
    odd = odd_documents(spark).selectExpr("*", "'k' as key", "'o' as owner", "'t' as task", "'u' as __key")
    saved(spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string"), tmp_path, "benchmark")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns, name
        docs = out
    assert {tuple(r[-4:]) for r in docs.collect()} == {("k", "o", "t", "u")}


def test_pipeline_of_odd_rows(spark, tmp_path):
    folder = saved(odd_documents(spark), tmp_path)
    saved(spark.createDataFrame([(1, "x")], "item_id long, text string"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, folder).count() > 0
    saved(odd_documents(spark, True), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0
