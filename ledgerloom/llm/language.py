"""Language identification by fusing evidence with Bayes' rule.

For each language L of the model, the log posterior of a row is the sum of

* the text's log likelihood: hashed byte trigrams of the lower-cased text without ASCII digits and
  punctuation, tempered by ``TEMPER`` as neighbouring trigrams aren't independent;
* the declared markup language's log likelihood, P(declared | L), from all rows by grouped aggregation;
* the log prior of the row's host, smoothed along global -> address suffix -> domain -> host: each level's
  counts (grouped aggregations over all rows) are added to ``STRENGTH`` pseudo-counts of its parent's
  shares. A row's own guess is taken out of its host's counts.

The trigram model is fitted on labelled rows: of each label all, or an even sample by hash of about
half of ``SAMPLE`` to ``SAMPLE`` rows where there are more. Every label is learnt, however rare. Texts
are scored in blocks of ``BLOCK`` languages, so one block of the model is unpacked at a time; a row's
likelihoods and a host's counts grow with the labels. Language ``und`` has the same share for every
trigram; a row is rejected if ``und`` wins, which takes text unlike any language learnt. Rows without a letter have no text evidence: they are ``und`` and rejected.

Null and empty texts are such rows. Null declared languages and hosts are values of their own. Where no row
is labelled, nothing can be told apart: every row with letters is ``und`` and accepted. Repeated
rows are told each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import html_to_text
from .common import Workspace, join_hot_apart, rows, texts

CELLS, SAMPLE, TEMPER, STRENGTH, SEGMENT = 1 << 15, 20_000, 0.3, 10.0, 1 << 20
BLOCK, FEW = 64, 1000
DROPPED = bytes(i for i in range(33, 127) if not chr(i).isalpha())
LETTER = r"[^\x00-\x7f]|[A-Za-z]"
BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def trigrams(text: str) -> np.ndarray:
    """Cells of the byte trigrams of a text; none if it has no letter."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(BLANK, DROPPED).strip() + b" "
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    mixed = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ mixed >> np.uint32(13)) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)


def fit(labelled: DataFrame, ws: Workspace, block: int = BLOCK) -> tuple[list[str], list[bytes]]:
    """Languages, and their log shares by cell in packed blocks, from rows of (label, text). ``und`` comes last."""
    schema = "label string, cell int, n long"

    def packed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for label, counts in total.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(counts[cells], pa.int64())], ["label", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in rows(batches):
            for label, text in zip(batch.column("label").to_pylist(), texts(batch.column("text")), strict=True):
                if label not in total and len(total) == block:
                    yield from packed(total)
                    total = {}
                total[label] = total.get(label, 0) + np.bincount(trigrams(text), minlength=CELLS)
        yield from packed(total)

    sums = ws.table("sums", labelled.mapInArrow(run, schema).groupBy("label", "cell").agg(F.sum("n").alias("n")))
    names, model = sorted(r[0] for r in sums.select("label").distinct().collect()), []
    for at in range(0, len(names) + 1, block):
        part = names[at : at + block]
        table = np.zeros((CELLS, min(block, len(names) + 1 - at)), np.float32)
        found = {label: np.zeros(CELLS) for label in part}
        for label, cell, n in sums.where(F.col("label").isin(part)).toPandas().itertuples(index=False) if part else ():  # CELLS rows a label at most
            found[label][cell] += n
        for k, label in enumerate(part):
            counts = found[label]
            table[:, k] = np.log((counts + 0.02) / (counts.sum() + 0.02 * CELLS))
        if at + block > len(names):
            table[:, -1] = -np.log(CELLS)
        model.append(zlib.compress(table.tobytes(), 1))
    return [*names, "und"], model


def _likelihoods(model: list[bytes]):
    def unpacked(block: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(block), np.float32).reshape(CELLS, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = unpacked(model[0]) if len(model) == 1 else None

        def scores(group: list[np.ndarray]) -> list[np.ndarray]:
            parts: list[list[np.ndarray]] = [[] for _ in group]
            for block in model:
                table = unpacked(block) if only is None else only
                for part, cells in zip(parts, group, strict=True):
                    total = np.zeros(table.shape[1])
                    for at in range(0, len(cells), SEGMENT):
                        total += table[cells[at : at + SEGMENT]].sum(0, dtype=np.float64)
                    part.append(total.round(6))
            return [np.concatenate(part) for part in parts]

        for batch in rows(batches):
            sizes, out, group, held = [], [], [], 0
            for text in texts(batch.column("text")):
                cells = trigrams(text)
                sizes.append(len(cells))
                group.append(cells)
                held += len(cells)
                if only is not None or held >= SEGMENT:
                    out += scores(group)
                    group, held = [], 0
            if group:
                out += scores(group)
            names = [n for n in batch.schema.names if n != "text"]
            columns = [batch.column(n) for n in names] + [pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "trigrams", "ll"])

    return run


def _best(scores: str | Column) -> Column:
    """Index of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _counts(sums: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """By keys, an array of the counts of all guesses, from rows of (keys, guess, n)."""
    few = sums.groupBy(*keys, "guess").agg(F.sum("n").cast("double").alias("n"))
    few = few.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"))
    return few.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias(name))


def _smoothed(counts: Column, parent: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def identify(spark: SparkSession, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", label_col: str | None = None, labelled: DataFrame | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """row_id, language, posterior, declared, host and accepted of every row.

    ``host_col`` may hold whole addresses or hosts. The text model is fitted on ``labelled`` (text, label), if given, so
    that what rows declare is evidence apart from the labels; else on the rows' ``label_col``, by default what they declare.
    """
    ws = Workspace(spark, "language")
    address = F.lower(F.coalesce(F.col(host_col), F.lit("")))
    host = F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1)
    source = table.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"), F.lower(F.coalesce(F.col(declared_col), F.lit(""))).alias("declared"), host.alias("host"), F.col(label_col or declared_col).alias("label"))
    has = source.select("label", "text", F.xxhash64("row_id", "text").alias("h")) if labelled is None else labelled.select("label", "text", F.xxhash64("text").alias("h"))
    has = has.where(F.coalesce("label", F.lit("")) != "").select(F.lower("label").alias("label"), "text", "h", F.col("text").rlike(LETTER).alias("says"))
    # Every label with letters gives rows: its smallest hash is taken besides those that the rate takes.
    counts = ws.table("labels", has.groupBy("label").agg(F.count_if("says").alias("n"), F.min(F.when(F.col("says"), F.col("h"))).alias("least")))
    common = [r[0] for r in counts.select("label").collect()]
    large = counts.where(F.col("n") > sample).select("label", "least", F.ceil(F.col("n") / sample).alias("every"))
    says = has.where("says")
    rated = says.join(F.broadcast(large), "label", "left") if large.count() <= FEW else join_hot_apart(says, large, "label")
    chosen = rated.where(F.col("every").isNull() | (F.col("h") == F.col("least")) | (F.pmod("h", "every") == 0)).select("label", "text")
    names, model = fit(chosen, ws, block)
    n = len(names)
    scored = source.drop("label").mapInArrow(_likelihoods(model), f"row_id {source.schema['row_id'].dataType.simpleString()}, declared string, host string, trigrams long, ll array<double>")
    known = F.when(F.col("declared").isin(common) | (F.col("declared") == ""), F.col("declared")).otherwise(F.regexp_extract("declared", r"^([a-z]{2,3})[-_]", 1))
    scored = scored.withColumn("declared", F.when(known.isin(*common, ""), known).otherwise("?") if common else F.lit(""))
    scored = ws.table("scored", scored.withColumn("guess", _best("ll")))

    # P(declared | language): at most (languages + 2) values by languages.
    told = scored.where("trigrams > 0").groupBy("declared", "guess").agg(F.count(F.lit(1)).alias("n"))
    totals = {r[0]: r[1] for r in told.groupBy("guess").agg(F.sum("n")).collect()}
    values = len({*common, "", "?"})
    column = F.lit([float(totals.get(k, 0) + 0.5 * values) for k in range(n)])
    rate = lambda c: F.zip_with(c, column, lambda x, t: F.log((x + 0.5) / t))
    declared = _counts(told, ["declared"], n, "c").select("declared", rate(F.col("c")).alias("dl"))

    # Priors along the host's hierarchy.
    hosts = scored.where("trigrams > 0").groupBy("host", "guess").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("host", r"\.")
    hosts = ws.table("hosts", hosts.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")).withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")))
    whole = [float(totals.get(k, 0)) for k in range(n)]
    top = F.lit([(x + 1) / (sum(whole) + n) for x in whole])
    suffixes = _counts(hosts, ["suffix"], n, "sc").select("suffix", _smoothed(F.col("sc"), top).alias("sp"))
    domains = _counts(hosts, ["suffix", "domain"], n, "dc")
    domains = join_hot_apart(domains, suffixes, "suffix").select("domain", _smoothed(F.col("dc"), F.col("sp")).alias("dp"))
    priors = ws.table("priors", join_hot_apart(_counts(hosts, ["domain", "host"], n, "c"), domains, "domain").select("host", "c", "dp"))

    fused = join_hot_apart(scored, priors, "host")
    fused = fused.join(F.broadcast(declared), "declared", "left") if n <= FEW else join_hot_apart(fused, declared, "declared")
    own = F.transform(F.coalesce("c", F.array_repeat(F.lit(0.0), n)), lambda c, i: c - F.when((i == F.col("guess")) & (F.col("trigrams") > 0), 1.0).otherwise(0.0))
    prior = _smoothed(own, F.coalesce("dp", top))
    score = F.zip_with(F.zip_with("ll", F.coalesce("dl", rate(F.array_repeat(F.lit(0.0), n))), lambda a, b: a * TEMPER + b), prior, lambda s, p: s + F.log(p))
    out = fused.withColumn("score", score).withColumn("best", _best("score"))
    weight = F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max("score")))
    silent = F.col("trigrams") == 0
    language = F.when(silent, "und").otherwise(F.element_at(F.lit(names), F.col("best") + 1))
    accepted = ~silent & ((F.col("best") < n - 1) | F.lit(n == 1))
    return out.select("row_id", language.alias("language"), F.round(F.when(silent, 0.0).otherwise(1 / weight), 4).alias("posterior"), "declared", "host", accepted.alias("accepted"))


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents; lang is the declared one, source the host."""
    return identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("row_id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page: its text by a model of the documents' labels, its markup's language, its address's host and suffix."""
    declared = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z0-9_-]+)""", 1)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_to_text(F.col("html")).alias("text"), declared.alias("lang"), "url")
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("label"), "text")
    return identify(spark, pages, "page_id", host_col="url", labelled=labelled).withColumnRenamed("row_id", "page_id")
