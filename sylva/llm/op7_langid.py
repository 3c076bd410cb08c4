"""Language identification by fusing text, declared language, address suffix and host evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_runs, documents, lower_ascii, with_own_names, written

#: Buckets that byte trigrams are hashed to, labels whose counts a task holds before it gives them on, and languages whose evidence is summed at once.
BUCKETS, HELD, ABREAST = 1 << 14, 256, 64
#: Overlapping trigrams tell each byte three times.
TEMPER = 1 / 3
#: Weights of the wider level in a smoothed prior: global in suffix, suffix in host.
SUFFIX_WEIGHT, HOST_WEIGHT = 50.0, 20.0
#: The class of texts in no language: all trigrams alike.
NONE = "und"


def _codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram that lies within a row, and the row."""
    x = lower_ascii(data).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:-2]
    inside = np.arange(len(code)) + 3 <= bounds[row + 1]
    return code[inside].astype(np.int64), row[inside]


def fit_trigrams(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled(text, label) -> the languages and the log probabilities of buckets in each; over all rows with a label.

    Every label counts, by its first part in lower case: en, EN and en-US are one. What reaches the driver is the
    model: at most BUCKETS counts a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for label, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["label", "bucket", "n"])
            held.clear()

        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, b, data, bounds in byte_runs(batch.column(0), 1 << 20):
                code, row = _codes(data, bounds)
                names = sorted(set(labels[a:b]))
                index = {x: i for i, x in enumerate(names)}
                of = np.array([index[x] for x in labels[a:b]])
                if len(names) > HELD:
                    key, n = np.unique(of[row] * BUCKETS + code, return_counts=True)
                    own_label = pa.array(names, pa.string()).take(pa.array(key // BUCKETS))
                    yield pa.RecordBatch.from_arrays([own_label, pa.array((key % BUCKETS).astype(np.int32)), pa.array(n.astype(np.int64))], names=["label", "bucket", "n"])
                    continue
                n = np.bincount(of[row] * BUCKETS + code, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for x, own in zip(names, n):
                    held[x] = held[x] + own if x in held else own
                if len(held) > HELD:
                    yield from out()
        yield from out()

    label = F.lower(F.regexp_extract("label", r"^\s*([^-_\s]+)", 1)).alias("label")
    rows = labelled.select("text", label).filter("label <> '' and text is not null")
    counts = written(rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    languages = sorted(r["label"] for r in counts.select("label").distinct().collect())
    table = np.full((len(languages), BUCKETS), 0.5)
    found = counts.toArrow()
    of = pc.index_in(found.column("label"), pa.array(languages, pa.string())).to_numpy()
    table[of, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    table /= table.sum(1, keepdims=True)
    return languages, np.log(table, out=table)


def text_evidence(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """docs(…, text) with `evidence`, tempered log likelihoods of each language and last of NONE, in place of the text."""
    columns = [c for c in docs.columns if c != "text"]
    table = np.ascontiguousarray(np.vstack([model, np.full((1, BUCKETS), -np.log(BUCKETS))]).T * TEMPER).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        k = table.shape[1]
        for batch in batches:
            for a, b, data, bounds in byte_runs(batch.column(len(columns)), 1 << 19):
                code, row = _codes(data, bounds)
                out = np.zeros((b - a, k))
                if len(code):
                    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    for j in range(0, k, ABREAST):
                        out[row[begin], j : j + ABREAST] = np.add.reduceat(table[code, j : j + ABREAST], begin, axis=0, dtype=np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * k, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:-1]] + [lists], names=[*columns, "evidence"])

    kinds = dict(docs.dtypes)
    return docs.select(*columns, "text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", evidence array<double>")


def _best(score: Column) -> Column:
    """The first place, from 1, of the greatest score."""
    return F.array_position(score, F.array_max(score)).cast("int")


def fused(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """evidence(…, declared, suffix, host, evidence) with language, posterior and kept (the language is not NONE).

    The first guess of a row is by text alone. Grouped counts of guesses give how languages are declared, and priors: a host's
    counts are smoothed by its suffix's, and these by all rows'. A row's own guess is left out of its host's counts.
    Null hosts and suffixes are groups of their own, a null declaration tells nothing; ties go to the first language; an empty table gives no rows.
    """
    names = [*languages, NONE]
    k = len(names)
    guessed = written(evidence.withColumn("_guess", _best(F.col("evidence"))), "guessed")
    tally = F.map_from_entries(F.collect_list(F.struct("_guess", "_n")))
    numbers = F.sequence(F.lit(1), F.lit(k))
    of = lambda counts, i: F.coalesce(F.try_element_at(counts, i), F.lit(0))
    literal = lambda values: F.lit([float(x) for x in values])

    def summed(rows: DataFrame) -> list[int]:
        found = dict(rows.groupBy("_guess").agg(F.sum("_n")).collect())  # at most k rows
        return [found.get(i + 1, 0) for i in range(k)]

    hosts = written(guessed.groupBy("suffix", "host", "_guess").agg(F.count("*").alias("_n")), "hosts")
    total = summed(hosts)
    overall = [(n + 1) / (sum(total) + k) for n in total]
    declared = written(guessed.filter("declared is not null").groupBy("declared", "_guess").agg(F.count("*").alias("_n")), "declared")
    kinds, per = declared.select("declared").distinct().count() or 1, summed(declared)
    told = F.transform(literal(n + kinds + 1 for n in per), lambda n, i: F.log((of(F.col("_declared_n"), i + 1) + 1.0) / n))
    declared = declared.groupBy("declared").agg(tally.alias("_declared_n")).select(F.col("declared").alias("_declared"), told.alias("_told"))
    suffixes = hosts.groupBy("suffix", "_guess").agg(F.sum("_n").alias("_n")).groupBy("suffix").agg(F.sum("_n").alias("_all"), tally.alias("_suffix_n"))
    prior = F.transform(literal(SUFFIX_WEIGHT * x for x in overall), lambda x, i: (of(F.col("_suffix_n"), i + 1) + x) / (F.col("_all") + SUFFIX_WEIGHT))
    suffixes = suffixes.select(F.col("suffix").alias("_s"), prior.alias("_suffix"))
    hosts = hosts.groupBy("suffix", "host").agg((F.sum("_n") - 1).alias("_others"), tally.alias("_host_n"))
    hosts = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("_s"))).select(F.col("suffix").alias("_s"), F.col("host").alias("_h"), "_others", "_host_n", "_suffix")
    rows = guessed.join(declared, F.col("declared") == F.col("_declared"), "left")
    rows = rows.join(hosts, F.col("suffix").eqNullSafe(F.col("_s")) & F.col("host").eqNullSafe(F.col("_h")))
    own = lambda i: of(F.col("_host_n"), i) - F.when(F.col("_guess") == i, 1).otherwise(0)
    score = F.transform(numbers, lambda i: F.get("evidence", i - 1) + F.coalesce(F.get("_told", i - 1), F.lit(0.0)) + F.log((own(i) + F.get("_suffix", i - 1) * HOST_WEIGHT) / (F.col("_others") + HOST_WEIGHT)))
    rows = rows.withColumn("_score", score).withColumn("_at", _best(F.col("_score")))
    norm = F.aggregate(F.transform("_score", lambda x: F.exp(x - F.array_max("_score"))), F.lit(0.0), lambda a, x: a + x)
    language = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_at"))
    return rows.select(*evidence.columns, language.alias("language"), (1 / norm).alias("posterior"), (F.col("_at") != k).alias("kept"))


def identified(docs: DataFrame, declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, fold (hash of the text), declared, language, posterior, kept for all rows of docs.

    declared, host and suffix name columns, or are None where docs has no such evidence. Without a model,
    one is fitted to all rows of docs by their declared languages. A row is rejected (kept false) if no
    language explains its text and its other evidence better than trigrams at random.

    Null or short text has no text evidence, a null declaration none of its kind; null hosts and suffixes are
    groups of their own; repeated rows get equal results; ties go to the first language by name; an empty table gives no
    rows. Other columns are ignored.
    """
    named = {"declared": declared, "host": host, "suffix": suffix}
    fold = F.xxhash64(F.coalesce("text", F.lit(""))).alias("fold")
    rows = docs.select("doc_id", fold, *[(F.col(c) if c else F.lit(None)).cast("string").alias(x) for x, c in named.items()], "text")
    languages, table = model or fit_trigrams(rows.select("text", F.col("declared").alias("label")))
    return fused(text_evidence(rows, languages, table), languages).drop("evidence", "host", "suffix")


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> doc_id, text, declared, host, suffix: markup's own language, address parts, and text without markup.

    Null or malformed addresses have neither host nor suffix, null pages an empty text and no declaration; repeated rows give equal rows; an empty table gives no rows; a page of any
    length is read whole; other columns are ignored.
    """
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#A-Za-z0-9]{1,9};", " ")
    host = F.when(host != "", host)
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), F.when(declared != "", declared).alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"))


@with_own_names
def in_a_language(docs: DataFrame) -> DataFrame:
    """docs with all its columns, without the documents that are in no language."""
    columns = docs.columns
    gone = written(identified(docs).filter("not kept").select(F.col("doc_id").alias("_doc"), F.col("fold").alias("_gone")).distinct(), "rejected")
    keyed = docs.withColumn("_fold", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_fold") == F.col("_gone")), "left_anti").select(*columns)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(documents(spark, sf_dir)).select("doc_id", "declared", "language", "posterior", "kept")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages by markup, address and text, with a model of the documents' declared languages; see page_evidence and identified for nulls and ties."""
    model = fit_trigrams(documents(spark, sf_dir).select("text", F.col("lang").alias("label")))
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = identified(pages, "declared", "host", "suffix", model)
    return out.select(F.col("doc_id").alias("page_id"), "declared", "language", "posterior", "kept")
