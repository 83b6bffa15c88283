"""Language identification by fusing evidence with Bayes' rule.

Four sources are combined: the likelihood of the text (byte trigrams of letters, one
multinomial a language), the language its markup declares, the one its address hints at,
and a prior for its host.  Host priors are counts of text-only guesses by grouped
aggregation, smoothed up a hierarchy (host, registered domain, everything) without the row's
own guess.  How far declarations and addresses can be trusted is counted over all rows too.

The text models are fitted on a bounded sample of labelled documents (``SAMPLE_DOCS`` a
language, those with the smallest hashes).  Every label, in lower case, is a language; more
of them than ``MODEL_BYTES`` has room for is an error, never a cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeflow.llm.common import frugal, small_batches, staged
from latticeflow.llm.kernels import LETTERS, Chunk, chunks

SAMPLE_DOCS = 500
MODEL_BYTES = 1 << 28
SALTS = 64
BUCKETS = 1 << 14
EVIDENCE = 8.0  # times the root of their number, the trigrams of a text that count as independent
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
TRUST = 50.0
PRIOR_CELLS = 1 << 17  # hosts times languages whose priors travel to the texts; beyond, texts travel to them
LEAST_CONFIDENCE = 0.5
UNKNOWN = "und"
#: Country suffixes whose main language is one language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
#: Labels under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ne", "net", "nom", "or", "org")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # (buckets, languages)
    floor: float  # log likelihood of a trigram in no known language


def _trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams with a letter, -1 for others, and where each document's begin."""
    low = chunk.lower()
    b = np.where(LETTERS[low.data], low.data, 32).astype(np.uint32)
    if len(b) < 3:
        return np.full(len(b), -1, np.int64), chunk.offsets
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    bucket = (code * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)
    bucket[code == 0x202020] = -1
    bucket = np.concatenate([bucket, [-1, -1]])
    for back in (1, 2):  # no trigram reaches into the next document
        at = chunk.offsets[1:] - back
        bucket[at[(at >= 0) & (at < len(bucket))]] = -1
    return bucket, chunk.offsets


def _likelihoods(batch: pa.RecordBatch, text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of trigrams and mean log likelihood by language."""
    counts, means = [np.zeros(0, np.int64)], [np.zeros((0, len(model.languages)))]
    for chunk in chunks(batch.column(text)):
        bucket, offsets = _trigrams(chunk)
        kept = np.flatnonzero(bucket >= 0)
        bounds = np.searchsorted(kept, offsets)
        n = np.diff(bounds)
        total = np.zeros((len(n), len(model.languages)))
        busy = np.flatnonzero(n)
        if len(busy):
            for k in range(len(model.languages)):
                total[busy, k] = np.add.reduceat(model.logs[bucket[kept], k], bounds[:-1][busy])
        counts.append(n)
        means.append(total / np.maximum(n, 1)[:, None])
    return np.concatenate(counts), np.concatenate(means)


def fit(documents: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """Text models of the languages that label ``documents (doc_id, text, lang)``."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lower(F.col("lang").cast("string")).alias("lang"))
    named = docs.where("doc_id is not null and lang is not null and lang <> ''")
    languages = sorted(r["lang"] for r in named.select("lang").distinct().limit(MODEL_BYTES // (8 * BUCKETS) + 1).collect())
    if len(languages) * BUCKETS * 8 > MODEL_BYTES:
        raise ValueError(f"more languages than a model of {MODEL_BYTES} bytes has room for")
    nearest = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted = named.select("doc_id", "lang").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*nearest))).where(F.col("n") <= per_language)
    ids = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*nearest))).where(F.col("n") <= per_language).select("doc_id", "lang")
    sample = staged(docs.join(F.broadcast(ids), ["doc_id", "lang"]), "sample")
    place = {name: k for k, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for chunk in chunks(batch.column("text")):
                bucket, offsets = _trigrams(chunk)
                for k in range(len(chunk)):
                    own = bucket[offsets[k] : offsets[k + 1]]
                    total[place[names[chunk.first + k]]] += np.bincount(own[own >= 0], minlength=BUCKETS)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], names=["k", "b", "n"])

    found = sample.mapInArrow(frugal(count), "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    counts[found.column("b").to_numpy(), found.column("k").to_numpy()] += found.column("n").to_numpy()
    draft = Model(tuple(languages), np.log(counts / counts.sum(0)), 0.0)
    if not languages:
        return draft

    def best(batches):
        for batch in batches:
            n, means = _likelihoods(batch, "text", draft)
            yield pa.RecordBatch.from_arrays([pa.array(means.max(1)[n > 0])], names=["m"])

    middle = sample.mapInArrow(best, "m double").agg(F.avg("m")).first()[0] or 0.0
    unseen = float(np.log(0.5 / counts.sum(0)).mean())
    return Model(draft.languages, draft.logs, (middle + unseen) / 2)


def _with_likelihoods(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """``rows`` with ``__n`` and ``__means`` (the text itself stays)."""
    names = rows.columns
    typed = rows.withColumn("__lid_text", F.col(f"`{text}`").cast("string"))
    schema = rows.withColumn("__n", F.lit(0).cast("long")).withColumn("__means", F.array(F.lit(0.0))).schema
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, means = _likelihoods(batch, "__lid_text", shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * means.shape[1], pa.int32()), pa.array(means.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(n), flat], names=[*names, "__n", "__means"])

    return typed.mapInArrow(frugal(run), schema)


def _domain(host: Column) -> Column:
    """The registered domain: two labels, or three where the country registers under a second level."""
    second = "|".join(SECOND_LEVEL)
    deep, plain = F.regexp_extract(host, rf"([^.]+\.(?:{second})\.[a-z]{{2}})$", 1), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.coalesce(F.nullif(deep, F.lit("")), F.nullif(plain, F.lit("")), host)


def identified(rows: DataFrame, model: Model, text: str, host: str | None, declared: str | None, suffix: str | None, need_text: bool = True) -> DataFrame:
    """``rows`` with ``lid_lang``, ``lid_confidence`` and ``lid_accepted``.

    The columns named hold the text, the host (any grouping of origins), the declared
    language and the address's hint; null, empty or unknown values of the last three are no
    evidence, and case does not matter.  A text likelier in no known language, or whose best
    posterior is below ``LEAST_CONFIDENCE``, is ``und`` and not accepted.  So is a text
    without letters, unless ``need_text`` is off and a declaration or an address speaks for
    it.  Equal posteriors go to the first language in order.
    """
    spark, languages = rows.sparkSession, list(model.languages)
    if not languages:
        return rows.withColumn("lid_lang", F.lit(UNKNOWN)).withColumn("lid_confidence", F.lit(0.0)).withColumn("lid_accepted", F.lit(False))
    n = len(languages)
    given = {"__host": host, "__declared": declared, "__suffix": suffix}
    cols = {k: F.nullif(F.lower(F.col(f"`{v}`").cast("string")), F.lit("")) if v else F.lit(None).cast("string") for k, v in given.items()}
    names = F.array(*(F.lit(x) for x in languages))
    known = lambda c: F.nullif(F.array_position(names, c).cast("int"), F.lit(0)) - 1
    prepared = rows.withColumns({"__host": cols["__host"], "__declared": known(cols["__declared"]), "__suffix": known(cols["__suffix"])})
    prepared = prepared.withColumn("__domain", _domain(F.col("__host")))
    guess = F.when(F.col("__n") > 0, F.array_position("__means", F.array_max("__means")).cast("int") - 1)
    narrow = staged(
        _with_likelihoods(prepared.select(F.col(f"`{text}`").alias("__text"), "__host", "__domain", "__declared", "__suffix"), "__text", model)
        .withColumn("__guess", guess).select("__host", "__domain", "__declared", "__suffix", "__guess").where("__guess is not null"),
        "guesses",
    )

    def counts(key: str) -> DataFrame:
        """Guesses by language, as an array, of each value of ``key``."""
        some = narrow.where(F.col(key).isNotNull()).groupBy(key, "__guess").agg(F.count("*").cast("double").alias("c"))
        held = some.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__guess", "c"))).alias("__of"))
        return held.select(key, F.expr(f"transform(sequence(0, {n - 1}), k -> coalesce(element_at(__of, k), 0D))").alias(f"{key}_counts"))

    overall = np.ones(n)
    for r in narrow.groupBy("__guess").count().collect():
        overall[r["__guess"]] += r["count"]
    world = "array(" + ", ".join(f"{v!r}D" for v in (overall / overall.sum()).tolist()) + ")"

    def trust(key: str) -> DataFrame:
        """log P(value | language) by language, a row a value (at most one a language)."""
        table = np.full((n, n), 1.0) + np.eye(n) * TRUST
        for r in narrow.where(F.col(key).isNotNull()).groupBy(key, "__guess").count().collect():
            table[r[0], r[1]] += r[2]
        logs = np.log(table / table.sum(0))
        return F.broadcast(spark.createDataFrame([(k, v) for k, v in enumerate(logs.tolist())], f"{key} int, {key}_logs array<double>"))

    domains, hosts = counts("__domain"), counts("__host").withColumn("__domain", _domain(F.col("__host")))
    # as a table, their number is known before the join is planned: for few hosts no text is moved
    priors = staged(hosts.join(domains, "__domain", "left").drop("__domain"), "priors")
    few = PRIOR_CELLS // n
    if priors.limit(few + 1).count() <= few:
        priors = F.broadcast(priors)
    scored = _with_likelihoods(prepared, text, model).withColumn("__guess", guess).join(priors, "__host", "left").join(trust("__declared"), "__declared", "left").join(trust("__suffix"), "__suffix", "left")
    # counts without the row's own guess, smoothed by the level above
    own = "if(__guess = k, 1D, 0D)"
    size = lambda c: f"greatest(aggregate({c}, 0D, (s, v) -> s + v) - if(__guess is null, 0D, 1D), 0D)"
    less = lambda c: f"greatest({c}[k] - coalesce({own}, 0D), 0D)"
    scored = scored.withColumns({"__domain_size": F.expr(size("__domain_counts")), "__host_size": F.expr(size("__host_counts")), "__share": F.least(F.col("__n").cast("double"), F.lit(EVIDENCE) * F.sqrt(F.col("__n")))})
    domain = f"coalesce(({less('__domain_counts')} + {DOMAIN_WEIGHT}D * w) / (__domain_size + {DOMAIN_WEIGHT}D), w)"
    prior = f"coalesce(({less('__host_counts')} + {HOST_WEIGHT}D * ({domain})) / (__host_size + {HOST_WEIGHT}D), w)"
    out = scored.withColumn("__post", F.expr(f"transform({world}, (w, k) -> __means[k] * __share + ln({prior}) + coalesce(__declared_logs[k], 0D) + coalesce(__suffix_logs[k], 0D))"))
    out = out.withColumn("__top", F.array_max("__post"))
    total = F.aggregate("__post", F.lit(0.0), lambda a, p: a + F.exp(p - F.col("__top")))
    best = F.element_at(names, F.array_position("__post", F.col("__top")).cast("int"))
    worded = (F.col("__n") > 0) & (F.array_max("__means") >= model.floor)
    told = (F.col("__n") == 0) & (F.col("__declared").isNotNull() | F.col("__suffix").isNotNull()) & F.lit(not need_text)
    accepted = (worded | told) & (1 / total >= LEAST_CONFIDENCE)
    final = out.withColumns({"lid_confidence": 1 / total, "lid_accepted": accepted, "lid_lang": F.when(accepted, best).otherwise(F.lit(UNKNOWN))})
    return final.select(*(F.col(f"`{c}`") for c in rows.columns), "lid_lang", "lid_confidence", "lid_accepted")


def page_parts(pages: DataFrame) -> DataFrame:
    """``(page_id, text, host, declared, suffix)`` of raw pages, by their markup and address."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    # what is left open ends with the page, and a tag with the next one, so that no position is read twice
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>|&[a-z#0-9]{1,10};", " ")
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    countries = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), text.alias("text"), host.alias("host"),
        F.lower(F.regexp_extract(html, r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)).alias("declared"),
        F.coalesce(F.nullif(path, F.lit("")), F.element_at(countries, country)).alias("suffix"),
    )


def page_languages(pages: DataFrame, documents: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``(page_id, lang, confidence, accepted, declared, suffix, host)`` of all pages.

    Null html or url is empty and gives no evidence; null and repeated page_ids keep their
    rows; other columns are not read; without pages there are no rows.  A page without
    letters has the language that its markup or address speaks for.
    """
    out = identified(page_parts(pages), fit(documents, per_language), "text", "host", "declared", "suffix", need_text=False)
    return out.select("page_id", F.col("lid_lang").alias("lang"), F.col("lid_confidence").alias("confidence"), F.col("lid_accepted").alias("accepted"), "declared", "suffix", "host")
