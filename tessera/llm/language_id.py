"""Language of web pages by Bayesian fusion of evidence.

Four kinds of evidence: the likelihood of a page's main text under a byte-trigram model of each language; the language
its markup declares; the suffix of its address; and a prior for its host, smoothed towards that of its domain, which
is smoothed towards that of all pages. The tables behind the last three are grouped sums of the pages' own text
posteriors, over all pages; a page is left out of the sums it is judged by.

The text model is fitted on a bounded sample (``TRAIN_DOCS`` labelled documents a language, of at most
``TRAIN_BYTES`` bytes). Texts are read once; what is grouped and joined afterwards is a short row a page. Sums combine
before the shuffle, and keyed tables are broadcast only when counted to be small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import html_text
from tessera.llm.common import bounded_broadcast, text_or_empty, written

BUCKETS = 1 << 14
TRAIN_DOCS = 300
TRAIN_BYTES = 16_384
MAX_LANGS = 200
#: Text evidence counts as that of at most so many trigrams.
FULL_WEIGHT = 60
ALPHA, BETA = 20.0, 5.0


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the text, in lower case, letters and what binds them only, with a space around."""
    words = "".join(c if c.isalpha() or c in "'’-" else " " for c in text.lower()).split()
    b = np.frombuffer((" " + " ".join(words) + " ").encode(), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    x = (x * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return x.astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    langs: tuple[str, ...]
    log_p: np.ndarray  # (languages, BUCKETS)

    @classmethod
    def fit(cls, samples: list[tuple[str, str]]) -> TextModel:
        """From (language, text) pairs."""
        langs = tuple(sorted({lang for lang, _ in samples}))
        counts = np.zeros((len(langs), BUCKETS))
        for lang, text in samples:
            counts[langs.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        every = counts.sum(0) + 1
        p = counts + 50 * every / every.sum()
        return cls(langs, np.log(p / p.sum(1, keepdims=True)))

    def log_likelihood(self, text: str) -> np.ndarray:
        """Per language, scaled to FULL_WEIGHT trigrams where there are more; zeros without text."""
        g = trigrams(text)
        if not len(g):
            return np.zeros(len(self.langs))
        mean = self.log_p[:, g].mean(axis=1)
        return mean * min(len(g), FULL_WEIGHT)


def training_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """At most TRAIN_DOCS (language, text) pairs a language, those with the least hashes of id and text, of at most
    MAX_LANGS languages, those with the most documents up to TRAIN_DOCS, then in order of their names."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(lang_col).alias("lang"), text.alias("text"), F.xxhash64(id_col, text_col).alias("h")).where("lang is not null").where(F.octet_length("text").between(20, TRAIN_BYTES))
    # hashes first, each task keeping its least: texts are fetched only of the rows that are taken
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = rows.select("lang", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= TRAIN_DOCS)
    ends = {r["lang"]: r["h"] for r in least.groupBy("lang").agg(F.max("h").alias("h"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not ends:
        return []
    last = docs.sparkSession.createDataFrame(list(ends.items()), "l string, last bigint")  # at most MAX_LANGS rows
    taken = rows.join(F.broadcast(last), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("last"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in taken.select("lang", "text").collect())


def declared_language(page: Column) -> Column:
    """The primary language that the html element or a meta element declares, lower case; empty if none. The whole
    page is searched."""
    tag = F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    meta = F.regexp_extract(page, r"(?i)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.lower(F.when(tag != "", tag).otherwise(meta))


def domain_column(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1)


def page_evidence(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, host, domain, suffix, declared, ll`` (an array in the order of the model's languages)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = [shared.value.log_likelihood(html_text.extract(p.as_py(), None)) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ll, pa.list_(pa.float64()))], ["page_id", "host", "declared", "ll"])

    page = text_or_empty(F.col(html_col))
    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), html_text.host_column(F.col(url_col)).alias("host"), declared_language(page).alias("declared"), page.alias("html"))
    rows = src.mapInArrow(run, "page_id bigint, host string, declared string, ll array<double>")
    return rows.withColumns({"domain": domain_column(F.col("host")), "suffix": F.regexp_extract("host", r"([^.]*)$", 1)})


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", doc_text: str = "text", doc_lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``page_id, lang, probability, text_lang, declared, suffix, host`` for every row of ``pages``.

    ``docs`` has the labelled texts that the text model learns from; without any, lang and probability are null. A
    null page has no text: its other evidence decides. Ties go to the first language in order. Repeated rows come back
    as often as they are there, null ids stay null, an empty table gives an empty result.
    """
    model = TextModel.fit(training_sample(docs, doc_text, doc_lang, doc_id))
    rows = page_evidence(pages, model, id_col, url_col, html_col)
    langs = model.langs
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "suffix", "host")
    q = [f"q{i}" for i in range(len(langs))]
    top = F.array_max("ll")
    total = sum((F.exp(F.col("ll")[i] - top) for i in range(len(langs))), F.lit(0.0))
    rows = written(rows.withColumns({q[i]: F.exp(F.col("ll")[i] - top) / total for i in range(len(langs))}), "evidence")
    sums = {k: written(rows.groupBy(k).agg(*(F.sum(c).alias(f"{k}_{c}") for c in q)), f"{k}-sums") for k in ("host", "domain", "suffix", "declared")}
    # host and domain are keys of the same row; one row holds the sums over everything
    every = sums["suffix"].agg(*(F.sum(f"suffix_{c}").alias(f"all_{c}") for c in q)).first()
    share = [((every[i] if every[i] is not None else 0.0) + 1.0) / (sum(x or 0.0 for x in every) + len(langs)) for i in range(len(langs))]
    out = rows
    for k, s in sums.items():
        out = out.join(bounded_broadcast(s), k, "left")

    def rest(k: str, i: int) -> Column:
        return F.greatest(F.col(f"{k}_{q[i]}") - F.col(q[i]), F.lit(0.0))

    def smoothed(k: str, i: int, towards, weight: float) -> Column:
        n = sum((rest(k, j) for j in range(len(langs))), F.lit(0.0))
        return (rest(k, i) + weight * towards) / (n + weight)

    log_post = []
    for i in range(len(langs)):
        prior = smoothed("host", i, smoothed("domain", i, F.lit(share[i]), ALPHA), BETA)
        ratios = [smoothed(k, i, F.lit(share[i]), ALPHA) / F.lit(share[i]) for k in ("suffix", "declared")]
        log_post.append(F.col("ll")[i] + F.log(prior) + F.log(ratios[0]) + F.log(ratios[1]))
    out = out.withColumn("post", F.array(*log_post)).withColumn("best", F.array_max("post"))
    names = F.array(*(F.lit(x) for x in langs))
    at = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    mass = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    return out.select("page_id", at(F.col("post")).alias("lang"), (1 / mass).alias("probability"), F.when(F.array_max("ll") == F.array_min("ll"), None).otherwise(at(F.col("ll"))).alias("text_lang"), "declared", "suffix", "host")
