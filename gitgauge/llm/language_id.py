"""Language identification by Bayesian fusion of what a page says and where it stands.

log posterior = log prior of the host + log likelihood of the declared markup language + of the address suffix + of the text.
The text model is a multinomial over hashed character trigrams of words, from grouped counts over all labelled documents. Host
priors are smoothed hierarchically: suffix counts shrink towards the counts of all pages, domain counts towards their suffix,
host counts towards their domain. What a declared language and a suffix mean is learnt from the pages: grouped expected counts of
the posterior without them. A page votes for the tables in proportion to its posterior, so a page of doubt teaches little.

Null texts and pages without tags have no text evidence; a missing or unknown declaration, suffix or host gives no evidence of its
kind. Null ids are kept. With no labelled documents every language is null. Repeated rows repeat and count as often; an empty table
gives an empty result. Other columns are ignored.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import slices, written

DIM = 1 << 16
STRENGTH = 20.0  # pages that a parent's share is worth
TEMPER = 0.25  # trigrams of one text are far from independent
MAX_LANGS = 512
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")


def trigrams(text: str) -> np.ndarray:
    """Hashed places of all character trigrams of the lower-cased words, edges marked."""
    joined = " " + " ".join(_WORD.findall(text.lower())) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)


def visible(html: str) -> str:
    return _TAG.sub(" ", _HIDDEN.sub(" ", html))


def text_model(docs, text_col="text", lang_col="lang"):
    """(languages, log likelihoods (DIM, languages)): add-half counts of trigrams over all documents with a language."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lower(F.trim(F.col(lang_col).cast("string"))).alias("lang")).filter(
        "lang is not null and lang <> ''")

    def count(batches):
        sums = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in sums:
                    sums[lang] = np.zeros(DIM, np.int64)
                sums[lang] += np.bincount(trigrams(text.as_py()), minlength=DIM)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "place", "n"])

    found = rows.mapInArrow(count, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.full((DIM, len(langs)), 0.5)
    column = {x: i for i, x in enumerate(langs)}
    for r in found.toLocalIterator():  # at most DIM rows a language
        counts[r["place"], column[r["lang"]]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else np.zeros((DIM, 0), np.float32)


def page_parts(pages, id_col="page_id", url_col="url", html_col="html"):
    """page_id, declared, suffix, domain, host, html; strings without a value are null."""
    def some(c):
        return F.when(c != "", c)

    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    host = some(F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)))
    declared = some(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1)))
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), declared.alias("declared"), host.alias("host"), html.alias("html")).withColumns({
        "suffix": some(F.regexp_extract("host", r"([^.]+)\.?$", 1)), "domain": some(F.regexp_extract("host", r"([^.]+\.[^.]+)\.?$", 1))})


def text_evidence(parts, langs, model):
    """Adds ``text``: the tempered log likelihoods of the visible words, one a language."""
    shared = parts.sparkSession.sparkContext.broadcast(model)
    keep = ["page_id", "declared", "suffix", "domain", "host"]

    def run(batches):
        table = shared.value
        for whole in batches:
            for batch in slices(whole, "html"):
                out = []
                for html in batch.column("html"):
                    at = trigrams(visible(html.as_py()))
                    own = table[at].sum(axis=0, dtype=np.float64) * TEMPER if len(at) else np.zeros(table.shape[1])
                    out.append((own - own.max()).tolist() if len(own) else [])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.list_(pa.float64()))], names=[*keep, "ev"])

    return parts.select(*keep, "html").mapInArrow(run, "page_id bigint, declared string, suffix string, domain string, host string, ev array<double>")


def _posterior(logs):
    """Array of probabilities of an array of logs."""
    high = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - high))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(rows, key, n):
    """Expected counts ``c`` of the languages by key; partial sums fold a hot host before the shuffle."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("c"))


def _shrunk(counts, parent):
    """(counts + STRENGTH * parent) / (total + STRENGTH)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, parent, lambda c, p: (c + STRENGTH * p) / (total + STRENGTH))


def identify(pages, docs, id_col="page_id", url_col="url", html_col="html", text_col="text", lang_col="lang"):
    """page_id, declared, host, text_language, language, probability of every page."""
    langs, model = text_model(docs, text_col, lang_col)
    parts = page_parts(pages, id_col, url_col, html_col)
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.lit(None).cast("array<string>")
    if not langs:
        none = F.lit(None).cast("string")
        return parts.select("page_id", "declared", "host", none.alias("text_language"), none.alias("language"), F.lit(None).cast("double").alias("probability"))
    n = len(langs)
    rows = written(text_evidence(parts, langs, model).withColumn("p", _posterior(F.col("ev"))), "evidence")

    # one row: expected counts of the languages over all pages
    counts = rows.agg(*[F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(str(i)) for i in range(n)]).first()
    total = np.array([counts[i] for i in range(n)])
    share = (total + STRENGTH / n) / (total.sum() + STRENGTH)
    everything = F.array(*[F.lit(float(x)) for x in share])

    # shares of all pages, of a suffix, of a domain, of a host; each shrinks towards the one before
    suffix = _sums(rows, "suffix", n).select("suffix", _shrunk(F.col("c"), everything).alias("sp"))
    domain = _sums(rows, "domain", n).withColumn("suffix", F.regexp_extract("domain", r"([^.]+)$", 1)).join(
        suffix, "suffix").select("domain", _shrunk(F.col("c"), F.col("sp")).alias("dp"))
    host = _sums(rows, "host", n).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)\.?$", 1)).join(
        domain, "domain", "left").select("host", _shrunk(F.col("c"), F.coalesce("dp", everything)).alias("hp"))

    def likelihood(key, alias):
        """P(value | language), from expected counts over the languages' expected totals."""
        kinds = rows.select(key).filter(F.col(key).isNotNull()).distinct().count()
        return _sums(rows, key, n).select(key, F.transform("c", lambda c, i: F.log(
            (c + 0.5) / (F.element_at(F.array(*[F.lit(float(t)) for t in total]), i + 1) + 0.5 * kinds))).alias(alias))

    fused = rows.join(host, "host", "left").join(likelihood("declared", "dl"), "declared", "left").join(likelihood("suffix", "sl"), "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    logs = F.zip_with("ev", F.coalesce("hp", everything), lambda a, b: a + F.log(b))
    for extra in ("dl", "sl"):
        logs = F.zip_with(logs, F.coalesce(extra, zero), lambda a, b: a + b)
    best = fused.select("page_id", "declared", "host", "p", _posterior(logs).alias("q"))
    at = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int")  # noqa: E731  (ties: the first language by name)
    return best.select("page_id", "declared", "host", F.element_at(names, at("p")).alias("text_language"), F.element_at(names, at("q")).alias("language"),
                       F.array_max("q").alias("probability"))
