"""Language ID (operator 8): Bayesian fusion of text, declared language, address suffix and host.

The text's evidence is a naive Bayes score over hashed byte trigrams of the whole
text, from a bounded sample of labelled rows; as trigrams overlap, a longer text
counts as :data:`EFFECTIVE` of them. A class ``und``, under which all trigrams
are equally likely, stands for every other language. Grouped aggregation over
all rows then estimates from the texts' own posteriors

* how often rows of a language declare each language (``<html lang>``),
* how often they have each address suffix (the host's last label), and
* each host's prior, smoothed towards its domain's, that towards the whole's;

a row's own share is taken out of the counts of its declaration, suffix, host and
domain first. The sum of all evidence gives the posterior. ``accepted`` rows have a
known language of probability :data:`ACCEPT` or more.

Every language with a training row is learnt; each is one array of fixed size.

Cases: a row without three letters has no text evidence, gets ``und`` and is not
accepted. A null declaration or url adds no evidence. Repeated rows count as
rows. Without training rows everything is ``und``. An empty table gives an empty
result. Markup, scripts and styles are no text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, bounded_batches, materialise, release_tools, small_enough, text_buffers
from lodestrata.llm.textops import LOWER
from lodestrata.llm.url_filter import host_and_path

UNKNOWN = "und"
#: Training rows of each language (those of the least hash of their id) at most.
SAMPLE_ROWS = 400
BUCKETS = 1 << 16
EFFECTIVE, ACCEPT = 150, 0.5
#: Weight of a prior in rows: domain towards all, host towards domain; counts added to each likelihood.
SMOOTH, ADD = 8.0, 1.0
#: Bytes of priors by host that may be broadcast.
PRIOR_BYTES = 16 << 20

_RAW = re.compile(r"<(script|style)\b", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def _trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that begins at each byte, and whether it lies in one text and has letters only or one space."""
    x = LOWER[raw].astype(np.uint32)
    letter = (x >= 97) & (x <= 122) | (x >= 128)
    x[~letter] = 32
    n = len(x)
    ok = np.zeros(n, bool)
    code = np.zeros(n, np.uint32)
    if n >= 3:
        code[:-2] = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        ok[:-2] = (letter[:-2].view(np.int8) + letter[1:-1].view(np.int8) + letter[2:].view(np.int8)) >= 2
        for k in (1, 2):
            cut = offsets[1:-1] - k
            ok[cut[cut >= 0]] = False
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(16)).astype(np.int64), ok


def train(rows: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods by trigram bucket, the last row for ``und``.

    The sample is bounded by ``sample_rows`` texts of each language; the counts of a
    language are one fixed-size array.
    """
    named = rows.filter(F.col(language).isNotNull() & (F.trim(language) != "") & F.col(text).isNotNull()).select(F.lower(language).alias("_l"), F.col(key).cast("long").alias("key"))
    # The rows of least hash are found among those below a bound that about four times as many rows meet as are needed, so
    # that no task gets more of a language than that, however frequent it is.
    counts = materialise(named.groupBy("_l").agg(F.count("*").alias("_of")), "counts")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    likely = named.join(F.broadcast(counts) if small_enough(counts) else counts, "_l").filter(place.cast("double") * F.col("_of") < 4 * sample_rows * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy(place, "key"))
    ids = materialise(likely.withColumn("_n", rank).filter(F.col("_n") <= sample_rows).select("key", "_l").distinct(), "sample")
    languages = sorted(r["_l"] for r in ids.select("_l").distinct().collect())  # one row for each language
    counts = np.zeros((len(languages) + 1, BUCKETS), np.float32)
    if languages:
        chosen = rows.select(F.col(key).cast("long").alias("key"), F.lower(language).alias("_l"), F.col(text).alias("text"))
        chosen = chosen.join(F.broadcast(ids) if small_enough(ids) else ids, ["key", "_l"], "left_semi")

        def run(batches):
            release_tools()
            total: dict[str, np.ndarray] = {}  # of the languages that this task meets
            for batch in batches:
                names = batch.column(0).to_pylist()
                raw, offsets = text_buffers(batch.column(1))
                for i, j in blocks(offsets):
                    own = offsets[i : j + 1] - offsets[i]
                    bucket, ok = _trigrams(raw[offsets[i] : offsets[j]], own)
                    for k in range(j - i):
                        span = slice(own[k], own[k + 1])
                        total.setdefault(names[i + k], np.zeros(BUCKETS, np.int64))
                        total[names[i + k]] += np.bincount(bucket[span][ok[span]], minlength=BUCKETS)
            for name, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([languages.index(name)] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["l", "b", "n"])

        grouped = chosen.select("_l", "text").mapInArrow(run, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
        with bounded_batches(rows.sparkSession):
            for r in grouped.toLocalIterator():  # at most languages * BUCKETS rows
                counts[r.l, r.b] = r.n
    counts += 0.5
    counts[-1] = 1
    return [*languages, UNKNOWN], np.log(counts / counts.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32)


def _text_of(html: str | None) -> str:
    """The text outside of tags, comments, scripts and styles, in one pass.

    What is not closed is no such thing: of an unclosed comment or script only the
    tag goes, and a ``<`` without any ``>`` behind it is text.
    """
    if html is None:
        return ""
    out, at, closed = [], 0, {"comment": True, "script": True, "style": True}
    while (lt := html.find("<", at)) >= 0:
        out.append(html[at:lt])
        end = -1
        if closed["comment"] and html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            closed["comment"] = end >= 0  # if none is left here, none is further on
            end += 3 if end >= 0 else 0
        elif m := _RAW.match(html, lt):
            name = m[1].lower()
            last = _CLOSING[name].search(html, m.end()) if closed[name] else None
            closed[name] = last is not None
            end = last.end() if last else -1
        if end < 0:
            end = html.find(">", lt) + 1
            if not end:
                out[-1] += html[lt:]
                return " ".join(out)
        at = end
    out.append(html[at:])
    return " ".join(out)


def _declared(html: str | None) -> str | None:
    """The language that the first ``html`` tag declares."""
    m = html and _HTML.search(html)
    if not m:
        return None
    end = html.find(">", m.end())
    found = _LANG.search(html, m.end(), end if end >= 0 else len(html))
    return found[1].lower() if found else None


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(a: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).reshape(-1)), a.shape[1]).cast(pa.list_(pa.float64()))


def text_evidence(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str, markup: bool, declared: str | None, host, key: str) -> DataFrame:
    """key, host, declared, n (trigrams), score (log-likelihood of each language) and p (the text's own posterior, zeros without text): one narrow row for each row."""
    languages, loglik = model
    shared = rows.sparkSession.sparkContext.broadcast(loglik)  # (languages + 1) * BUCKETS floats

    def run(batches):
        release_tools()
        table = shared.value
        for batch in batches:
            column, named = batch.column(3), batch.column(2)
            if markup:
                pages = column.to_pylist()
                named = pa.array(map(_declared, pages), pa.string())
                column = pa.array([_text_of(p) for p in pages], pa.string())
            raw, offsets = text_buffers(column)
            for i, j in blocks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                bucket, ok = _trigrams(raw[offsets[i] : offsets[j]], own)
                total = np.zeros(len(bucket) + 1)
                np.cumsum(ok, out=total[1:])
                n = total[own[1:]] - total[own[:-1]]
                score = np.empty((j - i, len(languages)))
                for k in range(len(languages)):
                    v = np.where(ok, table[k][bucket], np.float32(0))
                    np.cumsum(v, dtype=np.float64, out=total[1:])
                    score[:, k] = total[own[1:]] - total[own[:-1]]
                score *= np.minimum(1.0, EFFECTIVE / np.maximum(n, 1))[:, None]
                p = np.where((n > 0)[:, None], softmax(score), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), named.slice(i, j - i), pa.array(n.astype(np.int64)), _rows(score), _rows(p)], ["key", "host", "declared", "n", "score", "p"])

    columns = [F.col(key).cast("long").alias("key"), host.alias("host"), (F.lower(declared) if declared else F.lit(None)).cast("string").alias("declared"), F.col(text).alias("text")]
    return rows.select(*columns).mapInArrow(run, "key long, host string, declared string, n long, score array<double>, p array<double>")


def fuse(evidence: DataFrame, languages: list[str], accept: float = ACCEPT) -> DataFrame:
    """key, host, declared, lang, probability, accepted, from :func:`text_evidence`'s rows (materialised)."""
    k = len(languages)
    soft = evidence.withColumn("domain", F.regexp_extract("host", r"[^.]+\.[^.]+$|^[^.]+$", 0)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    sums = lambda c: [F.sum(F.col(c)[i]).alias(f"s{i}") for i in range(k)]
    vector = F.array(*[F.col(f"s{i}") for i in range(k)])
    by_host = materialise(soft.groupBy("host", "domain", "suffix").agg(*sums("p")).select("host", "domain", "suffix", vector.alias("of_host")), "hosts")
    up = lambda key, name: by_host.groupBy(key).agg(*sums("of_host")).select(key, vector.alias(name))
    total = by_host.agg(*sums("of_host")).first()  # one row
    overall = np.array([total[i] or 0.0 for i in range(k)]) + 1.0
    n_suffix, n_declared = max(1, by_host.select("suffix").distinct().count()), max(1, evidence.select("declared").distinct().count())
    table = materialise(by_host.join(up("domain", "of_domain"), "domain").join(up("suffix", "of_suffix"), "suffix").select("host", "of_host", "of_domain", F.when(F.col("suffix") != "", F.col("of_suffix")).alias("of_suffix")), "priors")
    named = materialise(soft.filter("declared is not null").groupBy("declared").agg(*sums("p")).select("declared", vector.alias("of_declared")), "declared")
    # Hot hosts and declarations load no task where these are broadcast; larger ones are plain sides of joins that Spark can split.
    most = PRIOR_BYTES // (24 * k + 64)
    full = evidence.join(F.broadcast(table) if small_enough(table, most) else table, "host", "left").join(F.broadcast(named) if small_enough(named, most) else named, "declared", "left")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = lambda name: batch.column(name).fill_null(pa.scalar([0.0] * k, pa.list_(pa.float64()))).flatten().to_numpy().reshape(-1, k)
            score, own = matrix("score"), matrix("p")
            less = lambda name: np.maximum(matrix(name) - own, 0.0)  # noqa: E731  without the row's own share
            smooth = lambda x, above: (x + SMOOTH * above) / (x.sum(1, keepdims=True) + SMOOTH)
            given = lambda name: np.array(batch.column(name).is_valid())[:, None]
            prior = smooth(less("of_host"), smooth(less("of_domain"), overall / overall.sum()))
            sum_ = score + np.log(prior)
            for name, kinds in (("of_suffix", n_suffix), ("of_declared", n_declared)):
                sum_ += np.where(given(name), np.log((less(name) + ADD) / (overall - own + ADD * kinds)), 0.0)
            post = softmax(sum_)
            best, some = post.argmax(1), batch.column("n").to_numpy() > 0
            lang = np.where(some, np.array(languages, object)[best], UNKNOWN)
            p = np.where(some, post[np.arange(len(post)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), batch.column("declared"), pa.array(lang, pa.string()), pa.array(p), pa.array((lang != UNKNOWN) & (p >= accept))], ["key", "host", "declared", "lang", "probability", "accepted"])

    columns = ("key", "host", "declared", "n", "score", "p", "of_host", "of_domain", "of_suffix", "of_declared")
    return full.select(*columns).mapInArrow(run, "key long, host string, declared string, lang string, probability double, accepted boolean")


def page_languages(pages: DataFrame, training: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, declared, lang, probability, accepted: one row for each page. ``training`` has doc_id, text and lang."""
    model = train(training)
    host, _ = host_and_path(url)
    evidence = materialise(text_evidence(pages, model, html, True, None, host, page_id), "evidence")
    return fuse(evidence, model[0]).withColumnRenamed("key", "page_id")


def document_languages(docs: DataFrame, text: str = "text", declared: str = "lang", source: str = "source", doc_id: str = "doc_id", use_declared: bool = True) -> DataFrame:
    """doc_id, lang, probability, accepted: one row for each document; its source counts as host.

    ``declared`` labels the training rows. It is evidence for its own row as well
    unless ``use_declared`` is false.
    """
    model = train(docs, text, declared, doc_id)
    evidence = materialise(text_evidence(docs, model, text, False, declared if use_declared else None, F.coalesce(F.col(source), F.lit("")), doc_id), "evidence")
    return fuse(evidence, model[0]).select(F.col("key").alias("doc_id"), "lang", "probability", "accepted")
