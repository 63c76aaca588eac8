"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in one posterior: the likelihood of the text under trigram models of its bytes, the language
that the markup declares, the address suffix, and the host. Suffix and host speak as priors: grouped sums of the text
posteriors, a host's smoothed by its suffix's and that by the whole corpus's, a document's own share taken out. A model
of no language (all trigrams alike) competes with the others and takes texts that none of them explains.

The trigram models are fitted on a bounded sample of labelled rows (SAMPLE_ROWS of each label, by a hash of the id), so that
a rare language has its model at every size; likelihoods, counts and priors then cover every row and whole texts. A host with a third of all rows is summed before the shuffle, and the
priors, a written table, are joined so that adaptive execution can split its rows.

Defined results
---------------
* Null or empty text, or one shorter than a trigram, is no evidence: the declaration and the priors decide; where nothing
  known is declared either, the language is `und` and the row is rejected, as priors alone tell nothing of a row.
* Null host or suffix is a group of its own; a null or unknown declaration is no evidence.
* Null ids, repeated rows and ties: every row is judged by itself; of equal posteriors the first language in order wins.
* Without any label there is no model and nothing can be judged: `accepted` keeps all rows.
* An empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, keep_rows, lean, ship, text_of

UND = "und"
#: Labelled rows of each language that the models are fitted on.
SAMPLE_ROWS = 1000
BUCKETS = 1 << 13
#: Weight of a trigram (neighbours share two of three bytes), belief in a declaration, and pseudo-counts of the priors.
TRIGRAM_WEIGHT, DECLARED_BELIEF, HOST_STRENGTH, SUFFIX_STRENGTH = 1 / 3, 0.9, 10.0, 10.0
#: What the language-less model may claim before any evidence.
UND_PRIOR = 1e-3
#: Bytes of a text taken at once.
PIECE = 1 << 18


def trigrams(text: bytes) -> np.ndarray:
    """The buckets of the text's byte trigrams, A-Z in lower case, runs of other ASCII than letters as one space-like byte."""
    letters = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    letters[(letters < 128) & ((letters < 97) | (letters > 122))] = 32
    if len(letters) > 1:
        letters = letters[np.r_[True, (letters[1:] != 32) | (letters[:-1] != 32)]]
    if len(letters) < 3:
        return np.zeros(0, np.uint32)
    return ((letters[:-2] * 2654435761 + letters[1:-1] * 40503 + letters[2:] * 2246822519) % 4294967291 >> 7) % BUCKETS


def _pieces(text: bytes) -> Iterator[bytes]:
    for at in range(0, max(1, len(text)), PIECE):
        yield text[max(0, at - 2) : at + PIECE]


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", label: str = "lang") -> DataFrame:
    """About `rows` of the rows of each label, chosen by a hash of the id: the same rows at every run.

    A count per label comes to the driver, as do the models themselves.
    """
    labelled = docs.filter(docs[label].isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(docs[label]).count().collect()}
    if not counts:
        return labelled
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, rows / n))])[docs[label]]
    return labelled.filter((F.xxhash64(F.lit("sample"), docs[doc_id]) / F.lit(2.0**64) + 0.5) < share)


class TrigramModels:
    """Log-probabilities of trigram buckets for each language; the last column is the model of no language."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = [*languages, UND], table

    @classmethod
    def trained(cls, sample: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.2) -> TrigramModels:
        """Trigrams are counted where the rows are; a number per language and bucket comes back at most."""
        ship(sample.sparkSession)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    total = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    for piece in _pieces(body.as_py()):
                        total += np.bincount(trigrams(piece), minlength=BUCKETS)
            for name, total in sums.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(total[used])], names=["lang", "bucket", "n"])

        counted = sample.select(sample[label].alias("lang"), text_of(sample, text).cast("binary").alias("body")).mapInArrow(lean(count), "lang string, bucket long, n long")
        summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        languages = sorted(set(summed["lang"]))
        table = np.full((BUCKETS, len(languages) + 1), smoothing)
        table[:, -1] = 1
        for i, name in enumerate(languages):
            own = summed[summed["lang"] == name]
            table[own["bucket"].to_numpy(np.int64), i] += own["n"].to_numpy(np.int64)
        return cls(languages, np.log(table / table.sum(axis=0)).astype(np.float32))

    def likelihoods(self, text: bytes) -> tuple[np.ndarray, int]:
        """The text's log-likelihood under each model, trigrams weighted, and their number."""
        total, n = np.zeros(len(self.languages)), 0
        for piece in _pieces(text):
            grams = trigrams(piece)
            if len(grams):
                total += np.bincount(grams, minlength=BUCKETS) @ self.table if len(grams) > BUCKETS else self.table[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total * TRIGRAM_WEIGHT, n


def from_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The evidence of a table of documents: doc_id, text, host (the source), suffix and declared (none)."""
    nothing = F.lit(None).cast("string")
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text"), docs[source].cast("string").alias("host"), nothing.alias("suffix"), nothing.alias("declared"))


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The evidence of a table of raw pages: the text outside tags, host and suffix of the address, lang of the markup."""
    body = F.regexp_replace(F.coalesce(pages[html], F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(pages[url], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(pages[html], r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    named = lambda c: F.when(c != "", c)
    return pages.select(pages[page_id].cast("long").alias("doc_id"), body.alias("text"), named(host).alias("host"), named(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), named(declared).alias("declared"))


def _scored(rows: DataFrame, models: TrigramModels) -> DataFrame:
    """doc_id, mark, host, suffix, declared, n_trigrams and, for each model, l0, l1, ... (log-likelihood of the text)."""
    ship(rows.sparkSession)
    names = [f"l{i}" for i in range(len(models.languages))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts = np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows, np.int64)
            for i, body in enumerate(batch.column(5)):
                scores[i], counts[i] = models.likelihoods(body.as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(counts), *map(pa.array, scores.T)], names=["doc_id", "mark", "host", "suffix", "declared", "n_trigrams", *names])

    given = rows.select("doc_id", F.xxhash64("text").alias("mark"), "host", "suffix", "declared", F.col("text").cast("binary").alias("body"))
    return given.mapInArrow(lean(run), f"doc_id long, mark long, host string, suffix string, declared string, n_trigrams long, {', '.join(n + ' double' for n in names)}")


def _greatest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _posterior(logs: list[Column]) -> list[Column]:
    top = _greatest(logs)
    weights = [F.exp(x - top) for x in logs]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def identified(rows: DataFrame, models: TrigramModels) -> DataFrame:
    """rows (doc_id, text, host, suffix, declared) -> doc_id, mark, lang, probability, text_lang, n_trigrams, host_share.

    host_share is what the smoothed prior of the row's host gives the chosen language.
    """
    k = range(len(models.languages))
    start = [math.log(UND_PRIOR if name == UND else (1 - UND_PRIOR) / max(1, len(models.languages) - 1)) for name in models.languages]
    scored = _scored(rows, models)
    scored = cut(scored.select("*", *[p.alias(f"p{i}") for i, p in enumerate(_posterior([F.col(f"l{i}") + start[i] for i in k]))]), "likelihoods")
    by_host = cut(scored.groupBy("suffix", "host").agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"s{i}") for i in k]), "hosts")
    by_suffix = by_host.groupBy(F.col("suffix").alias("of")).agg(F.sum("n").alias("m"), *[F.sum(f"s{i}").alias(f"t{i}") for i in k])
    corpus = by_host.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in k]).first()
    whole = [((corpus[f"s{i}"] or 0.0) + 1.0) / ((corpus["n"] or 0) + len(models.languages)) for i in k]
    joined = by_host.join(by_suffix, F.col("suffix").eqNullSafe(F.col("of")))
    upper = [(F.col(f"t{i}") + SUFFIX_STRENGTH * whole[i]) / (F.col("m") + SUFFIX_STRENGTH) for i in k]
    priors = cut(joined.select(F.col("suffix").alias("of_suffix"), F.col("host").alias("of_host"), "n", *[f"s{i}" for i in k], *[u.alias(f"u{i}") for i, u in enumerate(upper)]), "priors")
    met = scored.join(priors, F.col("suffix").eqNullSafe(F.col("of_suffix")) & F.col("host").eqNullSafe(F.col("of_host")))
    prior = [(F.greatest(F.col(f"s{i}") - F.col(f"p{i}"), F.lit(0.0)) + HOST_STRENGTH * F.col(f"u{i}")) / (F.col("n") - 1 + HOST_STRENGTH) for i in k]
    known = F.coalesce(F.col("declared").isin(*[x for x in models.languages if x != UND]), F.lit(False)) if len(models.languages) > 1 else F.lit(False)
    others = math.log((1 - DECLARED_BELIEF) / max(1, len(models.languages) - 1))
    said = [F.when(known, F.when(F.col("declared") == name, math.log(DECLARED_BELIEF)).otherwise(others)).otherwise(0.0) for name in models.languages]
    met = met.select("*", *[q.alias(f"q{i}") for i, q in enumerate(prior)])
    fused = met.select("*", *[f.alias(f"f{i}") for i, f in enumerate(_posterior([F.col(f"l{i}") + F.log(F.col(f"q{i}")) + said[i] for i in k]))])

    def best(prefix: str) -> Column:
        """The (probability, language, host share) with the highest probability, the first of equal ones."""
        return _greatest([F.struct(F.col(f"{prefix}{i}").alias("p"), F.lit(-i).alias("i"), F.lit(models.languages[i]).alias("lang"), F.col(f"q{i}").alias("share")) for i in k])

    silent = (F.col("n_trigrams") == 0) & ~known
    out = fused.select("doc_id", "mark", best("f").alias("f"), best("p").alias("p"), "n_trigrams", silent.alias("silent"))
    return out.select("doc_id", "mark", F.when(F.col("silent"), UND).otherwise(F.col("f.lang")).alias("lang"), F.col("f.p").alias("probability"), F.when(F.col("n_trigrams") > 0, F.col("p.lang")).otherwise(UND).alias("text_lang"), "n_trigrams", F.col("f.share").alias("host_share"))


def accepted(docs: DataFrame, models: TrigramModels | None = None, languages: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs in one of the languages (by default all that the models know), all columns as they are.

    Where nothing is labelled and no models are given, no row can be judged and all stay.
    """
    models = models or TrigramModels.trained(labelled_sample(docs, doc_id=doc_id), text)
    languages = languages or [x for x in models.languages if x != UND]
    if not languages:
        return docs
    decided = identified(from_documents(docs, doc_id, text, source), models)
    return keep_rows(docs, decided.select("doc_id", "mark", F.col("lang").isin(*languages).alias("kept")), doc_id, text)
