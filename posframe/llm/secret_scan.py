"""Secrets in text: three base rules, and strings that look random by two character Markov models, native throughout.

The models are first-order chains over ASCII characters, one of random strings and one of ordinary identifiers, counted
from labelled samples by a grouped aggregation; the table of log-likelihood ratios, at most 128 x 128 numbers whatever
the sample, becomes a literal of the scan. Every long run of the characters that keys and tokens use is a candidate, and
so is every long run of letters and digits inside it; a candidate is a secret where its ratio, summed over its
transitions, exceeds a threshold: the ratio that FALSE_POSITIVES of the ordinary strings of a second sample exceed, one
that the models are not fitted on, and that at which the odds are even where one long string in RARITY is random. The scan is one projection: no shuffle.

Defined results: null and empty text have no spans; null ids, repeated rows and ties are scanned like any row; an empty
table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import apart, count_of, found, let, written
from .shared import text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN, ACCESS, HEX, RANDOM = range(4)
#: Fixed values of the base rules.
ASSIGN_PATTERN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""
ACCESS_PATTERN = r"AKIA[A-Z0-9]{14,}"
HEX_PATTERN = r"[0-9a-f]{16,}"
#: Candidates of the models: runs of the characters of keys, and of letters and digits alone.
CANDIDATE, PART = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9]{20,}"
#: The codes between which all characters of candidates lie.
FIRST, LAST = ord("+"), ord("z")
#: Share of ordinary strings that may pass, and strings of each kind in a sample.
FALSE_POSITIVES, RARITY, SAMPLE = 0.001, 1000, 4000

#: Words that ordinary identifiers of the default samples are made of, beside words made of syllables by rule.
WORDS = (
    "account action address amount archive array author balance batch block border buffer button cache call category center change channel check child class "
    "client clock close code collection color column command comment compute config connection content context control copy count create current customer data "
    "default delete detail device direction display document domain download driver email enable engine entry error event example export factory feature field "
    "file filter final folder format frame function global group handler header height history home image import index info input instance integer internal item "
    "job key label language layer layout length level library limit line list load local location logger main manager mapping market master matrix member memory "
    "message method model module month name network node note number object offset open option order output owner package page panel parent part path pattern "
    "payment person picture place player plugin point policy position price process product profile project property query queue range record region release "
    "remote report request resource response result return role route rule sample schedule schema scope screen search section select sequence server service "
    "session shape source space stack state status step storage stream string style summary system table target task team template text theme thread through "
    "time title token tool total track transaction translation type under unit update upload user utility value variable vector version video view visible wait "
    "warning watch weight width window without word worker wrapper write year zone"
).split()


#: Syllables of several languages.
ONSETS = ("b", "c", "ch", "d", "f", "g", "gl", "h", "j", "k", "l", "m", "n", "p", "pf", "qu", "r", "s", "sch", "st", "t", "th", "tr", "tt", "v", "w", "y", "z")
RIMES = ("a", "e", "i", "o", "u", "an", "ai", "eau", "ei", "eit", "el", "ent", "er", "es", "ich", "ie", "in", "ing", "ion", "ly", "on", "os", "ou", "um", "ung", "y")


def default_samples(spark: SparkSession, n: int = SAMPLE, first: int = 0) -> DataFrame:
    """(text, random): n strings of each kind, made by rule from the numbers from `first` on; other numbers, other strings.

    Random ones are digests in several alphabets, of letters alone too. Ordinary ones are words, of the list and of
    syllables, joined as in code, paths, addresses, dates and compounds, and rulers of one character.
    """
    ids = spark.range(first, first + n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    second = F.sha2(F.concat(F.lit("more"), F.col("id").cast("string")), 256)
    number = lambda salt, below: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(below)).cast("int")
    base64 = F.translate(F.base64(F.unhex(F.concat(digest, second))), "=\r\n", "")
    letters = F.translate(base64, "0123456789+/", "")
    kinds = [digest, F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), F.translate(base64, "+/", "-_"), base64, F.translate(base64, "+/", ""), letters, F.lower(letters), F.upper(letters)]
    strings = F.get(F.array(*kinds), number(1, len(kinds)))
    syllables = [c + v for c in ONSETS for v in RIMES]
    tables = F.struct(F.split(F.lit(" ".join(WORDS)), " ").alias("words"), F.split(F.lit(" ".join(syllables)), " ").alias("syllables"))

    def word(of: Column, i: int) -> Column:
        made = F.concat(*[F.get(of["syllables"], number(100 * i + j, len(syllables))) for j in range(3)])
        return F.when(number(50 + i, 3) == 0, made).otherwise(F.get(of["words"], number(i, len(WORDS))))

    def joined(p: Column) -> Column:
        parts = [F.get(p, F.lit(i)) for i in range(5)]
        camel = F.concat(parts[0], *[F.initcap(x) for x in parts[1:]])
        date = F.concat_ws("-", number(20, 40) + 1990, F.lpad(number(21, 12) + 1, 2, "0"), F.lpad(number(22, 28) + 1, 2, "0"))
        ways = [
            F.concat_ws("_", *parts), camel, F.upper(F.concat_ws("_", *parts)), F.concat_ws("/", *parts), F.concat_ws("-", *parts), F.concat(*parts[:3]), F.upper(F.concat(*parts[:3])),
            F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), (number(9, 130) + 1900).cast("string")), F.concat(date, F.lit("-"), parts[0], F.lit("-"), parts[1]),
            F.concat(parts[0], F.lit("="), parts[1], F.lit("/"), parts[2], number(23, 100).cast("string")), F.concat(*[F.initcap(x) for x in parts[:3]], number(24, 20).cast("string")),
            F.repeat(F.get(F.split(F.lit("-=_/+x0"), ""), number(25, 7)), F.lit(30)),
        ]
        return F.get(F.array(*ways), number(26, len(ways)))

    identifiers = let(let(tables, lambda of: F.array(*[word(of, i) for i in range(2, 7)])), joined)
    random = ids.select(F.substring(strings, F.lit(1), F.lit(20) + number(27, 21)).alias("text"), F.lit(True).alias("random"))
    return random.unionByName(ids.select(identifiers.alias("text"), F.lit(False).alias("random")))


class MarkovModels:
    """Log-likelihood ratios of the transitions between ASCII characters: random against ordinary."""

    def __init__(self, ratios: list[float]):
        self.ratios = ratios

    @classmethod
    def trained(cls, samples: DataFrame, smoothing: float = 0.5) -> MarkovModels:
        """samples: (text, random). Transitions are counted where the samples are; 2 x 128 x 128 counts come back at most."""
        letters = F.transform(F.split("text", ""), lambda c: F.least(F.ascii(c), F.lit(127)))
        steps = F.transform(F.sequence(F.lit(1), F.size(letters) - 1), lambda i: F.get(letters, i - 1) * 128 + F.get(letters, i))
        counted = samples.filter("length(text) > 1").select("random", F.explode(steps).alias("step")).groupBy("random", "step").count().collect()
        seen = {(r["random"], r["step"]): r["count"] for r in counted}
        used = sorted({s // 128 for _, s in seen} | {s % 128 for _, s in seen})
        out = {kind: [sum(seen.get((kind, a * 128 + b), 0) for b in used) + smoothing * len(used) for a in range(128)] for kind in (True, False)}
        ratios = [math.log((seen.get((True, a * 128 + b), 0) + smoothing) / out[True][a]) - math.log((seen.get((False, a * 128 + b), 0) + smoothing) / out[False][a]) for a in range(128) for b in range(128)]
        return cls(ratios)

    def score(self, token: Column) -> Column:
        """The log-likelihood ratio of a token of the characters FIRST to LAST, natural logarithm; linear in its length.

        A plan that names it holds the ratios of those characters.
        """
        codes = range(FIRST, LAST + 1)
        table = F.split(F.lit(",".join(f"{self.ratios[a * 128 + b]:.4f}" for a in codes for b in codes)), ",").cast("array<double>")

        def step(state: Column, letter: Column) -> Column:
            code = F.ascii(letter) - FIRST
            ratio = F.coalesce(F.get(table, state["before"] * len(codes) + code), F.lit(0.0))
            return F.struct(code.alias("before"), (state["sum"] + F.when(state["before"] < 0, F.lit(0.0)).otherwise(ratio)).alias("sum"))

        return F.aggregate(F.split(token, ""), F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def threshold_of(models: MarkovModels, samples: DataFrame, false_positives: float = FALSE_POSITIVES) -> float:
    """The ratio that a share of false_positives of the samples' ordinary strings exceed, and log RARITY at least."""
    scores = samples.filter(~F.col("random")).select(models.score(F.col("text")).alias("score"))
    return max(math.log(RARITY), scores.agg(F.percentile("score", 1 - false_positives)).first()[0] or 0.0)


def base_spans(text: Column) -> Column:
    """The spans of the three base rules; a match that fails its length is dropped, not tried again inside."""
    assign = found(text, ASSIGN, ASSIGN_PATTERN, r"(?i:passw|secret|token|api_?key)", lambda m: F.regexp(m, F.lit(ASSIGN_VALUE)))
    return F.concat(assign, found(text, ACCESS, ACCESS_PATTERN), found(text, HEX, HEX_PATTERN))


def scanned(docs: DataFrame, models: MarkovModels | None = None, threshold: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added, the arrays of spans by rule and by model (see `spans`).

    A run of letters and digits is added where the whole candidate that it stands in is not.
    """
    spark = docs.sparkSession
    models = models or MarkovModels.trained(default_samples(spark))
    threshold = threshold_of(models, default_samples(spark, first=SAMPLE)) if threshold is None else threshold
    body = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))
    candidates = F.concat(found(F.col("text"), RANDOM, CANDIDATE), found(F.col("text"), RANDOM + 1, PART))
    rows = body.select("doc_id", base_spans(F.col("text")).alias("base"), candidates.alias("candidates"))
    rows = rows.select("doc_id", "base", F.filter(apart(F.col("candidates"), F.col("base")), lambda s: models.score(s["match"]) > threshold).alias("random"))
    whole, parts = F.filter("random", lambda s: s["kind"] == RANDOM), F.filter("random", lambda s: s["kind"] > RANDOM)
    rows = rows.select("doc_id", "base", whole.alias("whole"), parts.alias("parts"))
    added = F.concat("whole", apart(F.col("parts"), F.col("whole")))
    return rows.select("doc_id", "base", F.transform(added, lambda s: s.withField("kind", F.lit(RANDOM))).alias("added"))


def report(scanned_rows: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of the rows that `scanned` gives."""
    counts = [count_of(F.col("base"), kind).alias(f"n_{KINDS[kind]}") for kind in (ASSIGN, ACCESS, HEX)]
    digest = F.sha2(written(F.col("base"), KINDS, by_start=True).cast("binary"), 256)
    every = written(F.concat("base", "added"), KINDS, by_start=True)
    return scanned_rows.select("doc_id", *counts, digest.alias("base_sha256"), every.alias("spans"), F.size("added").cast("long").alias("n_random"))
