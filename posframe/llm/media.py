"""Audio columns: chroma fingerprints, and the alignment of recordings with a catalogue of known ones.

A recording's samples become frames, each frame's spectrum twelve pitch classes, and the classes over time an image. Haar
filters on the image's integral give sixteen two-bit answers at each place: a 32-bit print. Two recordings are aligned by
the histogram of offsets at which they share a print; every offset with enough votes is then judged by the share of
differing bits over the whole overlap, and all that pass are given.

The known recordings' prints, taken at every phase of the hop so that a copy at any offset falls on frames of its own, are
a table with a row for each print and place. Documents are fingerprinted once. A filter of FILTER_BITS bits, whatever the
catalogue's size, leaves the prints that the catalogue may have; these meet the table in a join, whose hot prints adaptive
execution splits, and grouped counts are the votes. Only documents and known recordings with enough votes are compared
bit by bit. Frames are computed for many recordings at once, a bounded number of samples at a time.

Defined results
---------------
* Null, empty or too short recordings have no prints and no alignment.
* A WAV container is decoded (PCM of 8 or 16 bits, channels averaged); other bytes are taken as unsigned 8-bit PCM.
* Equal votes: fewer bit errors, then the smallest catalogue id, then the smallest offset comes first. Null ids and repeated rows
  are fingerprinted like any row; a known recording without an id is left out, a repeated one counts once; an empty table or
  catalogue gives empty results or no alignments; other columns are neither read nor in the way.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, ship

SAMPLES_AT_ONCE = 1 << 18
#: Bits of the filter that goes to the workers: 2 MB.
FILTER_BITS = 1 << 24


@dataclass(frozen=True)
class Chroma:
    """How prints are taken. The defaults suit very short recordings; music takes window 4096, hop 1365, rate 11025."""

    rate: int = 8000
    window: int = 64
    hop: int = 16
    width: int = 4
    lowest_hz: float = 100.0
    threshold: float = 0.15

    def pitch_classes(self) -> np.ndarray:
        """(bins, 12): which pitch class each bin of the spectrum adds to."""
        hz = np.fft.rfftfreq(self.window, 1 / self.rate)
        out = np.zeros((len(hz), 12))
        for k, f in enumerate(hz):
            if f >= self.lowest_hz:
                out[k, round(12 * np.log2(f / 440)) % 12] = 1
        return out

    def filters(self) -> list[tuple[int, int, int]]:
        """(kind, lowest class, height) of the sixteen filters: four kinds over the pitch axis, by rule."""
        return [(i % 4, (3 * i) % 9, 2 + i // 4 % 3) for i in range(16)]

    def frames_of(self, samples: int) -> int:
        return max(0, (samples - self.window) // self.hop + 1)

    def prints_of(self, samples: int) -> int:
        return max(0, self.frames_of(samples) - self.width + 1)

    def image(self, samples: np.ndarray) -> np.ndarray:
        """(frames, 12): each frame's pitch classes, of unit length where there is sound."""
        if len(samples) < self.window:
            return np.zeros((0, 12))
        frames = np.lib.stride_tricks.sliding_window_view(samples, self.window)[:: self.hop]
        power = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * np.hanning(self.window), axis=1)) ** 2
        classes = power @ self.pitch_classes()
        length = np.sqrt((classes**2).sum(axis=1, keepdims=True))
        return np.divide(classes, length, out=np.zeros_like(classes), where=length > 1e-9)

    def prints(self, image: np.ndarray) -> np.ndarray:
        """uint32 of each place of the image: sixteen filters, two bits each in Gray code."""
        n, w = len(image) - self.width + 1, self.width
        if n <= 0:
            return np.zeros(0, np.uint32)
        integral = np.pad(image.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

        def box(t0: int, t1: int, low: int, high: int) -> np.ndarray:
            a, b = integral[t0 : t0 + n], integral[t1 : t1 + n]
            return b[:, high] - a[:, high] - b[:, low] + a[:, low]

        out = np.zeros(n, np.uint32)
        for kind, low, height in self.filters():
            high, half, middle = min(12, low + height), w // 2, low + (min(12, low + height) - low) // 2
            whole = box(0, w, low, high)
            if kind == 0:  # later against earlier
                part = box(half, w, low, high)
            elif kind == 1:  # upper against lower
                part = box(0, w, middle, high)
            elif kind == 2:  # the diagonals
                part = box(0, half, low, middle) + box(half, w, middle, high)
            else:  # the middle of the time against its ends
                part = box(w // 4, w - w // 4, low, high)
            value = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
            answer = np.digitize(np.round(value, 9), (-self.threshold, 0.0, self.threshold))
            out = out << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[answer]
        return out


def samples_of(recording: bytes | None) -> np.ndarray:
    """A recording's samples, as floats about zero."""
    if not recording:
        return np.zeros(0)
    if recording[:4] == b"RIFF" and recording[8:12] == b"WAVE":
        try:
            with wave.open(io.BytesIO(recording)) as f:
                width, channels, data = f.getsampwidth(), f.getnchannels(), f.readframes(f.getnframes())
            if width in (1, 2):
                values = (np.frombuffer(data, np.uint8) - 128.0) if width == 1 else np.frombuffer(data, "<i2").astype(np.float64)
                return values[: len(values) // channels * channels].reshape(-1, channels).mean(axis=1)
        except (wave.Error, EOFError):
            pass
    return np.frombuffer(recording, np.uint8) - 128.0


def prints_of_all(recordings: list[bytes | None], chroma: Chroma) -> list[np.ndarray]:
    """The prints of each recording; the spectra of many short ones are computed together."""
    out: list[np.ndarray] = []
    waiting: list[np.ndarray] = []
    held = 0

    def together() -> None:
        """Each recording starts at a multiple of the hop; frames that span two are skipped when its own are cut out."""
        padded = [np.pad(s, (0, -len(s) % chroma.hop)) for s in waiting]
        image = chroma.image(np.concatenate([*padded, np.zeros(chroma.window)]))
        at = 0
        for s, p in zip(waiting, padded):
            out.append(chroma.prints(image[at : at + chroma.frames_of(len(s))]))
            at += len(p) // chroma.hop
        waiting.clear()

    def alone(s: np.ndarray) -> None:
        step = SAMPLES_AT_ONCE // chroma.hop * chroma.hop
        images = [chroma.image(s[at : at + step + chroma.window - chroma.hop]) for at in range(0, len(s), step)]
        out.append(chroma.prints(np.concatenate(images)[: chroma.frames_of(len(s))]))

    for recording in recordings:
        s = samples_of(recording)
        if waiting and held + len(s) > SAMPLES_AT_ONCE:
            together()
            held = 0
        if len(s) > SAMPLES_AT_ONCE:
            alone(s)
        else:
            waiting.append(s)
            held += len(s)
    if waiting:
        together()
    return out


def catalogued(known: DataFrame, recording: Column, chroma: Chroma, known_id: str) -> DataFrame:
    """(entry, item_id, phase, known): the prints of each known recording at each phase, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, recordings = (c.to_pylist() for c in batch.columns)
            for phase in range(chroma.hop):
                prints = prints_of_all([r[phase:] for r in recordings], chroma)
                some = [i for i, p in enumerate(prints) if len(p)]
                columns = [pa.array([rows[i] * chroma.hop + phase for i in some], pa.int64()), pa.array([ids[i] for i in some], pa.int64()), pa.array([phase] * len(some), pa.int32()), pa.array([prints[i].astype(np.int64) for i in some], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "item_id", "phase", "known"])

    rows = known.select(known[known_id].cast("long").alias("item_id"), recording.cast("binary").alias("r")).filter("item_id is not null and r is not null").distinct()
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "item_id", "r").mapInArrow(run, "entry long, item_id long, phase int, known array<long>"), "catalogue")


def _passing(prints: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which prints the filter lets pass."""
    bit = (prints ^ prints >> 13) & (64 * len(words) - 1)
    return (words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _filter_of(index: DataFrame) -> np.ndarray:
    """FILTER_BITS bits as 64-bit words, set for the prints of the index; that many come to the driver, whatever the index has."""
    bit = F.col("print").bitwiseXOR(F.shiftright("print", 13)).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = index.select(bit.alias("bit")).distinct().select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("word"))
    words = bits.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64).view(np.uint64)
    return out


def fingerprinted(rows: DataFrame, recording: Column, chroma: Chroma = Chroma(), doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, prints) for each row: the recording's prints in order, as longs."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = prints_of_all(batch.column(1).to_pylist(), chroma)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype(np.int64) for p in prints], pa.list_(pa.int64()))], names=["doc_id", "prints"])

    return rows.select(rows[doc_id].cast("long").alias("doc_id"), recording.cast("binary").alias("recording")).mapInArrow(run, "doc_id long, prints array<long>")


def aligned(rows: DataFrame, recording: Column, known: DataFrame, known_recording: Column, chroma: Chroma = Chroma(), most_errors: float = 0.1, least_votes: int = 2, doc_id: str = "doc_id", known_id: str = "item_id") -> DataFrame:
    """One row per recording: doc_id, n_prints, prints_sha256, item_id, votes, offset, bit_errors, links.

    links: all alignments that share least_votes prints or more with most_errors differing bits at most, the best first. The
    offset is where the known recording begins in this one, in samples; one less than a hop from a better one of the same
    recording is the same passage and left out.
    item_id and what follows are the first one's, null where there is none.
    """
    ship(rows.sparkSession)
    catalogue = catalogued(known, known_recording, chroma, known_id)
    # a print of silence is everywhere and tells nothing
    silence = int(chroma.prints(np.zeros((chroma.width, 12)))[0])
    index = catalogue.select("entry", F.posexplode("known").alias("at", "print")).filter(F.col("print") != silence)
    index = cut(index, "print-index")
    words = _filter_of(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [p.astype(np.int64) for p in prints_of_all(batch.column(2).to_pylist(), chroma)]
            hits = [np.flatnonzero(_passing(p, words) & (p != silence)) for p in prints]
            kept = [p if len(h) >= least_votes else None for p, h in zip(prints, hits)]
            hashes = [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in prints]
            columns = [batch.column(0), batch.column(1), pa.array(map(len, prints), pa.int64()), pa.array(hashes, pa.string()), pa.array([h if p is not None else [] for p, h in zip(kept, hits)], pa.list_(pa.int32())), pa.array(kept, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_prints", "prints_sha256", "hits", "prints"])

    given = rows.select(rows[doc_id].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), recording.cast("binary").alias("recording"))
    docs = cut(given.mapInArrow(run, "doc_id long, row long, n_prints long, prints_sha256 string, hits array<int>, prints array<long>"), "prints")

    hits = docs.select("row", "prints", F.explode("hits").alias("place")).select("row", "place", F.get("prints", F.col("place")).alias("print"))
    votes = hits.join(index, "print").groupBy("row", "entry", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("votes"))
    votes = cut(votes.filter(F.col("votes") >= least_votes), "votes")
    met = votes.join(catalogue, "entry").join(docs.select("row", "prints", "n_prints"), "row")
    start, end = F.greatest("shift", F.lit(0)), F.least(F.col("n_prints"), F.col("shift") + F.size("known")).cast("int")
    differing = F.zip_with(F.slice("prints", start + 1, end - start), F.slice("known", start - F.col("shift") + 1, end - start), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    errors = F.aggregate(differing, F.lit(0), lambda n, x: n + x) / (32 * (end - start))
    judged = met.select("row", (-F.col("votes")).alias("unvoted"), errors.alias("bit_errors"), "item_id", (F.col("shift").cast("long") * chroma.hop - F.col("phase")).alias("offset"))
    found = judged.filter(F.col("bit_errors") <= most_errors).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("unvoted", "bit_errors", "item_id", "offset"))).alias("found"))

    def apart(links: Column, link: Column) -> Column:
        """links and the next one, unless it is the same passage as a better one, seen through a neighbouring phase."""
        same = F.exists(links, lambda x: (x["item_id"] == link["item_id"]) & (F.abs(x["offset"] - link["offset"]) < chroma.hop))
        return F.when(same, links).otherwise(F.concat(links, F.array(link)))

    kind = "array<struct<unvoted: long, bit_errors: double, item_id: long, offset: long>>"
    thin = F.aggregate(F.col("found").cast(kind), F.array().cast(kind), apart)
    out = docs.select("doc_id", F.col("row").alias("of"), "n_prints", "prints_sha256").join(cut(found.select("row", thin.alias("links")), "links"), F.col("of") == F.col("row"), "left")
    out = out.withColumn("links", F.coalesce("links", F.array().cast(kind)))
    best = F.get("links", F.lit(0))
    links = F.transform("links", lambda x: F.struct(x["item_id"].alias("item_id"), (-x["unvoted"]).alias("votes"), x["offset"].alias("offset"), x["bit_errors"].alias("bit_errors")))
    return out.select("doc_id", "n_prints", "prints_sha256", best["item_id"].alias("item_id"), (-best["unvoted"]).alias("votes"), best["offset"].alias("offset"), best["bit_errors"].alias("bit_errors"), links.alias("links"))
