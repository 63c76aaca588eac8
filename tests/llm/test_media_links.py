"""Recordings that hold several known ones, and votes for alignments that fail."""

import numpy as np
import pytest

pytest.importorskip("posframe.llm")

from posframe.llm import media  # noqa: E402


@pytest.mark.parametrize("bits", [media.FILTER_BITS, 64])
def test_every_known_recording_is_linked(spark, monkeypatch, bits):
    monkeypatch.setattr(media, "FILTER_BITS", bits)
    r = np.random.default_rng(3)
    noise = lambda n: r.integers(0, 256, n, dtype=np.uint8).tobytes()
    known = [(i, noise(400)) for i in range(7)]
    doc, want = noise(317), set()
    for i, k in known:
        want.add((i, len(doc)))
        doc += k + noise(211 + 3 * i)
    a = spark.createDataFrame([(1, doc), (2, noise(900))], "doc_id long, audio binary")
    b = spark.createDataFrame(known, "item_id long, audio binary")
    got = {x["doc_id"]: x for x in media.aligned(a, a["audio"], b, b["audio"]).collect()}
    assert {(x["item_id"], x["offset"]) for x in got[1]["links"]} == want
    assert (got[1]["item_id"], got[1]["votes"]) == (got[1]["links"][0]["item_id"], got[1]["links"][0]["votes"])
    assert got[2]["links"] == [] and got[2]["item_id"] is None


def aligned_by_hand(recording, known, chroma, least_votes=2, most_errors=0.1):
    """Every offset of every known recording at every phase, one after another."""
    prints, found = media.prints_of_all([recording], chroma)[0], []
    silence = int(chroma.prints(np.zeros((chroma.width, 12)))[0])
    for i, k in {x for x in known if None not in x}:
        for phase in range(chroma.hop):
            theirs = media.prints_of_all([k[phase:]], chroma)[0]
            for shift in range(-len(theirs) + 1, len(prints)) if len(prints) else ():
                start, end = max(0, shift), min(len(prints), shift + len(theirs))
                mine, other = prints[start:end], theirs[start - shift : end - shift]
                votes = sum(a == b and a != silence for a, b in zip(mine.tolist(), other.tolist()))
                errors = sum((a ^ b).bit_count() for a, b in zip(mine.tolist(), other.tolist())) / (32 * (end - start))
                if votes >= least_votes and errors <= most_errors:
                    found.append((-votes, errors, i, shift * chroma.hop - phase))
    out = []
    for v, e, i, offset in sorted(found):
        if all(i != x[2] or abs(offset - x[3]) >= chroma.hop for x in out):
            out.append((v, e, i, offset))
    return [(i, -v, offset, round(e, 9)) for v, e, i, offset in out]


def test_links_are_those_of_brute_force(spark):
    r = np.random.default_rng(7)
    noise = lambda n: r.integers(0, 256, n, dtype=np.uint8).tobytes()
    tone = bytes((128 + 90 * np.sin(np.arange(300) * 0.7)).astype(np.uint8))  # one print is very common
    known = [(1, noise(260)), (2, tone), (3, noise(200)), (3, noise(150)), (4, None), (None, noise(200))]
    known += [known[0]]
    changed = bytearray(known[0][1])
    changed[100:104] = noise(4)
    docs = [(10, noise(77) + known[0][1] + noise(50) + known[2][1]), (11, tone + noise(40) + tone[:150]), (12, bytes(changed)), (12, bytes(changed)), (None, known[3][1]), (13, None), (14, b""), (15, noise(400)), (16, bytes([128]) * 300)]
    a = spark.createDataFrame(docs, "doc_id long, audio binary").selectExpr("*", "1 as row", "2 as hits", "3 as prints", "4 as links").repartition(3)
    b = spark.createDataFrame(known, "item_id long, audio binary").selectExpr("*", "1 as entry")
    got = media.aligned(a, a["audio"], b, b["audio"]).collect()
    links = sorted((str(x["doc_id"]), [(y["item_id"], y["votes"], y["offset"], round(y["bit_errors"], 9)) for y in x["links"]]) for x in got)
    assert links == sorted((str(i), aligned_by_hand(d or b"", known, media.Chroma())) for i, d in docs)
    assert sum(bool(x[1]) for x in links) >= 5
