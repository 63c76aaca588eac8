"""op10 over pages: markup, suffix and host each flip a result."""

import random

import pytest

pytest.importorskip("posframe.llm")

from posframe.llm import queries  # noqa: E402

WORDS = {"aa": "the and ing tion with that", "bb": "der und sch ich nicht eine"}
UNSURE = "zq"


def test_pages_are_judged_by_all_evidence(spark, tmp_path):
    r = random.Random(2)
    text = lambda lang, n: " ".join(r.choice(WORDS[lang].split()) for _ in range(n))
    docs = [(i, text(("aa", "bb")[i % 2], 40), ("aa", "bb")[i % 2], "s") for i in range(200)]
    pages, page = [], lambda url, body, lang="": pages.append((len(pages), url, f"<html{lang}><p>{body}</p></html>"))
    for suffix, lang in (("aa", "aa"), ("bb", "bb")):
        for i in range(40):
            page(f"http://h{i}.{suffix}/x", text(lang, 40))
    for lang in ("aa", "bb"):
        for _ in range(40):
            page(f"http://only-{lang}.com/x", text(lang, 40))
    first = len(pages)
    for lang in ("aa", "bb"):
        page("http://new.org/", "", f' lang="{lang}"')
        page(f"http://new.{lang}/", UNSURE)
        page(f"http://only-{lang}.com/y", UNSURE)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op10_language_id(spark, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in got if x["page_id"] is None) == list(range(200))
    of = {x["page_id"]: x["lang"] for x in got if x["page_id"] is not None}
    assert sorted(of) == list(range(len(pages)))
    assert [of[first + i] for i in range(6)] == ["aa"] * 3 + ["bb"] * 3
