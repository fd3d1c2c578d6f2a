"""Spam pages on made-up pages of every kind, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import spam as S
from tidewright.session import table

PROSE = [
    "The crew of the small vessel left the harbour at noon and did not answer the radio until late in the evening.",
    "According to the office, the owner paid the fee in cash and gave no name for the next port.",
    "Nobody on the desk could explain why the import of the list had been stopped after two hours.",
    "A second reader should check whether both accounts belong to the same person.",
    "Because of the weather the patrol stayed in port for most of the week.",
]


SPAM = {
    "list": "cheap blue lamps | " * 30,
    "bare": "cheap blue lamps buy red chairs cheap blue lamps " * 12,
    "sentences": "Our cheap blue lamps are the cheap blue lamps for people who want cheap blue lamps. Looking for cheap blue lamps? Order cheap blue lamps today, cheap blue lamps tomorrow is late! " * 4,
    "links": "\n".join(f"big sale {w} - https://{w}-shop{i}.example/?ref={i}a" for i, w in enumerate("abc def ghi jkl mno pqr".split())),
    "bare links": "\n".join(f"www.red-gull{i}.test/buy" for i in range(9)),
    "anchors": "".join(f'<a href="https://red-gull{i}.test/p">nice seeds</a><br>' for i in range(9)),
    "markdown": "\n".join(f"* [nice seeds](http://red-gull{i}.test/go)" for i in range(9)),
    "tags": "#cheaplamps #bluelamps #redchairs #lampsonline #buylamps " * 5,
    "goods": "Blue Lamp SKU-1234 19.99, Red Chair SKU-777 8.99, Blue Chair SKU-99 7.50, " * 6,
    "cloud": "blue lamps (12)\nred chairs (3)\nblue chairs (44)\nred lamps (9)\n" * 5,
    "half honest": PROSE[0] + "\n" + "cheap blue lamps - " * 40,
}
FAIR = {
    "prose": " ".join(PROSE),
    "log": "\n".join(f'2025-01-{d:02}T10:00:00Z WARN feed job={d} rows={d} msg="retry"' for d in range(1, 25)),
    "table": "vessel,from,to,eta\n" + "\n".join(f"MV Blue Gull,Lorvik,Rosmar,2025-01-{d:02}T10:00" for d in range(1, 20)),
    "dump": '[{"entity": "a.test", "tags": ["gull", "gull"], "note": "The crew left."}, {"entity": "a.test", "tags": ["gull"]}]',
    "transcript": "\n".join("[07:40] Mayday, mayday, mayday, this is MV Gull, MV Gull, MV Gull." for _ in range(9)),
    "indicators": PROSE[1] + "\n\nIndicators:\n" + "\n".join(f"hxxps://red-gull[.]test/heron/{i}" for i in range(200, 220)),
    "hashes": PROSE[1] + "\nIOC\n---\n" + "\n".join(f"{i:040x}" for i in range(1, 20)),
    "glossary": "\n".join(f"{w}: old word for a {w.lower()} boat, the crew list of which was lost." for w in "Heron Gull Tern Crane Stork".split()),
    "subject": "MV Blue Gull anchored off Lorvik at noon. The agent for MV Blue Gull is Liv. Nobody boarded MV Blue Gull there. Later MV Blue Gull left for Rosmar.",
    "quote": " ".join(PROSE) + '\nThe page read: "cheap blue lamps cheap blue lamps cheap blue lamps".',
    "ends in tags": " ".join(PROSE) + "\n#gull #heron #tern",
    "advert": "For sale: free anchor chain, 592.00\nWe bought one online for comparison and found the housing opened before. The seller asks to be called only after noon.",
    "short": "ok then",
}


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    """The documents of a small table with the pages above among them, and which are found."""
    docs = [(1000 + i, t) for i, t in enumerate(SPAM.values())] + [(2000 + i, t) for i, t in enumerate(FAIR.values())]
    docs += [(3000, None), (3001, ""), (3002, " \n "), (None, SPAM["list"]), (3003, SPAM["list"]), (3004, "x" * 100_000), (3005, "cheap blue lamps | " * 20_000)]
    made = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id") + 10**9)
    df = table(spark, SF, "documents").select("doc_id", "text").unionByName(made).withColumns({"size": F.lit("x"), "total": F.lit("y")})
    found = {r[0] for r in S.spam_pages(df).collect()}
    return df, found


@pytest.mark.parametrize("name", SPAM)
def test_spam(pages, name):
    assert 10**9 + 1000 + list(SPAM).index(name) in pages[1]


@pytest.mark.parametrize("name", FAIR)
def test_fair(pages, name):
    assert 10**9 + 2000 + list(FAIR).index(name) not in pages[1]


def test_edges(pages):
    assert {x - 10**9 for x in pages[1] if x >= 10**9 + 3000} == {3003, 3005}


def test_without_the_model_the_pages_change(pages, monkeypatch):
    """The model decides: with one that knows no prose most pages aren't told apart any more."""
    df, found = pages
    monkeypatch.setattr(S, "train", lambda cut: S.Model(np.ones(S.K**3)))
    assert len(found) > 50 and len(found & {r[0] for r in S.spam_pages(df).collect()}) < 0.1 * len(found)


def test_shapes_of_addresses():
    assert S.shape("https://www.red.test") == S.shape("red[.]test/") != S.shape("red7.test")
    assert len({S.shape(f"http://{h}.test{p}") for h in ("red", "red7") for p in ("", "/a?b", "/a/12", "/a/b")}) == 8


def test_empty(spark):
    assert S.spam_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_model_prefers_prose(spark):
    cut = spark.createDataFrame([(1, 10, 10, "fCfcfc.", [0] * 9, True)] * 50, S.PASSAGES)
    (a, b), enough = S.train(cut).score(["fCfcfc.", "rrrrrr"])
    assert a < b and list(enough) == [True, True]
