import json

import pytest
from pyspark.sql import functions as F

from litloom.functions import records
from litloom.functions import text as tx
from litloom.sources import connectors


def one(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


PAGES = [
    ([], ("", "inferred")),
    (["plain", "more"], ("", "inferred")),
    (["intro", "x\nConclusion\nc", "a", "b", "y\nLimitations\nwe lack data"], ("Limitations\nwe lack data", "explicit")),
    (["a", "b", "c", "z\n5. Limitations\nfirst", "second"], ("5. Limitations\nfirst\nsecond", "explicit")),
    (["\nFuture Work\nhead", "b", "c", "d", "e"], ("Future Work\nhead\nb", "explicit")),
    (["a", "b", "c", "q\nDiscussions \ntext", "e"], ("Discussions \ntext\ne", "conclusion")),
    (["a", "b", "c", "\nConclusion\nc", "\nLimitation\nl"], ("Limitation\nl", "explicit")),
    (["\nLimitations\nin head", "b", "c", "d", "\nConclusion\nt"], ("Limitations\nin head\nb", "explicit")),
    (["p"] * 20 + ["\nLimitations\nlate"] * 5, ("", "inferred")),
    (["Limitations and Future Work\nno"], ("", "inferred")),
    (["we note limitations\n here"], ("", "inferred")),
    (["\U0001f600 emoji\nLimitations \nafter"], ("Limitations \nafter", "explicit")),
    (["Conclusion\nstarts the text"], ("Conclusion\nstarts the text", "conclusion")),
]


@pytest.mark.parametrize(("pages", "want"), PAGES)
def test_section_from_pages(spark, pages, want):
    got = one(spark, "p array<string>", [(pages,)], tx.section_from_pages(F.col("p")))[0]
    assert tuple(got) == want


def test_section_is_cut_then_stripped(spark):
    got = one(spark, "p array<string>", [(["\nLimitations\n" + "x" * 3000, "y" * 3000],)], tx.section_from_pages(F.col("p")))[0]
    assert len(got.section) == tx.MAX_SECTION_CHARS - 1 and got.section.startswith("Limitations")


def test_null_pages_fall_back_to_abstract(spark):
    rows = [(None, "abs"), (["\nLimitations\nx"], "abs"), (["no"], None)]
    got = one(spark, "p array<string>, a string", rows, tx.with_abstract(tx.section_from_pages(F.col("p")), F.col("a")))
    assert [tuple(g) for g in got] == [("abs", "inferred"), ("Limitations\nx", "explicit"), ("", "inferred")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x\nConclusion\nc\nz\nLimitations\nl", "Limitations\nl"),
        ("a\n5. Discussion\nd", "5. Discussion\nd"),
        ("the limitation here\nConclusion\nc", "Conclusion\nc"),
        ("a limitation in passing", "limitation in passing"),
        ("the Conclusion and future work", "future work"),
        ("Conclusion\nLimitations\nl", "Conclusion\nLimitations\nl"),
        ("nothing", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_section_from_text(spark, text, want):
    assert one(spark, "t string", [(text,)], tx.section_from_text(F.col("t"))) == [want]


def test_prompt_depends_on_tier(spark):
    got = one(spark, "t string", [("explicit",), ("conclusion",), ("inferred",), ("odd",)], tx.extraction_prompt(F.lit("body"), F.col("t")))
    assert got[0] == got[3] and len({*got}) == 3 and all(g.endswith("\nText:\nbody") for g in got)


def test_clean_response(spark):
    got = one(spark, "t string", [("```json\n{}\n```",), (" {} ",), ("a ``` b",), (None,)], tx.clean_response(F.col("t")))
    assert got == ["{}", "{}", "a ``` b", None]


def test_explain_prompt_speaks_domains(spark):
    got = one(spark, "d string", [("computer_vision",)], tx.explain_prompt(F.lit("g"), F.lit("s"), F.col("d"), F.col("d")))[0]
    assert "computer vision" in got and "_" not in got


def test_bands_labels_rounding(spark):
    assert one(spark, "x double", [(0.61,), (0.6,), (0.4,), (0.39,)], tx.score_band(F.col("x"))) == ["high", "mid", "mid", "low"]
    assert one(spark, "x string", [("a",), ("b",)], tx.domain_label(F.col("x"), {"a": "A"})) == ["A", "b"]
    assert one(spark, "x double", [(0.12345,), (1.0,)], tx.round4(F.col("x"))) == [0.1235, 1.0]


def response(**change):
    base = {k: [] for k in records.LIST_FIELDS}
    return json.dumps({k: v for k, v in (base | change).items() if v != "drop"})


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        (response(methods=["m"]), None),
        ("```json\n" + response(extra=1) + "\n```", None),
        ("not json", "not json"),
        ("[1, 2]", "not an object"),
        (response(datasets="drop", methods="drop"), "missing keys: datasets,methods"),
        (response(limitations=None), "bad field: limitations"),
        (response(limitations=["a", 1]), "bad field: limitations"),
        (response(limitations=["a", None]), "bad field: limitations"),
        (response(limitations=[None]), "bad field: limitations"),
        (response(limitations="text"), "bad field: limitations"),
        (None, "not json"),
    ],
)
def test_validation(spark, raw, reason):
    row = records.validated(spark.createDataFrame([(raw,)], "response string")).first()
    assert row.reason == reason
    if reason is None:
        assert row.limitations == []


def test_json_lists(spark):
    assert one(spark, "t string", [('["é","b"]',), ("{bad",), ("5",), (None,)], records.list_from_json(F.col("t"))) == [["é", "b"], [], [], []]


def test_metadata_and_stubs(spark):
    raw = spark.createDataFrame([("1", "t", 2020, "a", ("s",), ("1",)), ("2", None, None, "", ("s",), ("2",)), ("3", "t", 1, None, None, None)], f"arxiv_id string, {connectors.METADATA}")
    assert [tuple(r) for r in connectors.shaped_metadata(raw).orderBy("arxiv_id").collect()] == [("1", "t", 2020, "a"), ("2", "", 0, "s"), ("3", "t", 1, "")]
    found = spark.createDataFrame([([(("x1",), "t", 1), (("",), "t", 1), ((None,), "t", 1), (None, "t", 1)],)], "data array<struct<externalIds:struct<ArXiv:string>,title:string,year:int>>")
    assert [r.arxiv_id for r in connectors.search_stubs(found).collect()] == ["x1"]


def test_retry_waits_and_gives_up():
    waits, calls = [], iter([connectors.RateLimited, connectors.RateLimited, None])

    def fetch():
        e = next(calls)
        if e:
            raise e
        return b"ok"

    assert connectors.fetch_with_retry(fetch, sleep=waits.append) == b"ok" and waits == [1.0, 2.0]

    def limited():
        raise connectors.RateLimited

    with pytest.raises(connectors.RateLimited):
        connectors.fetch_with_retry(limited, sleep=waits.append)


def test_pages_of_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"|".join(str(i).encode() for i in range(25)))
    rows = connectors.read_pages(spark, str(tmp_path), lambda b: b.decode().split("|")).collect()
    assert len(rows[0].pages) == tx.MAX_PAGES
