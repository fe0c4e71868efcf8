"""Section selection, prompts and response clean-up as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: heading keywords by priority, tiers, limits.
KEYWORDS = ("limitation", "future work", "conclusion", "discussion")
EXPLICIT_KEYWORDS = ("limitation", "future work")
CONCLUSION_KEYWORDS = ("conclusion", "discussion")
TIERS = ("explicit", "conclusion", "inferred")
MAX_SECTION_CHARS = 4000
MAX_PAGES = 20
TAIL_SHARE = 0.4


def heading_pattern(keywords: tuple[str, ...], group: bool = False) -> str:
    """A heading alone on its line: optional number, keyword, optional plural. ``(?U)``: white space as Unicode has it."""
    # Fixed value: the form of a heading.
    return rf"(?:^|\n)\s*(?:\d+\.?\s+)?({'' if group else '?:'}{'|'.join(keywords)})s?\s*\n"


def has_heading(text: Column, keywords: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + heading_pattern(keywords))


def strip(c: Column) -> Column:
    """Leading and trailing white space of any kind removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def capped(c: Column, start: Column | int = 1) -> Column:
    """Cut first, strip second."""
    begin = F.lit(start) if isinstance(start, int) else start
    return strip(F.substring(c, begin, F.lit(MAX_SECTION_CHARS)))


def from_heading(page: Column, keywords: tuple[str, ...]) -> Column:
    """The page from its first such heading on."""
    return F.regexp_extract(page, f"(?iUs)({heading_pattern(keywords)}.*)", 1)


def section_from_pages(pages: Column) -> Column:
    """struct(section, tier) of an array of pages.

    Tail pages come first, then head pages; any explicit heading beats any conclusion
    heading. No heading, no pages or null: empty text, ``inferred``.
    """
    kept = F.slice(pages, 1, MAX_PAGES)
    n = F.size(kept)
    tail = F.floor(n * F.lit(1 - TAIL_SHARE)).cast("int")

    def candidate(page: Column, i: Column) -> Column:
        rank = F.when(has_heading(page, EXPLICIT_KEYWORDS), 0).when(has_heading(page, CONCLUSION_KEYWORDS), 1)
        visit = F.when(i >= tail, i - tail).otherwise(n - tail + i)
        return F.struct(rank.alias("rank"), visit.alias("visit"), i.alias("i"))

    best = F.array_min(F.filter(F.transform(kept, candidate), lambda c: c["rank"].isNotNull()))
    page = F.get(kept, best["i"])
    following = F.get(kept, best["i"] + 1)
    head = F.when(best["rank"] == 0, from_heading(page, EXPLICIT_KEYWORDS)).otherwise(from_heading(page, CONCLUSION_KEYWORDS))
    text = capped(F.concat(head, F.coalesce(F.concat(F.lit("\n"), following), F.lit(""))))
    tier = F.when(best["rank"] == 0, TIERS[0]).when(best["rank"] == 1, TIERS[1]).otherwise(TIERS[2])
    return F.struct(F.coalesce(text, F.lit("")).alias("section"), tier.alias("tier"))


def with_abstract(section: Column, abstract: Column) -> Column:
    """struct(body, tier): the section, or the abstract as ``inferred`` where pages gave none."""
    found = section["tier"] != TIERS[2]
    return F.struct(F.when(found, section["section"]).otherwise(F.coalesce(abstract, F.lit(""))).alias("body"), F.coalesce(section["tier"], F.lit(TIERS[2])).alias("tier"))


def section_from_text(text: Column) -> Column:
    """Section of one text: the heading of best priority, then position; else the first keyword anywhere; else empty.

    Headings are met one after another without overlap, so a heading whose line break the one
    before has used up does not count.
    """
    pattern = "(?iU)" + heading_pattern(KEYWORDS, group=True)
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    order = F.array(*[F.lit(k) for k in KEYWORDS])
    ranked = F.transform(words, lambda w, i: F.struct(F.array_position(order, F.lower(w)).alias("p"), i.alias("i")))
    at = F.array_min(ranked)["i"]
    lengths = F.transform(F.slice(F.arrays_zip(gaps.alias("g"), whole.alias("w")), F.lit(1), at), lambda x: F.length(x["g"]) + F.length(x["w"]))
    start = F.aggregate(lengths, F.lit(0), lambda a, x: a + x) + F.length(F.get(gaps, at)) + 1
    plain = [F.when(F.locate(k, F.lower(text)) > 0, capped(text, F.locate(k, F.lower(text)))) for k in KEYWORDS]
    return F.when(F.size(words) > 0, capped(text, start)).otherwise(F.coalesce(*plain, F.lit("")))


def paper_text(title: Column, body: Column) -> Column:
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


PROMPT_HEAD = (
    "Read the scientific text below and describe it as one JSON object and nothing else.\n"
    "Its keys are objectives, methods, datasets, evaluation_metrics, limitations and future_directions; "
    "each value is a list of short strings, one statement a string, empty where the text says nothing.\n"
)
PROMPT_HINTS = {
    "conclusion": "The text is a concluding section: look for limitations it admits in passing.\n",
    "inferred": "The text names no limitations: state only those that clearly follow from its claims.\n",
}


def extraction_prompt(text: Column, tier: Column) -> Column:
    """Base prompt; weaker tiers add a hint before the text; an unknown tier gets the base."""
    hint = F.coalesce(*[F.when(tier == t, F.lit(h)) for t, h in PROMPT_HINTS.items()], F.lit(""))
    return F.concat(F.lit(PROMPT_HEAD), hint, F.lit("\nText:\n"), text)


def spoken(domain: Column) -> Column:
    return F.replace(domain, F.lit("_"), F.lit(" "))


def explain_prompt(gap: Column, solution: Column, source: Column, target: Column) -> Column:
    return F.concat(
        F.lit("In two or three sentences, say why the proposal could help with the problem.\nProblem in "), spoken(source), F.lit(": "), gap,
        F.lit("\nProposal from "), spoken(target), F.lit(": "), solution,
    )


def clean_response(raw: Column) -> Column:
    """White space stripped; if it opens with a code fence, all fence lines go."""
    text = strip(raw)
    lines = F.filter(F.split(text, r"\r\n|\n|\r", -1), lambda x: ~x.startswith("```"))
    return F.when(text.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(text)


def round4(c: Column) -> Column:
    """Four decimals, half up, the same in every engine."""
    return F.floor(c * 10000 + 0.5) / 10000


def score_band(score: Column) -> Column:
    return F.when(score > 0.6, "high").when(score >= 0.4, "mid").otherwise("low")


def domain_label(domain: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(domain == k, F.lit(v)) for k, v in labels.items()], domain)
