"""What a model is given to judge, and what of its answers is accepted."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of answers, and what they may say about use.
MOST_ANSWER, MOST_REASON, MOST_EVIDENCE, EXCERPT = 4000, 500, 3, 2000
RELEVANCE = ("direct", "indirect", "not_confirmed")
ANSWER = "answer string, kb_match_confirmed boolean, operational_relevance string, supporting_evidence array<struct<entry_id:long,match_reason:string>>"


def context(item: dict, query: str, results: list[dict]) -> dict:
    """What the model sees: the item, the query, and excerpts of the results."""
    keys = ("entry_id", "title", "final_score")
    shown = [{k: r.get(k) for k in keys} | {"title": r.get("title") or "Untitled", "excerpt": (r.get("content") or r.get("summary") or "")[:EXCERPT]} for r in results]
    return {"item": item, "kb_query": query, "kb_entries": shown}


def _said(text, most: int) -> bool:
    return isinstance(text, str) and 0 < len(text) <= most and not text.isspace()


def accept(answer: object, allowed: set[int]) -> dict:
    """The answer, trimmed; ValueError unless it has exactly the four fields, cites each of at most three retrieved entries
    once with a reason, confirms a match if and only if it cites one, and claims no use without a match."""
    fields = {"answer", "kb_match_confirmed", "operational_relevance", "supporting_evidence"}
    if not isinstance(answer, dict) or answer.keys() != fields:
        raise ValueError("the answer has other fields")
    cited = answer["supporting_evidence"]
    if not _said(answer["answer"], MOST_ANSWER):
        raise ValueError("no answer")
    if type(answer["kb_match_confirmed"]) is not bool or answer["operational_relevance"] not in RELEVANCE:
        raise ValueError("no decision about a match or its use")
    if not isinstance(cited, list) or len(cited) > MOST_EVIDENCE or any(not isinstance(c, dict) or c.keys() != {"entry_id", "match_reason"} for c in cited):
        raise ValueError("the evidence has another form")
    ids = [c["entry_id"] for c in cited]
    if any(type(i) is not int for i in ids) or len(set(ids)) < len(ids) or not set(ids) <= allowed or not all(_said(c["match_reason"], MOST_REASON) for c in cited):
        raise ValueError("the evidence is not of the retrieved entries")
    if answer["kb_match_confirmed"] != bool(cited):
        raise ValueError("the match and the evidence disagree")
    if answer["operational_relevance"] != "not_confirmed" and not cited:
        raise ValueError("use without a match")
    return answer | {"answer": answer["answer"].strip(), "supporting_evidence": [c | {"match_reason": c["match_reason"].strip()} for c in cited]}


def status_of(answer: dict | None) -> str:
    """How an accepted answer (none: nothing was retrieved) is reported."""
    if answer and answer["operational_relevance"] != "not_confirmed":
        return "operationally_relevant"
    return "kb_match_only" if answer and answer["kb_match_confirmed"] else "not_confirmed"


def synthesize(item: dict, query: str, results: list[dict], model: Callable[[dict], dict]) -> dict:
    """Ask ``model`` about the results, at most three; without results it isn't asked."""
    results = results[:MOST_EVIDENCE]
    if not results:
        return {"status": "not_confirmed", "answer": "", "supporting_entries": [], "model_calls": 0}
    got = accept(model(context(item, query, results)), {r["entry_id"] for r in results})
    by_id = {r["entry_id"]: r for r in results}
    entries = [c | {"title": by_id[c["entry_id"]].get("title") or "Untitled", "final_score": by_id[c["entry_id"]]["final_score"]} for c in got["supporting_evidence"]]
    return {"status": status_of(got), "answer": got["answer"], "connection_confirmed": got["operational_relevance"] == "direct", "supporting_entries": entries, "model_calls": 1}


def acceptable(answer: Column, allowed: Column) -> Column:
    """The same rules for a column of answers (ANSWER) and the array of ids that may be cited."""
    ids = F.transform(answer["supporting_evidence"], lambda c: c["entry_id"])
    said = lambda t, most: F.coalesce((F.trim(t) != "") & (F.length(t) <= most), F.lit(False))
    cites = F.size(ids) > 0
    rules = [
        said(answer["answer"], MOST_ANSWER), answer["operational_relevance"].isin(*RELEVANCE), F.size(ids) <= MOST_EVIDENCE,
        F.size(F.array_distinct(ids)) == F.size(ids), F.size(F.array_except(ids, allowed)) == 0,
        F.forall(answer["supporting_evidence"], lambda c: c["entry_id"].isNotNull() & said(c["match_reason"], MOST_REASON)),
        answer["kb_match_confirmed"] == cites, cites | (answer["operational_relevance"] == "not_confirmed"),
    ]
    fine = F.lit(True)
    for rule in rules:
        fine = fine & F.coalesce(rule, F.lit(False))
    return fine


def excerpts(results: DataFrame) -> DataFrame:
    """qid, entries: the excerpts of each query's results (qid, id, title, summary, content, final_score, n)."""
    text = F.substring(F.coalesce(F.nullif("content", F.lit("")), "summary", F.lit("")), 1, EXCERPT)
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    each = F.struct("n", F.col("id").alias("entry_id"), title.alias("title"), "final_score", text.alias("excerpt"))
    return results.groupBy("qid").agg(F.sort_array(F.collect_list(each)).alias("entries"))


def without_thoughts(text: str) -> str:
    """A model's output without what it thought aloud."""
    return re.sub(r"(?s)<think>.*?</think>\s*", "", text).strip() if "<think>" in text else text
