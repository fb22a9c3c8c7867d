"""Results as text."""

from __future__ import annotations

from .text import cut_at_space, paragraph_cut

BRIEF_CHARS, AI_SHOWN = 700, 2


def warning_line(note: dict) -> str:
    line = f"⚠ newer note {note['relation']} this: {note['ref']} — {note['title']}"
    if note["relation"] in ("updates", "corrects") and note.get("preview"):
        line += f"\n  {note['preview']}"
    return line


def result_text(r: dict) -> str:
    """One result: head, body and warnings; an ai result is a brief with its source, a homelab one is cut late."""
    if r["corpus"] == "ai":
        source = f"Source: {r['source']}\n" if r.get("source") else ""
        body = source + cut_at_space(" ".join((r.get("summary") or r["content"]).split()), BRIEF_CHARS)
    else:
        body = paragraph_cut(r["content"])
        if body != r["content"]:
            body += f"\n(whole entry: {r['ref']})"
    return "\n".join([f"[{r['ref']}] {r['title']} ({r['score']:.2f})", body, *map(warning_line, r.get("newer", []))])


def mixed_text(results: list[dict]) -> str:
    """Results in order with a bound on ai ones; the rest is counted."""
    shown, left = [], 0
    for r in results:
        if r["corpus"] == "ai" and sum(s["corpus"] == "ai" for s in shown) >= AI_SHOWN:
            left += 1
        else:
            shown.append(r)
    tail = [f"{left} more AI result(s) omitted"] if left else []
    return "\n\n".join([*map(result_text, shown), *tail]) or "No results."


def history_text(chain: list[str] | None, edges: list[tuple[str, str]], current: str, broken: list[str], warnings: list[str], truncated: bool = False) -> str:
    """A lineage: the chain from old to new if there is one, else its edges; faults are always shown."""
    lines = [" → ".join(n + (" ← current" if n == current else "") for n in chain)] if chain else [f"{a} → {b}" for a, b in edges]
    lines += [f"broken link: {b}" for b in broken] + (["truncated"] if truncated else []) + [f"warning: {w}" for w in warnings]
    return "\n".join(lines) or current
