"""Bounded results as text for people and programs. These take collected rows; the queries before them bound their number."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Mapping, Sequence

MAX_TOKENS = 16_000


def safe_label(text: str, most: int = 60) -> str:
    """Letters, digits and a few marks; runs of others become one underscore."""
    text = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9 ._/-]", "_", text))
    return text if len(text) <= most else text[: most - 3] + "..."


def map_text(files: Iterable[Mapping]) -> str:
    """Blocks of a file's path and rank with its symbols' lines; what is left out is counted."""
    out = []
    for f in files:
        out.append(f"{f['path']}  (rank {f['rank']:.4f})")
        out += [f"{s['line']:>5} {s['signature']}" for s in f["symbols"]]
        if f.get("omitted"):
            out.append(f"      ... {f['omitted']} more")
    return "\n".join(out)


def numbered(text: str, spans: Sequence[tuple[int, int]], width: int = 5) -> str:
    """The lines of merged 1-based spans with their numbers and marks where lines are left out."""
    lines, out, last = text.split("\n"), [], 0
    for a, b in spans:
        if a > last + 1:
            out.append("...")
        out += [f"{n:>{width}} {lines[n - 1]}".rstrip() for n in range(max(a, last + 1), min(b, len(lines)) + 1)]
        last = max(last, min(b, len(lines)))
    if last < len(lines):
        out.append("...")
    return "\n".join(out)


def flowchart(edges: Iterable[Mapping], groups: Mapping[str, str] | None = None, omitted: int = 0) -> str:
    """A Mermaid flowchart: imports solid, references dashed, nodes in their groups' boxes."""
    edges = list(edges)
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for e in edges for x in (e["src"], e["dst"])}))}
    out = ["flowchart LR"]
    boxes: dict[str, list[str]] = {}
    for n in ids:
        boxes.setdefault((groups or {}).get(n, ""), []).append(n)
    for i, (box, nodes) in enumerate(sorted(boxes.items())):
        pad = "    " if box else "  "
        if box:
            out.append(f'  subgraph g{i}["{safe_label(box)}"]')
        out += [f'{pad}{ids[n]}["{safe_label(n)}"]' for n in nodes]
        if box:
            out.append("  end")
    out += [f"  {ids[e['src']]} {'-->' if e['kind'] == 'import' else '-.->'} {ids[e['dst']]}" for e in edges]
    if omitted:
        out.append(f'  more["{omitted} more nodes"]')
    return "\n".join(out)


def page(edges: Iterable[Mapping], title: str) -> str:
    """A page with the graph's rows as a table and as JSON data."""
    edges = [dict(e) for e in edges]
    rows = "".join(f"<tr>{''.join(f'<td>{html.escape(str(e[k]))}</td>' for k in ('src', 'dst', 'kind', 'weight'))}</tr>" for e in edges)
    data = json.dumps(edges, sort_keys=True).replace("</", "<\\/")
    return f'<!doctype html><title>{html.escape(title)}</title><table>{rows}</table><script type="application/json">{data}</script>'


def envelope(receipt: Mapping, body: str, most: int = MAX_TOKENS) -> str:
    """Receipt lines, then the body cut by whole lines to `most` tokens of four characters."""
    head = "\n".join(f"{k}: {v}" for k, v in receipt.items())
    kept, used = [], 0
    lines = body.split("\n")
    for line in lines:
        used += len(line) + 1
        if used > 4 * most:
            break
        kept.append(line)
    note = "" if len(kept) == len(lines) else f"\n[cut: {len(lines) - len(kept)} more lines]"
    return f"{head}\n\n" + "\n".join(kept) + note


def json_envelope(receipt: Mapping, payload: Mapping, items: str, most: int = MAX_TOKENS) -> str:
    """The payload as JSON, the list `items` cut to whole entries that fit; receipt and truncated are reserved keys."""
    if reserved := {"receipt", "notice", "truncated"} & set(payload):
        raise ValueError(f"reserved keys: {sorted(reserved)}")
    room = 4 * most - len(json.dumps({"receipt": receipt, **payload, items: []}))
    kept, used = [], 0
    for x in payload.get(items, []):
        used += len(json.dumps(x)) + 2
        if used > room:
            break
        kept.append(x)
    return json.dumps({"receipt": receipt, **payload, items: kept, "truncated": len(kept) < len(payload.get(items, []))}, sort_keys=True)


def receipt(repository: str, head: str = "", tree: str = "", dirty: bool | None = None, cache: str = "", note: str = "") -> dict:
    """What a result was made from, for both kinds of envelope: the same keys in the same order, without those that say nothing."""
    state = {None: "", True: "yes", False: "no"}[dirty]
    return {k: v for k, v in (("repository", repository), ("head", head), ("tree", tree), ("dirty", state), ("cache", cache), ("note", note)) if v}


def first_difference(rendered: str, stored: str) -> tuple[int, str | None, str | None] | None:
    """Line number and both lines where a drawing differs from the stored one, None if it does not; a fence around it does not count."""

    def bare(text: str) -> list[str]:
        lines = text.strip("\n").split("\n")
        fenced = len(lines) >= 2 and lines[0].startswith("```") and lines[-1].strip() == "```"
        return lines[1:-1] if fenced else lines

    now, before = bare(rendered), bare(stored)
    for i in range(max(len(now), len(before))):
        a, b = (x[i] if i < len(x) else None for x in (now, before))
        if a != b:
            return i + 1, a, b
    return None
