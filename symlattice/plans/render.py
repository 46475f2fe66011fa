"""Answers as text. Sections come in a fixed order; an empty one says so or is left out."""

from __future__ import annotations

from symlattice.plans.engine import BRIEF_ROWS, View


def header(v: View) -> str:
    n = v.node
    tail = "  [exported]" if n["exported"] else ""
    out = f"## {n['kind']} `{n['qualified_name']}`  ({n['file_path']}:{n['start_line']}-{n['end_line']}){tail}\n"
    return out + (f"`{n['signature']}`\n" if n["signature"] else "")


def refusal(v: View, why: str) -> str:
    """Where the symbol is, and why the graph can't stand in; no header that could be taken for an answer."""
    return header(v).split("\n", 1)[0].removeprefix("## ") + f"\nnot a grep substitute: {why}. grep `{v.name}` for its uses.\n"


def _section(title: str, rows: list[str], empty: str | None = None) -> str:
    if not rows and empty is None:
        return ""
    return f"\n**{title}**\n" + "".join(f"- {r}\n" for r in rows or [empty])


def _brief(v: View) -> str:
    direct = next((rows for d, rows in v.blast if d == 1), [])
    deeper = sum(len(rows) for d, rows in v.blast if d > 1)
    out = ""
    for title, rows in (("callers ←", direct), ("uses ←", v.uses)):
        more = [f"… {len(rows) - BRIEF_ROWS} more"] if len(rows) > BRIEF_ROWS else []
        out += _section(title, rows[:BRIEF_ROWS] + more)
    return out + (f"({deeper} transitive callers)\n" if deeper else "")


def explore(v: View, detail: str = "full") -> str:
    if not v.found:
        return f"no symbol named `{v.name}`. try `search {v.name}` for fuzzy matches." + _section("nearby", v.suggestions)
    if detail == "brief":
        if v.gap():
            return refusal(v, v.gap())
        out = header(v) + _brief(v)
        for o in v.others:
            out += "\n" + header(o) + _brief(o)
        return out + (_section("text-only mentions", v.text_only) or "\nno other file mentions this name.\n")
    out = header(v) + (f"\n```\n{v.snippet}\n```\n" if v.snippet else "")
    out += _section("call-path spine", v.spine, "(leaf — no named callees)")
    out += _section("members", [f"{m['kind']} `{m['name']}`  :{m['start_line']}" for m in v.members])
    out += _section("heritage", v.heritage)
    if v.blast:
        out += "\n**callers ← (blast radius)**\n" + "".join(f"depth {d}:\n" + "".join(f"- {r}\n" for r in rows) for d, rows in v.blast)
    else:
        out += _section("callers ← (blast radius)", [], "(no resolved callers — absence ≠ proof; weak/dynamic calls may be missed)")
    out += _section("uses ←", v.uses) + _section("calls →", v.callees, "(none captured)")
    return out + _section("routes / processes", v.routes, "(none)")


def changed(changed_rows: list, affected_rows: list, partial: bool) -> str:
    out = "## changed\n" + "".join(f"- {n.kind} `{n.qualified_name}`  {n.file_path}:{n.start_line}\n" for n in changed_rows)
    out += "" if changed_rows else "- (no symbols overlap the diff)\n"
    out += "\n## affected (blast)\n" + "".join(f"- depth {n.depth}: {n.kind} `{n.qualified_name}`  {n.file_path}:{n.start_line}\n" for n in affected_rows)
    out += "" if affected_rows else "- (none — no resolved callers, or absence ≠ proof)\n"
    return out + ("\npartial: true — some changes could not be mapped to symbols; absence above is not proof of no impact.\n" if partial else "")
