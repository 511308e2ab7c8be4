"""Failed proofs as text: where to cut them, what they leave behind, and the sources and prompts that go on from there.

A checker's error has a line and a column in the source that was checked. Lines of a proof count from the line on which the
source has it. Plain functions a text, behind Arrow functions; what cannot be read is null.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from .source_text import CLOSING, HEADER, OPENING, arrow, first_step, lined, without_comments
from .statements import blank_comments

# Kinds of cuts and why there is none, how harvests end, words that go on with a step.
BODY, WHOLE = "body", "whole_proof"
NO_POSITION, ON_STATEMENT = "no_error_position", "error_on_the_statement"
THE_END, THE_ERROR, NOT_A_HAVE, GOES_ON_TOO, NO_PROOF, LAYOUT = "the_end", "the_error", "not_a_have", "have_goes_on", "no_proof", "layout"
GOES_ON = ("<;>", "·", "|", ")", "]", "}", "⟩", "at ", "with ", "using ")
UNSOLVED = "unsolved goals"
_HAVE = re.compile(r"(\s*have)(?![\w'])(\s*)([^\s:(\[{⟨]*)")


def lines_of(proof: str) -> list[str]:
    return proof.rstrip().split("\n") if proof.strip() else []


def without_strings(text: str) -> str:
    """Comments and string literals as spaces."""
    return re.sub(r'"(?:\\.|[^"\\])*"', lambda m: re.sub(r"[^\n]", " ", m[0]), blank_comments(text))


def opener(lines: list[str]) -> int | None:
    """The line with the outermost bracket that these lines leave open."""
    code = without_strings("\n".join(lines))
    open_: list[int] = []
    for m in re.finditer(rf"[{re.escape(OPENING + CLOSING)}]", code):
        if m[0] in OPENING:
            open_.append(m.start())
        elif open_:
            open_.pop()
    return code.count("\n", 0, open_[0]) if open_ else None


def indentation(lines: list[str]) -> str:
    """That of the first line of code; two spaces without any."""
    first = next((i for i, c in enumerate(blank_comments("\n".join(lines)).split("\n")) if c.strip()), None)
    return "  " if first is None else re.match(r"\s*", lines[first])[0]


def cut_plan(proof: str, statement: str, errors: str) -> tuple | None:
    """kind, kept (lines), indentation, failed step, reason from a proof and the JSON list of its errors (line, column, text).

    The first error in the proof decides; then one behind its end; then the theorem's own open goals, which keep the whole
    proof. The cut lies where the failing step begins: at the line that opens a bracket still open there.
    """
    found = sorted((e["line"], e["column"], e["text"]) for e in json.loads(errors or "[]") if e.get("line") is not None)
    if not found:
        return None, None, None, None, NO_POSITION
    lines = lines_of(proof)
    first = (HEADER + lined(statement)).count("\n") + 1
    place = lambda e: 0 if first <= e[0] < first + len(lines) else 1 if e[0] >= first + len(lines) else 2 if e[2].lstrip().startswith(UNSOLVED) else 3
    error = min(found, key=lambda e: (place(e), e))
    if place(error) == 3:
        return None, None, None, None, ON_STATEMENT
    at = len(lines) if place(error) else error[0] - first
    begins = at if place(error) == 2 or (back := opener(lines[:at])) is None else back
    if begins == len(lines):
        return WHOLE, len(lines), indentation(lines), None, None
    return BODY, begins, re.match(r"\s*", lines[begins])[0], lines[begins].strip(), None


def state_source(statement: str, proof: str, kept: int, indent: str) -> str:
    """A source that asks for the state behind the kept lines."""
    return HEADER + lined(statement) + "".join(line + "\n" for line in lines_of(proof)[:kept]) + f"{indent}all_goals sorry\n"


def resumed(proof: str, kept: int, continuation: str) -> str:
    return "".join(line + "\n" for line in lines_of(proof)[:kept]) + continuation.rstrip() + "\n"


def steps_of(lines: list[str]) -> list[list[str]] | None:
    """The top steps' lines of code; null where a line stands left of the first."""
    code = [c.rstrip() for c in blank_comments("\n".join(lines)).split("\n")]
    depth = lambda c: len(c) - len(c.lstrip(" "))
    some = [(i, c) for i, c in enumerate(code) if c.strip()]
    if not some or any(depth(c) < depth(some[0][1]) for _, c in some):
        return None
    begins = [depth(c) == depth(some[0][1]) and not c.lstrip().startswith(GOES_ON) for _, c in some]
    if not begins[0]:
        return None
    number = list(accumulate(map(int, begins)))
    return [[(i, c) for (i, c), n in zip(some, number, strict=True) if n == s] for s in range(1, number[-1] + 1)]


def swap_names(text: str, names: dict[str, str]) -> str:
    """All names at once, where they stand as whole names."""
    return re.sub(r"(?<![\w'.])[\w'₀-₉!?]+(?![\w'])", lambda m: names.get(m[0], m[0]), text) if names else text


def harvest(proof: str, kept: int, generation: int, size: int = 16) -> tuple | None:
    """texts, statements, closer, ended: the leading lemmas of a failed proof that end before its error, with the names they bind
    made the generation's own, and the one closing step behind them if it is no lemma."""
    steps = steps_of(lines_of(proof))
    if steps is None:
        return [], [], None, LAYOUT
    base = len(steps[0][0][1]) - len(steps[0][0][1].lstrip(" "))
    names: dict[str, str] = {}
    texts, statements, taken, ended = [], [], 0, THE_END
    for step in steps:
        head = _HAVE.match(step[0][1])
        name = head and head[3]
        anonymous = head is not None and not name and step[0][1][head.end() :].lstrip().startswith(":")
        more = [c for _, c in step[1:] if len(c) - len(c.lstrip(" ")) == base]
        why = NOT_A_HAVE if head is None or not (name or anonymous) else THE_ERROR if step[-1][0] >= kept else GOES_ON_TOO if more else None
        body = swap_names("\n".join([step[0][1][head.end() :], *(c for _, c in step[1:])]), names) if why is None else ""
        depths = accumulate(((c in OPENING) - (c in CLOSING) for c in body), initial=0)
        assigned = next((i for i, d in enumerate(depths) if d == 0 and body.startswith(":=", i)), None) if why is None else None
        if why is None and assigned is None:
            why = NO_PROOF
        if why:
            ended = why
            break
        taken += 1
        said = " ".join(body[:assigned].split()) or ":= " + " ".join(body[assigned + 2 :].split())
        if said in statements:
            names[name] = re.match(r"\s*have\s+(\S+)", texts[statements.index(said)])[1] if name else ""
            continue
        own = f"{name}_g{generation}" if name else ""
        names |= {name: own} if name else {}
        if len(texts) == size:  # no room: what needs it needs a name that is not there
            continue
        texts.append("\n".join(("  " + line[base:]) for line in (step[0][1][: head.start(3)] + own + body).split("\n")))
        statements.append(said)
    last = [c for _, c in steps[-1]]
    closes = taken == len(steps) - 1 and not last[0].lstrip().startswith("have")
    return texts, statements, swap_names("\n".join("  " + c[base:] for c in last), names) if closes else None, ended


def cut_of(proof: Column, statement: Column, errors: Column) -> Column:
    return arrow(cut_plan, "kind string, kept int, indentation string, failed_step string, reason string", proof, statement, errors)


def harvest_of(proof: Column, kept: Column, generation: Column) -> Column:
    return arrow(lambda p, k, g: harvest(p, int(k), int(g)), "texts array<string>, statements array<string>, closer string, ended string", proof, kept, generation)


def repeats_step(continuation: Column, failed_step: Column) -> Column:
    """Whether a continuation begins with the step that failed; null if none did."""
    step = lambda text: F.regexp_replace(F.trim(first_step(without_comments(text))), r"\s+", " ")
    return F.when(failed_step.isNotNull(), F.coalesce(step(continuation) == step(failed_step), F.lit(False)))
