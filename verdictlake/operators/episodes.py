"""Episodes that accumulate: a fold over the loops of one episode, and checks asked of an injected checker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.repair_text import harvest

FRESH, CONTINUE, NO_ANSWER = "fresh", "continue", "no_answer"


def fold(rows: list[tuple], size: int) -> list[tuple]:
    """loop, kind, added, pool, checks, copy_of from rows (loop, proof, kept, verified, stands) in the order of loops.

    A generation continues if the pool holds a lemma and has changed since the last one that continued, else it is fresh. A
    proof rejected before is a known copy of the earliest loop that has it and leaves nothing. What a rejected proof leaves
    joins the pool if the pool with it stands. A pool that grew is checked with every kept closing step, else with the one just
    kept, as far as the names they need are in the pool.
    """
    pool: dict[str, str] = {}  # statement -> text
    closers: list[str] = []
    rejected: dict[str, int] = {}
    made = continued = None
    out = []
    for loop, proof, kept, verified, stands in rows:
        kind = CONTINUE if pool and (continued is None or made >= continued) else FRESH
        continued = loop if kind == CONTINUE else continued
        copy, added, checks = rejected.get(proof.rstrip()), 0, 0
        if not verified and copy is None:
            rejected[proof.rstrip()] = loop
            texts, statements, closer, _ = harvest(proof, int(kept), int(loop), max(0, size - len(pool)))
            new = {s: t for s, t in zip(statements, texts, strict=True) if s not in pool} if stands else {}
            if new:
                pool |= new
                made, added = loop, len(new)
            closers += [closer] if closer else []
            names = {n for t in pool.values() for n in re.findall(r"^\s*have\s+(\w+_g\d+)", t)}
            tried = (closers if new else closers[-1:] if closer else []) if pool else []
            checks = sum(set(re.findall(r"\w+_g\d+", c)) <= names for c in tried)
        out.append((loop, kind, added, len(pool), checks, copy))
    return out


def accumulated_episodes(attempts: DataFrame, problem: str, episode: str, size: int = 16) -> DataFrame:
    """The fold over attempts (loop, proof, kept, verified, stands), episode by episode along sorted partitions: a task holds
    the few loops of one episode, and no call is made a group."""
    kinds = dict(attempts.dtypes)
    schema = f"{problem} {kinds[problem]}, {episode} {kinds[episode]}, loop int, kind string, added int, pool int, checks int, copy_of int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        names = [problem, episode, "loop", "kind", "added", "pool", "checks", "copy_of"]
        framed = lambda done: pd.DataFrame(done, columns=names).astype({"copy_of": "Int32"})
        for f in frames:
            for r in f.itertuples(index=False, name=None):
                if r[:2] != key:
                    out += [(*key, *x) for x in fold(rows, size)] if rows else []
                    key, rows = r[:2], []
                rows.append(r[2:])
            if len(out) > 2000:
                yield framed(out)
                out = []
        out += [(*key, *x) for x in fold(rows, size)] if rows else []
        if out:
            yield framed(out)

    own = attempts.select(problem, episode, "loop", "proof", "kept", "verified", "stands")
    return own.repartition(problem, episode).sortWithinPartitions(problem, episode, "loop").mapInPandas(run, schema)


def asked(texts: list[str], check: Callable[[list[str]], list[str]], tries: int) -> list[str]:
    """Answers of a checker that may fail: a batch that fails is halved, a single text that fails ``tries`` times has no answer."""
    for _ in range(tries if len(texts) == 1 else 1):
        try:
            return check(texts)
        except Exception:  # whatever the injected checker raises
            continue
    if len(texts) == 1:
        return [NO_ANSWER]
    half = len(texts) // 2
    return asked(texts[:half], check, tries) + asked(texts[half:], check, tries)


def checked(files: DataFrame, sha: str, text: str, check: Callable[[list[str]], list[str]], batch: int = 64, tries: int = 2) -> DataFrame:
    """sha, answer: every distinct file is asked once, in batches, wherever its partition is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({sha: part[sha], "answer": asked(part[text].tolist(), check, tries)})

    return files.select(sha, text).dropDuplicates([sha]).mapInPandas(run, f"{sha} string, answer string")


def minimised(rows: DataFrame, key: str, blocks: str, verifies: Callable[[list[str], list[str]], bool]) -> DataFrame:
    """key, kept: blocks dropped one by one from the first on, each drop kept if what is left (of the whole) still verifies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for own in f[blocks]:
                left = list(own)
                for block in list(own):
                    fewer = left.copy()
                    fewer.remove(block)
                    left = fewer if verifies(fewer, list(own)) else left
                out.append(left)
            yield pd.DataFrame({key: f[key], "kept": out})

    return rows.select(key, blocks).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, kept array<string>")
