"""Vector best-fit packing of token sequences.

Documents are encoded once, cut where they exceed a sequence, and their pieces (a few numbers each) are staged; texts
never move. A piece asks for three resources: tokens, one document, and attention cost (its length squared). Pieces are
dealt by hash into groups of about ``group_pieces``; within a group, from the largest on, each piece goes to the open
sequence in which every residual capacity suffices and the rule is least:

- ``norm``: weighted norm of what would be left of the capacities (each as a share of its whole);
- ``dot``: weighted dot product of the piece's needs with what would be left.

Both prefer the tightest fit where it matters to the piece; ties go to the older sequence. A new sequence opens only if
none suffices. Sequences that a group leaves below ``full`` go back to pieces and are packed once more in larger groups.

Defined results: a null text is empty and has the closing id alone; a text that spells an added token of the tokenizer has
that token's id there; a very long text becomes many pieces, all but the last full; repeated rows are packed as often as
they occur; a null id stays null; ties in size are settled by doc_id and piece; an empty table gives an empty result;
other columns are not looked at. Without tighter ``most_documents`` and ``most_attention`` tokens alone can bind.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, staged, text_or_empty

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: The form of tokenizer whose runs and parts are encoded one by one. Any other goes through the tokenizers library whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTED = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
#: Names of bytes in byte-level vocabularies: those printable as they are, the others from 256 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(PLAIN))}


class Encoder:
    """Ids of a text as little-endian bytes. White space always parts tokens, so runs between it are encoded once and
    kept, and so are the parts of runs; both books are emptied when ``kept`` entries are reached. Runs beyond Latin
    letters, where composing and lower-casing have rules of their own, go through the whole tokenizer, and so do texts
    that hold an added token (``<|endoftext|>`` is one id), and all texts where the tokenizer is of another form."""

    def __init__(self, path: str, kept: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept, self.runs, self.parts = kept, {}, {}
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        steps = lambda key, inner: (form.get(key) or {}).get(inner)
        model = {k: v for k, v in form["model"].items() if k not in ("vocab", "merges") and v}
        self.by_runs = (
            steps("normalizer", "normalizers") == NORMAL and steps("pre_tokenizer", "pretokenizers") == PARTED and model == {"type": "BPE", "end_of_word_suffix": "</w>"}
            and not any(form.get(k) for k in ("truncation", "padding", "post_processor"))
        )
        added = form.get("added_tokens") or []
        self.added = [t["content"] for t in added if not t["normalized"]]
        self.added_lowered = [t["content"].lower() for t in added if t["normalized"]]
        self.split = regex.compile(SPLIT)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        named = part if part.isascii() and part.isprintable() else "".join(map(BYTES.__getitem__, part.encode()))
        found = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()
        return found

    def learn(self, runs: set[str]) -> None:
        if len(self.runs) + len(runs) > self.kept:
            self.runs.clear()
        if len(self.parts) > self.kept:
            self.parts.clear()
        book, parts = self.runs, self.parts
        for r in runs:
            if r not in book:
                if max(r) < "\u0130":
                    book[r] = b"".join([parts.get(p) or self.part(p) for p in self.split.findall(r.lower())])
                else:
                    book[r] = self.whole(r)

    def in_runs(self, text: str) -> bool:
        """Whether the runs of the text may be encoded one by one (four separators part words in Python alone)."""
        if not self.by_runs or any(c in text for c in "\x1c\x1d\x1e\x1f") or any(t in text for t in self.added):
            return False
        return not (self.added_lowered and any(t in text.lower() for t in self.added_lowered))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            runs = [t.split() if self.in_runs(t) else None for t in texts[at : at + 64]]
            self.learn({r for rs in runs if rs for r in rs})
            get = self.runs.__getitem__
            for t, rs in zip(texts[at : at + 64], runs, strict=True):
                yield self.whole(t) if rs is None else b"".join(map(get, rs))


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: at most ``most`` ids, only longer documents are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for i, data in zip(ids, encoder.encode(batch.column(1).to_pylist()), strict=True):
                data += end
                for p, at in enumerate(range(0, len(data), 4 * most)):
                    part = data[at : at + 4 * most]
                    out.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(needs: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item, items in the order given. needs: items x resources."""
    share, w = needs / capacity, weights / weights.sum()
    bins = np.full(len(needs), -1, np.int64)
    left = np.empty((1024, needs.shape[1]))
    name = np.empty(1024, np.int64)
    live = opened = 0
    least = np.minimum.accumulate(needs[::-1], axis=0)[::-1] if len(needs) else needs  # the least any later item asks for
    for i in range(len(needs)):
        need = needs[i]
        rest = left[:live] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            r = rest[fits] / capacity
            score = (r * r) @ w if rule == "norm" else r @ (w * share[i])
            at = fits[np.lexsort((name[fits], score))[0]] if len(fits) < 3 else fits[_first_least(score, name[fits])]
            left[at] = rest[at]
            bins[i] = name[at]
        else:
            if (need > capacity).any():
                raise ValueError("an item exceeds the capacity of an empty sequence")
            if live == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            at = live
            left[at], name[at], bins[i] = capacity - need, opened, opened
            live, opened = live + 1, opened + 1
        if i + 1 < len(needs) and (left[at] < least[i + 1]).any():  # closed: nothing later fits
            live -= 1
            left[at], name[at] = left[live], name[live]
    return bins


def _first_least(score: np.ndarray, name: np.ndarray) -> int:
    best = np.flatnonzero(score == score.min())
    return int(best[np.argmin(name[best])])


def pack_group(frame: pd.DataFrame, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each row of a frame with doc_id, piece, length."""
    length = frame["length"].to_numpy(np.float64)
    order = np.lexsort((frame["piece"], frame["doc_id"].fillna(-1), -length))
    needs = np.stack([length, np.ones_like(length), length * length], axis=1)[order]
    bins = np.empty(len(frame), np.int64)
    bins[order] = best_fit(needs, capacity, weights, rule)
    offset = np.empty(len(frame), np.int64)
    by_bin = np.lexsort((frame["piece"], frame["doc_id"].fillna(-1), bins))
    sizes, marks = length[by_bin].astype(np.int64), bins[by_bin]
    before = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]]) if len(marks) else np.zeros(0, int)
    offset[by_bin] = before - np.repeat(before[first], np.diff(np.r_[first, len(marks)]))
    return bins, offset


def pack(cut: DataFrame, most: int = 2048, most_documents: int | None = None, most_attention: int | None = None, weights=(1.0, 0.1, 0.1), rule: str = "norm", group_pieces: int = 8192, full: float = 0.995) -> DataFrame:
    """Pieces with sequence_id and offset. A capacity left out never binds."""
    capacity = np.array([most, most_documents or most, most_attention or most * most], float)
    w = np.array(weights, float)
    schema = PIECES + ", sequence_id bigint, offset bigint"

    def run(level: int):
        def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            bins, offset = pack_group(frame, capacity, w, rule)
            return frame.drop(columns="part").assign(sequence_id=(level << 62) + (int(key[0]) << 24) + bins, offset=offset)

        return packed

    def dealt(df: DataFrame, n: int, size: int) -> DataFrame:
        # df is read from files, where a row's number is the same in every attempt; equal rows are dealt out by it, too.
        return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(max(1, -(-n // size)))))

    whole = cut.where(F.col("length") == most).select("*", (F.lit((1 << 61)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < most)
    n = rest.count()
    first = staged(dealt(rest, n, group_pieces).groupBy("part").applyInPandas(run(0), schema), "pack-first")
    loose = first.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < full * most).select("sequence_id")
    marked = staged(first.join(loose.withColumn("loose", F.lit(True)), "sequence_id", "left"), "pack-marked")
    again = marked.where("loose").select(*cut.columns)
    m = again.count()
    second = dealt(again, m, 2 * group_pieces).groupBy("part").applyInPandas(run(1), schema)
    cols = [*cut.columns, "sequence_id", "offset"]
    return whole.select(cols).unionByName(marked.where("loose is null").select(cols)).unionByName(second.select(cols))


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 2048, **settings) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, most), "pieces"), most, **settings)
