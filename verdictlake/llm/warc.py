"""WARC archives with an external, loser-tree merged index of captures.

Writing: each task writes its captures to gzip-per-record WARC files and, beside each file, one run: an index of the
file's captures sorted by URL key, timestamp and id. File names hold a fresh id, and only names that a finished task
returned are known, so files of lost or repeated attempts are never read. Of captures with equal payloads of at least
``least_bytes`` the one with the smallest id is a response, the others are revisit records without payload.

Merging: runs are merged ``fan_in`` at a time by a loser tree that holds one entry a run, pass by pass, until one pass
suffices. Every pass is cut into key ranges, each a task that seeks in every run to its start, so that no pass has fewer
tasks than ranges. The last pass's ranges in order are the globally ordered capture histories. A task holds one entry and
one read buffer a run; places to cut at come from a few marks a run, kept in a table and read a group at a time.

Defined results: a null payload is empty; a null URL has an empty key and comes first; a payload of any length is one
record; rows with equal ids are written as often as they occur, of equal payloads each row with the smallest id is a
response; a row without an id is a revisit where some row of its payload has one, else a response; an empty table gives no
archives and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, new_dir, staged

RUNS = "archive string, run string, captures bigint, marks string"
SEGMENTS = "run_no bigint, segment int, path string, captures bigint, marks string"
HISTORY = "part int, place bigint, url_key string, captured string, page_id bigint, archive string, offset bigint"
RECORDS = "archive string, offset bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then the rest, lower-cased: com,example,www)/a?b"""
    rest = (url or "").lower().partition("://")[2].partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/") if rest else ""


def record_bytes(kind: str, page_id: int | None, url: str | None, date: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit has the HTTP head alone and names its response and the payload's length."""
    block = HTTP + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so that the next winner costs one path of log2 k matches."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        k = len(sources)
        self.tree = [-1] * max(k, 1)
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, i: int) -> None:
        node, winner = (i + len(self.sources)) // 2, i
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to arrive waits here
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        if not self.sources:
            return
        while self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


def run_lines(path: str, start: int = 0) -> Iterator[tuple]:
    fs, p = place(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        for line in io.BufferedReader(f, 1 << 18):
            yield tuple(json.loads(line))


def write_run(entries: Iterator[tuple], path: str, marks: int = 64, every: int = 512) -> tuple[int, str]:
    """Write sorted entries; returns their number and, as JSON, at most 2 * marks (entry, byte offset) pairs spread over them."""
    fs, p = place(path)
    found: list = []
    n = at = 0
    with fs.open_output_stream(p) as f:
        for e in entries:
            if n % every == 0:
                found.append((e[:3], at))
                if len(found) > 2 * marks:
                    found, every = found[::2], every * 2
            line = json.dumps(e, ensure_ascii=False).encode() + b"\n"
            f.write(line)
            at, n = at + len(line), n + 1
    return n, json.dumps(found)


def write_archives(pages: DataFrame, folder: str, captures_a_file: int = 20_000, bytes_a_file: int = 256 << 20, level: int = 3) -> DataFrame:
    """pages: page_id, url, payload, digest, refers_to (null: response), captured. Returns the staged table of archives and runs."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        stream, entries, name, at = None, [], "", 0

        def closed() -> pa.RecordBatch:
            stream.close()
            entries.sort()
            n, marks = write_run(iter(entries), f"{folder}/{name}.run")
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}.warc.gz"], "run": [f"{folder}/{name}.run"], "captures": [n], "marks": [marks]})

        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    name, at, entries = uuid.uuid4().hex, 0, []
                    stream = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                kind = "response" if row["refers_to"] is None else "revisit"
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record_bytes(kind, row["page_id"], row["url"], row["captured"], row["digest"], (row["payload"] or "").encode(), row["refers_to"])) + packer.flush()
                stream.write(data)
                entries.append((url_key(row["url"]), row["captured"], -1 if row["page_id"] is None else row["page_id"], f"{name}.warc.gz", at))
                at += len(data)
                if len(entries) >= captures_a_file or at >= bytes_a_file:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    fs, root = place(folder)
    fs.create_dir(root, recursive=True)
    return staged(pages.mapInArrow(write, RUNS), "warc-runs")


def ranges_of(group: pd.DataFrame, captures_a_range: int) -> list[tuple[str, str, str]]:
    """low, high and, as JSON, per run the (segment, byte offset) pairs to read: the work of merging the group's runs."""
    runs: dict[int, list[tuple[str, list]]] = {}
    weighed: list[tuple[tuple, float]] = []
    for r in group.sort_values(["run_no", "segment"]).itertuples():
        marks = [(tuple(key), at) for key, at in json.loads(r.marks)]
        if marks:
            runs.setdefault(r.run_no, []).append((r.path, marks))
            weighed += [(key, r.captures / len(marks)) for key, _ in marks]
    weighed.sort()
    n = max(1, -(-int(group["captures"].sum()) // captures_a_range))
    before = np.cumsum([0.0, *(w for _, w in weighed)])
    places = np.searchsorted(before, before[-1] * np.arange(1, n) / n)
    cuts = sorted({weighed[i][0] for i in places if i < len(weighed)})
    out = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        sources = []
        for segments in runs.values():
            begins = [marks[0][0] for _, marks in segments]
            first = max(bisect.bisect_left(begins, low) - 1, 0) if low is not None else 0
            last = bisect.bisect_left(begins, high) if high is not None else len(segments)
            start = max((at for key, at in segments[first][1] if low is not None and key < low), default=0)
            sources.append([(path, 0) for path, _ in segments[first:last]])
            if sources[-1]:
                sources[-1][0] = (sources[-1][0][0], start)
        out.append((json.dumps(low), json.dumps(high), json.dumps([s for s in sources if s])))
    return out


def merged_range(low: str, high: str, sources: str) -> Iterator[tuple]:
    """The entries of a range in order, out of every run's segments."""
    low, high = (tuple(key) if key else None for key in (json.loads(low), json.loads(high)))

    def of_run(segments: list) -> Iterator[tuple]:
        for path, start in segments:
            for e in run_lines(path, start):
                if high is not None and e[:3] >= high:
                    return
                if low is None or e[:3] >= low:
                    yield e

    return iter(LoserTree([of_run(s) for s in json.loads(sources)]))


def merge_runs(runs: DataFrame, folder: str, fan_in: int = 64, captures_a_range: int = 50_000) -> DataFrame:
    """All captures, ordered by (part, place). Every pass merges at most fan_in runs in each group and is cut into key
    ranges; a merged run is the sequence of its ranges' segments. Runs, segments and marks stay in tables."""
    spark = runs.sparkSession
    n = runs.count()
    if not n:
        return spark.createDataFrame([], HISTORY)
    number = F.row_number().over(Window.orderBy("run")) - 1  # one thin row an archive
    segments = staged(runs.select(number.cast("long").alias("run_no"), F.lit(0).alias("segment"), F.col("run").alias("path"), "captures", "marks"), "warc-segments")

    def plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = ranges_of(group, captures_a_range)
        return pd.DataFrame({"run_no": key[0], "part": range(len(rows)), "low": [r[0] for r in rows], "high": [r[1] for r in rows], "sources": [r[2] for r in rows]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.run"
                captures, marks = write_run(merged_range(row["low"], row["high"], row["sources"]), path, marks=4)
                yield pa.RecordBatch.from_pydict({"run_no": pa.array([row["run_no"]], pa.int64()), "segment": pa.array([row["part"]], pa.int32()), "path": [path], "captures": [captures], "marks": [marks]})

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                for i, e in enumerate(merged_range(row["low"], row["high"], row["sources"])):
                    out.append((row["part"], i, e[0], e[1], None if e[2] < 0 else e[2], e[3], e[4]))
                    if len(out) == 8192:
                        yield history_batch(out)
                        out = []
                if out:
                    yield history_batch(out)

    while True:
        grouped = segments.withColumn("group", F.floor(F.col("run_no") / fan_in).cast("long")).groupBy("group")
        work = staged(grouped.applyInPandas(plan, "run_no bigint, part int, low string, high string, sources string"), "warc-plan")
        work = work.repartition(max(1, work.count()))
        if n <= fan_in:
            return work.mapInArrow(histories, HISTORY)
        merged = staged(work.mapInArrow(merge, SEGMENTS), "warc-segments")
        drop_staged(segments)
        segments, n = merged, -(-n // fan_in)


def history_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [c.split()[0] for c in HISTORY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(runs: DataFrame) -> DataFrame:
    """Every record of the archives, read from start to end. Digest and length of a response come from its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out: list[tuple] = []
                for at, data in members(path):
                    fields, payload = parse_record(data)
                    page = fields["WARC-Record-ID"].split(":")[2]
                    digest, size, refers = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"]), None
                    if fields["WARC-Type"] == "response":
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"damaged record in {path} at {at}")
                    else:
                        refers = int(fields["WARC-Refers-To"][1:-1].split(":")[2])
                    out.append((path.rsplit("/", 1)[-1], at, int(page) if page else None, fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], refers))
                    if len(out) == 2048:
                        yield records_batch(out)
                        out = []
                if out:
                    yield records_batch(out)

    n = runs.count()
    return runs.select("archive").repartition(max(1, n)).mapInArrow(read, RECORDS) if n else runs.sparkSession.createDataFrame([], RECORDS)


def records_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def members(path: str, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file."""
    fs, p = place(path)
    with fs.open_input_stream(p, compression=None) as f:
        at, pending = 0, f.read(chunk)
        while pending:
            unpacker, out, used = zlib.decompressobj(31), [], 0
            while not unpacker.eof:
                if not pending:
                    raise ValueError(f"{path} ends within a record")
                out.append(unpacker.decompress(pending))
                used += len(pending) - len(unpacker.unused_data)
                pending = unpacker.unused_data if unpacker.eof else f.read(chunk)
            pending = pending or f.read(chunk)
            yield at, b"".join(out)
            at += used


def capture_histories(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 100) -> DataFrame:
    """Write, merge and read back: one row a capture with its record and its place in the ordered histories."""
    spark = pages.sparkSession
    folder = new_dir(spark, "warc")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    own = own.withColumns({"digest": F.sha2("payload", 256), "captured": F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    first = own.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("same")).where("same > 1").select("digest", "first_id")
    own = own.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("first_id") != F.col("page_id")), F.col("first_id"))).drop("first_id")
    runs = write_archives(own, folder)
    history = merge_runs(runs, folder)
    records = read_archives(runs)
    # Both sides come from short lists of files, whose size Spark would take for theirs and broadcast one.
    return history.drop("page_id").hint("merge").join(records.hint("merge"), ["archive", "offset"])
