"""The registered queries by their contract on a small table, and the pipeline against a plain version of its stages."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("verdictlake.llm")
import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import plain_encode, sentences, shingles, words  # noqa: E402
from verdictlake.llm import language_id, quality  # noqa: E402
from verdictlake.llm.queries import ORACLE, QUERIES, tokenizer_path  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LETTERS = {"aa": "bcdfgaei", "bb": "klmnpouy"}
CONTRACT = {
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_jaccard_join": "doc_id bigint, class_id bigint, links bigint",
}


def corpus():
    rng, rows = np.random.default_rng(8), []
    for i in range(240):
        lang = ["aa", "bb"][i % 2]
        text = " ".join("".join(rng.choice(list(LETTERS[lang]), rng.integers(2, 7))) for _ in range(rng.integers(20, 60)))
        rows.append((i, text if i % 12 else text.upper().replace(" ", "!! ")[:200], lang if i % 5 else None, ["s1", "s2", None][i % 3], 0))
    for i in range(240, 260):  # copies and near copies
        w = rows[i - 200][1].split()
        w[3:4] = [] if i % 2 else w[3:4]
        rows.append((i, " ".join(w), "aa", "s2", 0))
    rows += [(260, None, "aa", "s1", 0), (261, "", None, None, 0), (262, "123 !!", "bb", "s1", 0), (None, rows[7][1] + " end", None, "s1", 0), (263, words(1, 4000), None, "s2", 0)]
    return rows


def store(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0 if r[0] % 12 == 0 else 1, 0) for r in rows if r[0] is not None and r[0] < 240 and r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"http://h{i % 3}.com/{'fr' if i % 2 else 'de'}/{i}", "x" * (50 * (i % 4)) if rows else None) for i in range(12 if rows else 0)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    x = np.random.default_rng(1).normal(size=(120 if rows else 0, 8))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    return store(spark, tmp_path_factory.mktemp("small"), corpus())


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_contract(spark, sf_dir, tmp_path, name):
    for folder, n in ((sf_dir, len(corpus())), (store(spark, tmp_path, []), 0)):
        df = QUERIES[name](spark, folder)
        kinds = dict(df.dtypes)
        for c in CONTRACT.get(name, "").split(", ") if name in CONTRACT else ["doc_id bigint", "text_sha256 string"]:
            column, kind = c.split(" ")
            assert kinds[column] == kind
        rows = df.collect()
        per_document = name not in ("op2_best_fit_packing", "op4_nearest_neighbours", "op5_url_filters", "op7_warc")
        assert len(rows) == (n if per_document else {"op4_nearest_neighbours": 15, "op5_url_filters": 12, "op7_warc": 12}.get(name, len(rows)) if n else 0)
    assert name in ORACLE or name in {f"op{i}_{x}" for i, x in ((2, "best_fit_packing"), (3, "fingerprints"), (4, "nearest_neighbours"), (6, "quality"), (8, "language"), (10, "jaccard_join"))}


def plain_mix(docs):
    """doc -> copies: multiplier by bisection, then words from the largest size down."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = {s: [size(d["text"]) for d in docs if d["source"] == s] for s in order}
    weight, cap, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * sum(x) for s, x in sizes.items()}, {}
    whole, left = 1.5 * sum(map(sum, sizes.values())), list(order)
    while left:
        level = (whole - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if cap[s] <= level * weight[s]]
        target |= {s: float(cap[s]) for s in full} if full else {s: level * weight[s] for s in left}
        left = [s for s in left if s not in target]
    copies = collections.Counter()
    for s in order:
        own = [d for d in docs if d["source"] == s]
        x = np.array(sorted(v for v in sizes[s] if v))
        if not len(x):
            continue
        scale, low, high = x.mean(), -50.0 / (x[0] / x.mean()), (math.log(2) + 1) / (x[0] / x.mean())
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (x * np.minimum(2, np.exp(np.minimum(700, mid * x / scale)))).sum() < target[s] else (low, mid)
        rate = lambda v: round(min(2.0, math.exp(min(700, low * v / scale))), 9)  # noqa: B023, E731
        count = collections.Counter(x.tolist())
        owed, later, room = 0.0, sum(n * rate(v) * v for v, n in count.items()), sum(2.0 * n * v for v, n in count.items())
        for v in sorted(count, reverse=True):
            n = count[v]
            want, later, room = owed + n * rate(v) * v, later - n * rate(v) * v, room - 2.0 * n * v
            near, least, top = math.floor(want / v + 0.5), math.ceil((want + later - room) / v - 1e-6), math.floor((want + later) / v + 1e-6)
            k = max(0, min(max(least, min(near, top)) if least <= top else near, 2 * n))
            owed = want - k * v
            of_size = sorted((d for d in own if size(d["text"]) == v), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0))
            for at, d in enumerate(of_size):
                copies[(d["doc_id"], d["text"])] += k // n + (at < k % n)
        for d in own:
            if not size(d["text"]):
                copies[(d["doc_id"], d["text"])] += 1
    return copies


def test_pipeline_equals_its_plain_version(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judge = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    good = [r for r in rows if judge.score(quality.features([r["text"] or ""]))[0] >= 0.3]
    assert 200 < len(good) < len(rows)
    tongue = language_id.learn(spark.createDataFrame([tuple(r.values()) for r in good], DOCS))
    named = [r for r in good if (p := tongue.predict([r["text"] or ""]))[0][0] != "und" and p[1][0] >= 0.3]
    sets, parent = [shingles(r["text"]) for r in named], list(range(len(named)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(named)):
        for j in range(i):
            if named[i]["text"] == named[j]["text"] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i, r in enumerate(named):
        groups[find(i)].append(r)
    one = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(r["text"].encode()).digest())) for g in groups.values()]
    assert len(one) < len(named)
    want = collections.Counter()
    for (doc_id, text), n in plain_mix(one).items():
        ids = plain_encode(tokenizer_path(), text)
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(-1 if doc_id is None else doc_id, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += n
    mine = collections.Counter((-1 if a is None or a != a else int(a), *map(int, b)) for a, *b in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert mine == +want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 2048 and list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]


def test_pipeline_on_nothing_and_clashing_names(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, store(spark, tmp_path, [])).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit("mine") for c in ("own", "found", "li_found", "mx_row", "jj_key", "label", "kind", "x")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        assert {r["li_found"] for r in kept.select("li_found").distinct().collect()} == {"mine"}, name
