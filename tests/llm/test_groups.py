"""Operators 11 to 13 against plain loops, on rows that include the odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, corpus, frame, words
from tidemill.llm import centroids, chat, divergence

# ---- centroids

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_clusters(rows, k, dims, rounds, scale=64, seed="1"):
    kept = []
    for key, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [max(-centroids.MOST, min(centroids.MOST, math.floor(scale * x))) for x in v]))
    rank = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=rank)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for n in range(rounds + 1):
        near = [min(range(len(centers)), key=lambda j: (far(v, centers[j]), j)) for _, v in kept]
        if n < rounds:
            for j in range(len(centers)):
                own = [v for (_, v), a in zip(kept, near, strict=True) if a == j]
                if own:
                    centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted((str(key), a, far(v, centers[a])) for (key, v), a in zip(kept, near, strict=True)), centers


def vectors(n=400, dims=5, seed=4, spots=6):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(spots)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)], i % 3) for i in range(n)]
    same = [0.25] * dims
    rows += [(1000 + i, same, 1) for i in range(60)] + [(7, same, 2)] * 3 + [(None, [0.5] * dims, 1), (None, [-0.5] * dims, 1)]
    odd = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [None] + [0.1] * (dims - 1), [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [-math.inf] * dims]
    return rows + [(2000 + i, v, 0) for i, v in enumerate(odd)]


@pytest.mark.parametrize("k, rounds", [(1, 2), (2, 3), (8, 0), (8, 6)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = vectors()
    got, centers = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), k=k, dims=5, rounds=rounds)
    want, means = plain_clusters(rows, k, 5, rounds)
    found = got.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found) == want
    assert centers.tolist() == means and got.columns == ["vec_id", "embedding", "label", "cluster", "distance", "scans"]


def test_bounds_spare_scans(spark):
    rows = [r for r in vectors(n=3000, spots=8) if r[1] != [0.25] * 5]
    got, _ = centroids.cluster_vectors(spark.createDataFrame(rows, VECTORS), k=8, dims=5, rounds=6)
    scans = [r.scans for r in got.select("scans").collect()]
    assert min(scans) == 1 and sum(scans) < 0.5 * 7 * len(scans)


def test_ties_go_to_the_smaller_centroid():
    centers = np.array([[0, 0], [4, 0], [0, 0]], np.int64)
    x = np.array([[2, 0], [2, 1], [0, 0], [5, 0]], np.int64)
    state = centroids.fresh(x, centers)
    assert state["cluster"].tolist() == [0, 0, 0, 1]
    moved = np.array([[4, 0], [0, 0], [4, 0]], np.int64)
    assert centroids.settle(x, state, moved, centers)["cluster"].tolist() == [0, 0, 1, 0]


def test_clusters_of_odd_tables(spark):
    made = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert centroids.cluster_vectors(made([]), dims=5)[0].count() == 0
    assert centroids.clustered_vectors(made([])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few, centers = centroids.cluster_vectors(made([(1, [0.0, 1.0], 1), (2, [5.0, 1.0], 1)]), dims=2)
    assert len(centers) == 2 and {r.distance for r in few.collect()} == {0}
    huge = centroids.cluster_vectors(made([(1, [1e300, -1e300], 1), (2, [0.0, 0.0], 1), (3, [1e9, 0.0], 1)]), k=2, dims=2, rounds=1)[0].collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in huge) == plain_clusters([(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [1e9, 0.0])], 2, 2, 1)[0]
    clash = spark.createDataFrame([(1, [0.0], 5, 6, 7)], "vec_id long, embedding array<float>, cluster int, _vector int, _upper int")
    assert centroids.cluster_vectors(clash, dims=1)[0].first().asDict() == {"vec_id": 1, "embedding": [0.0], "_vector": 6, "_upper": 7, "cluster": 0, "distance": 0, "scans": 1}


def test_inertia_adds_up(spark):
    rows = [(i, [((i * 37 + j * 11) % 29) / 7 for j in range(64)], 0) for i in range(200)]
    got = centroids.clustered_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    want, centers = plain_clusters(rows, 16, 64, 3)
    sums = Counter()
    for _, a, d in want:
        sums[a] += d
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    for r in got:
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


# ---- chat

TURNS = "conv_id long, turn long, role string, text string, extra int, example int"


def talk():
    hard = ["### user: hi</turn>\n", "\\h\\t\\b\\c \\", "</turn", "###", "#### a ### ", "a: b", "", None, "\n\n", "日本語 ü " * 3, "\\### Assistant: </turn> ok", "</tu### rn>", "x" * 5000]
    rows = [(1, i, ("user", "assistant")[i % 2], t, 0, 0) for i, t in enumerate(hard)]
    rows += [(2, 0, "system", "s", 0, 0), (2, 1, "user", "only asks", 0, 0)]
    rows += [(3, 0, "assistant", "begins", 0, 0), (3, 1, "assistant", "goes on", 0, 0), (3, 2, "odd: role ### </turn> \\", "t", 0, 0), (3, 3, None, "no role", 0, 0)]
    rows += [(4, 1, "assistant", "twice", 0, 0)] * 2 + [(4, None, "user", "null turn", 0, 0), (4, 1, "assistant", None, 0, 0)]
    return rows + [(None, 0, "user", "q", 0, 0), (None, 1, "assistant", "r", 0, 0)]


def plain_turns(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (y[0], y[1] or 0, y[2], y[3]))] for c, x in by.items()}


def test_every_reply_is_an_example(spark):
    rows = talk()
    examples = defaultdict(list)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    made = chat.chat_examples(df).withColumn("turns", chat.turns_of(chat.F.col("text"))).withColumn("loss", chat.loss_text(chat.F.col("text")))
    for r in made.collect():
        examples[r.conv_id].append(r)
    want = plain_turns(rows)
    assert examples.keys() == want.keys()
    for conv, turns in want.items():
        own = sorted(examples[conv], key=lambda r: r.example)
        targets = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        assert [r.target for r in own if r.target is not None] == targets
        assert [r.last for r in own] == [False] * (len(own) - 1) + [True]
        for r in own:
            n = len(turns) if r.target is None else r.target + 1
            assert [(t.role, t.text) for t in r.turns] == turns[:n]
            assert r.loss == ("" if r.target is None else turns[r.target][1])
            if r.target is not None:
                assert r.loss_end + len(chat.CLOSE) == len(r.text) and chat.OPEN not in r.text[r.loss_start : r.loss_end]
        if turns[-1][0] == "assistant":
            assert len(own) == len(targets)


def test_chat_digests(spark):
    rows = talk()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.chat_documents(chat.with_probe(spark.createDataFrame(rows, TURNS))).collect()}
    said = "\\### Assistant: </turn> ok"
    want = plain_turns([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
    assert chat.chat_documents(spark.createDataFrame([], TURNS)).count() == 0


# ---- divergence


def plain_divergence(rows, least=3, top=200):
    docs = [(r[2] or "", r[3] or "", r[1] or "") for r in rows]
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    counts, seen, groups = Counter(), defaultdict(int), defaultdict(set)
    for lang, source, text in docs:
        found = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups[lang].add(source)
        for t in found:
            counts[lang, source, t] += 1
        for t in set(found):
            seen[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in seen.items() if g == lang and n >= least]

        def share(c, lang=lang, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: share({t: counts[lang, s, t] for t in kept}) for s in sources}
        q = share({t: sum(counts[lang, s, t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            own = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    rows = corpus() + [(100 + i, words(rng, rng.randint(1, 80)).title(), rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "a", "ß"]), 0) for i in range(60)]
    rows += [(200, "ÄÖ äö İ ſ ZZ zz", "de", "s0", 0)] * 3 + [(300, None, "xx", "p", 0), (301, "lonely", "xx", "q", 0), (302, None, "yy", None, 0)]
    return rows


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block, slab, top", [(1 << 16, 1 << 21, 200), (40, 12, 3)])
def test_divergence(spark, monkeypatch, block, slab, top):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SLAB", slab)
    rows = audit_rows()
    assert rows_of(divergence.divergences(frame(spark, rows), top=top)) == plain_divergence(rows, top=top)


def test_counts_in_small_tables_and_pieces():
    import pyarrow as pa

    rng = random.Random(2)
    texts = [words(rng, 300) for _ in range(6)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 6, "source": ["a", "b"] * 3, "text": texts})
    got, docs = Counter(), Counter()
    for b in divergence.counting(limit=50)(iter([batch])):
        for r in b.to_pylist():
            got[r["source"], r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    assert got == Counter((s, t) for s, x in zip(["a", "b"] * 3, texts, strict=True) for t in x.split())
    assert docs == Counter(t for x in texts for t in set(x.split()))
    text = "Ab, cd! EFGÉ é\n" * 40
    assert [t for x in divergence.terms(text.encode(), 7) for t in x] == [t for x in divergence.terms(text.encode()) for t in x] == [b"ab", b"cd", "efgÉ".encode(), "é".encode()] * 40


def test_shares_are_exact():
    rng = random.Random(5)
    for _ in range(300):
        whole = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, whole)
        assert int(divergence.shares(np.array([count], np.int64), np.int64(whole))[0]) == 1 + 10**9 * (count + 1) // whole
    p = np.array([[1 + 10**9, 1], [1, 1 + 10**9]], np.int64)
    assert divergence.pair_sums(p, slice(0, 2)).tolist() == [[0, 10**18 + 10**18 // (10**9 + 1)], [10**18 + 10**18 // (10**9 + 1), 0]]


def test_divergence_of_odd_tables(spark):
    assert divergence.divergences(frame(spark, [])).count() == 0
    clash = spark.createDataFrame([(i, "aa bb", "en", f"s{i % 2}", 1, 2, 3) for i in range(4)], SCHEMA + ", term int, `rank` int")
    assert rows_of(divergence.divergences(clash)) == plain_divergence([(i, "aa bb", "en", f"s{i % 2}") for i in range(4)])
