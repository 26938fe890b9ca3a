"""The operators against brute force, exact round trips and held-out accuracy, on rows that include the odd cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import SCHEMA, corpus, frame, words
from tidemill.llm import fingerprints, jaccard, line_dedup, media, mixing, packing, quality, secrets, suffixes, token_files
from tidemill.llm.common import new_folder
from tidemill.llm.tokens import BYTE_BPE, Encoder

PATH = public_tokenizers.path(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# ---- tokens


def test_encoder_equals_the_library(library):
    rng = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "b", "é", "ж", "1", ".", "'s", " ", "\x1c", "日", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [t or "" for _, t, *_ in corpus()]
    texts += ["".join(rng.choice(["\n", "\n", " ", "a", "b.", "\t", "ж", "<|endoftext|>"]) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext"]
    assert library("<|endoftext|>") == [50256]
    e = Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in e.encode(texts)] == [library(t) for t in texts]


def test_token_files(spark, library):
    rows = corpus()
    got = {r.doc_id: r for r in token_files.token_documents(frame(spark), PATH, length=64).collect()}
    start = 0
    for key, text, *_ in rows:
        ids = [*library(text), 0]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(rows)


def test_token_file_layout(spark, library):
    index = token_files.write_token_files(frame(spark), new_folder(spark, "tokens"), PATH, length=32)
    for path in {r.path for r in index.select("path").distinct().collect()}:
        shard = token_files.ShardReader(path)
        total = index.where(F.col("path") == path).agg(F.sum("n_tokens")).first()[0]
        masks = [shard.sequence(i)[1].to_pylist() for i in range(-(-total // 32))]
        n_batches = -(-(-(-total // 32)) // token_files.ROWS)
        assert all(shard.batch(i).num_rows == token_files.ROWS for i in range(n_batches - 1)) and len(shard.held) <= 4
        whole = np.concatenate([shard.ids(at, min(50, total - at)) for at in range(0, total, 50)])
        assert (whole == shard.ids(0, total)).all()
        assert sum(map(sum, masks)) == total and all(len(m) == 32 for m in masks)


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(None, "b c", "en", "s", 3), (None, "a", "en", "s", 1), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1)]
    got = token_files.token_documents(frame(spark, rows), PATH, length=8).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 4, 4]
    assert token_files.token_documents(frame(spark, []), PATH).count() == 0


# ---- lines


def line_chunks(text):
    """The lines of a text and its chunks, as lists of places."""
    lines, rolled, before = text.split("\n"), [], 0
    for line in lines:
        h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
        rolled.append((h + before * line_dedup.BASE) % line_dedup.MODULUS)
        before = h
    out, own = [], []
    for i in range(len(lines)):
        own.append(i)
        if i == len(lines) - 1 or 0 < i < len(lines) - 2 and rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]:
            out.append(own)
            own = []
    return lines, out


def lines_by_brute_force(rows):
    firsts, result = {}, {}
    for key, text, *_ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            result[key] = None
            continue
        lines, parts = line_chunks(text)
        gone = set()
        for k, part in enumerate(parts):
            chunk = "\n".join(lines[i] for i in part)
            if len(part) < 2 or not re.search(r"\S", chunk):
                continue
            before = [lines[i] for i in reversed(sum(parts[max(0, k - 2) : k], []))]
            after = [lines[i] for i in sum(parts[k + 1 : k + 3], [])]
            if chunk not in firsts:
                firsts[chunk] = before, after
                continue
            same = lambda a, b: len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(a, b))))
            gone |= set(range(part[0] - same(before, firsts[chunk][0]), part[-1] + 1 + same(after, firsts[chunk][1])))
        result[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return result


def test_line_dedup(spark):
    rows = corpus() + [(100 + i, "head %d\n" % i + "x y\nz w\nq\nr r\nt\nu\nv v\nw\n" * 3 + "tail", "en", "s1", 1) for i in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame(spark, rows).withColumn("doc", F.lit(1)).withColumn("spans", F.lit("x"))).collect()}
    want = lines_by_brute_force(rows)
    assert got == want
    assert sum(a != b for a, b in zip((r[1] for r in rows), (want[r[0]] for r in rows))) > 5
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def test_no_chunk_of_one_line():
    rng = random.Random(3)
    for n in range(2, 60):
        lines, parts = line_chunks("\n".join(str(rng.randrange(9)) for _ in range(n)))
        assert sum(parts, []) == list(range(n)) and all(len(p) > 1 for p in parts)


def test_line_dedup_of_planted_passages(spark):
    """Passages of 2 to 12 lines in two texts each: what is removed is theirs alone, and most of longer ones goes."""
    rng = random.Random(11)
    rows, planted = [], {}
    for k in range(220):
        n = 2 + k % 11
        passage = [f"{words(rng, 5)} p{k} {i}" for i in range(n)]
        for copy in (0, 1):
            own = [f"{words(rng, 6)} {k} {copy} {i}" for i in range(14)]
            rows.append((2 * k + copy, "\n".join([*own[:7], *passage, *own[7:]]), "en", "s", 1))
        planted[2 * k + 1] = n
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    assert all(got[2 * k].n_removed == 0 for k in range(220))
    removed, total = Counter(), Counter()
    for key, n in planted.items():
        assert got[key].n_removed in (0, n)
        removed[n] += got[key].n_removed
        total[n] += n
    assert all(removed[n] >= 0.9 * total[n] for n in (9, 10, 11, 12)), [(n, removed[n] / total[n]) for n in total]


def test_line_dedup_of_repeated_rows(spark):
    rows = [(1, "a b\nc d\ne f\ng h\ni j\nk l\nm n", "en", "s", 1)] * 2
    assert {r.n_removed for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()} == {0}
    passage = "\n".join(f"passage line {i} here" for i in range(12))
    rows = [(1, "own\n" + passage + "\nend", "en", "s", 1)] * 2 + [(2, "other\n" + passage + "\nlast", "en", "s", 1)] * 3
    one = line_dedup.drop_repeated_lines(frame(spark, [rows[0], rows[2]])).where("doc_id = 2").first()
    got = [r for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect() if r.doc_id == 2]
    assert len(got) == 3 and {(r.text, r.n_removed, r.n_chunks) for r in got} == {(one.text, one.n_removed, one.n_chunks)}
    assert one.n_removed == 12 and one.text == "other\nlast"


# ---- secrets


def test_window_entropy_is_incremental():
    rng = random.Random(1)
    for _ in range(30):
        run = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(5, 70)))
        width, least = 24, 3.2
        flagged = [False] * len(run)
        for i in range(len(run) - width + 1):
            counts = Counter(run[i : i + width]).values()
            if -sum(n / width * math.log2(n / width) for n in counts) >= least - 1e-9:
                flagged[i : i + width] = [True] * width
        got = [False] * len(run)
        for a, b in secrets.window_spans(run, width, least):
            got[a:b] = [True] * (b - a)
        assert got == flagged


def test_secret_shapes(spark):
    key = "AKIA" + "Q7X9" * 4
    text = f"é token=secret: abcdefghij PASSWORD = 'hunter2hunter2' {key} " + "0123456789abcdef" * 2 + " api_key:short"
    rows = [(1, text, "en", "s", 1), (2, None, "en", "s", 0), (3, "plain words only", "en", "s", 1)]
    got = {r.doc_id: r for r in secrets.secret_digest(frame(spark, rows)).collect()}
    base = [("assign", m.start(), m.end()) for m in re.finditer(r"PASSWORD = 'hunter2hunter2", text)]
    base += [("access", text.index(key), text.index(key) + 20), ("hex", text.index("0123"), text.index("0123") + 32)]
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda x: x[1]))
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[2].spans == "" == got[3].spans
    kept = secrets.find_secrets(frame(spark, rows).withColumn("_scanned", F.lit(1)))
    assert kept.columns[-1] == "secrets" and kept.count() == 3


def spans_by_brute_force(text):
    """Every window's entropy counted anew; the allow list is the operator's own."""
    found = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]{32,}", text)]
    for m in re.finditer("[A-Za-z0-9+/_.=-]{20,}", text):
        for kind, (runs, width, least) in secrets.CLASSES.items():
            for run in runs.finditer(m[0]):
                marked = [False] * len(run[0])
                held = [any(x.start() <= i < x.end() for x in secrets.PLACEHOLDER.finditer(run[0])) for i in range(len(marked))]
                for i in range(len(marked) - width + 1):
                    counts = Counter(run[0][i : i + width]).values()
                    if not any(held[i : i + width]) and -sum(n / width * math.log2(n / width) for n in counts) >= least - 1e-9:
                        marked[i : i + width] = [True] * width
                for flag, group in itertools.groupby(range(len(marked)), marked.__getitem__):
                    own = list(group)
                    if flag and not secrets.allowed(run[0]) and not secrets.allowed(run[0][own[0] : own[-1] + 1]):
                        at = m.start() + run.start()
                        found.append((at + own[0], at + own[-1] + 1, kind))
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2]), x[1]))


def test_secrets_against_brute_force(spark):
    rng = random.Random(12)
    signs = ["abcdef0123456789", "ABCxyz0189+/_-=.", "abcdefghijklmnopqrstuvwxyz", "aZ9"]
    made = [" ".join("".join(rng.choice(rng.choice(signs)) for _ in range(rng.randint(3, 90))) for _ in range(6)) for _ in range(150)]
    made += ["see wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY" + "q8Zt" * 9, "token: " + "Ab1" * 30, "a" * 50, "/usr/lib/python3/dist-packages/connection"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(made)] + [(k + 1000, t, "en", "s", 1) for k, t, *_ in corpus()]
    got = {r.doc_id: r.spans for r in secrets.secret_digest(frame(spark, rows)).collect()}
    want = {k: ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans_by_brute_force(t or "")) for k, t, *_ in rows}
    assert got == want
    assert sum("entropy" in x for x in want.values()) > 30


def test_secrets_of_long_runs_take_little_time():
    for run in ("ab1/" * 2500, "/aa" * 3400 + "9", "a" * 10_000, "Abc-" * 2500 + "7", "/" + "abcdefgh/" * 1200 + "x1", "Zx9Qw3Lr7Tn5Vb1Kd8Jf" * 500):
        start = time.perf_counter()
        secrets.scan(f"see {run} there")
        assert time.perf_counter() - start < 0.1


def test_secrets_of_odd_tables(spark):
    assert secrets.secret_digest(frame(spark, [])).count() == 0 == secrets.find_secrets(frame(spark, [])).count()
    rows = [(None, "token=abcdefgh1", "en", "s", 1)] * 3
    got = secrets.secret_digest(frame(spark, rows)).collect()
    assert [r.n_assign for r in got] == [1, 1, 1] and got[0] == got[1] == got[2]
    kept = secrets.find_secrets(frame(spark, rows).withColumn("secrets", F.lit("old")))
    assert kept.columns.count("secrets") == 1 and kept.first().secrets[0].kind == "assign"


def test_entropy_and_allow_list():
    blob = "Zx9Qw3Lr7Tn5Vb1Kd8Jf"
    assert any(k == "entropy_base64" for _, _, k in secrets.scan(f"see {blob} there"))
    assert secrets.scan("see averyveryverylongwordwithoutdigits there") == []
    assert secrets.scan("see abcdefghijklmnopqrstuvwxyz0123456789 there") == []


# ---- quality


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = words(rng, rng.randint(8, 60))
        rows.append((i, " ".join(w + rng.choice(["###", "$$$"]) for w in text.split()) if bad else text + ".", "en", "s", 1))
        labels.append((i, 0 if bad else 1))
    rows.append((1000, None, "en", "s", 0))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_documents(frame(spark, rows), marks).collect()}
    assert len(got) == 401
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert {r.doc_id for r in quality.keep_good(frame(spark, rows), marks).collect()} >= {i for i, q in labels if q}


def test_rules_compile_to_what_they_say(spark):
    """The one column expression against a plain reading of the rules, on odd texts, repeated rows and clashing names."""
    rng = random.Random(6)
    rules = [quality.Rule(tuple((rng.choice(list(quality.features())), rng.random() < 0.5, rng.uniform(0, 3)) for _ in range(rng.randint(1, 3)))).simplified() for _ in range(12)]
    model = quality.RuleModel(0.3, {r: rng.uniform(-2, 2) for r in rules})
    rows = [*corpus(), *corpus()[:3]]
    df = frame(spark, rows).withColumn("stats", F.lit(1)).withColumn("features", F.lit("x")).withColumn("_key", F.lit(2))
    got = quality.score(df, model)
    assert got.columns == [*df.columns, "score"] and got.count() == len(rows)
    values = {r.doc_id: r.features.asDict() for r in quality.with_features(frame(spark)).collect()}
    for r in got.collect():
        total = 0.3
        for rule, weight in model.weights.items():
            total += weight * all((values[r.doc_id][n] <= at) == below for n, below, at in rule.parts)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_of_repeated_and_odd_rows(spark):
    rows = [(1, "good words here.", "en", "s", 1)] * 30 + [(2, "### $$$ %%%", "en", "s", 1)] * 30 + [(None, None, "en", "s", 0)]
    marks = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    docs = frame(spark, rows).withColumn("_key", F.lit(1)).withColumn("_label", F.lit("x")).withColumn("quality", F.lit(0))
    model = quality.fit(docs, marks, sample=20)
    assert quality.score(docs, model).count() == 61
    assert quality.keep_good(docs, marks).columns == docs.columns
    assert quality.quality_documents(frame(spark, []), marks).count() == 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_documents(frame(spark), none).collect()} == {1.0}


def test_tree_paths():
    text = " Tree 0 (weight 1.0):\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    rules = quality.tree_paths(text, ["a", "b"])
    assert quality.Rule((("a", True, 0.5), ("b", False, 2.0))) in rules and len(rules) == 4


# ---- packing


def check_packing(rows, docs, library, capacity):
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, text, *_ in docs:
        ids, at = [*library(text), 2], 0
        pieces = sorted(by_doc[key], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-len(ids) // capacity) and all(p.length == capacity for p in pieces[1:])
        for p in pieces:
            assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing(spark, library):
    docs = corpus()
    got = packing.pack_documents(frame(spark), PATH, capacity=128).collect()
    used = check_packing(got, docs, library, 128)
    assert used <= 1.1 * -(-sum(r.length for r in got) // 128)
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


def test_packing_of_repeated_and_null_ids(spark):
    rows = [(None, "a b", "en", "s", 3)] * 3 + [(1, "c", "en", "s", 1)] * 2
    got = packing.pack_documents(frame(spark, rows), PATH).collect()
    assert len(got) == 5 and len({(r.sequence_id, r.offset) for r in got}) == 5


def test_packing_follows_the_written_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, words(rng, 5 if i < 600 else 90), "en", "s", 0) for i in rng.sample(range(900), 900)]
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "ordered"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = spark.read.parquet(str(tmp_path / "ordered"))
        read = [r.doc_id for r in docs.select("doc_id").collect()]
        assert read != sorted(read)  # as Spark reads it, the order is lost
        got = packing.pack_documents(docs, PATH, group=50).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    short = [(r.doc_id // 50, r.sequence_id >> 32) for r in got if r.length < 1024]
    assert len(short) == 900 and all(a == b for a, b in short)


def test_local_search_raises_squares_and_empties_bins():
    rng = random.Random(4)
    emptied = 0
    for _ in range(30):
        sizes = [rng.choice([401, 399, 602, 205, 333]) for _ in range(rng.randint(20, 200))]
        bins = packing.Bins(sizes, 1024)
        bins.best_fit(list(range(len(sizes))))
        before, squares = len(bins.items), sum(f * f for f in bins.fill)
        bins.search()
        assert sum(f * f for f in bins.fill) >= squares
        assert sorted(i for x in bins.items for i in x) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in x) == f <= 1024 for x, f in zip(bins.items, bins.fill))
        emptied += before - sum(1 for x in bins.items if x)
        if sum(map(bool, bins.items)) > bins.bound():
            assert not improving_steps(bins)
    assert emptied > 0


def test_local_search_of_many_small_pieces():
    """Bins of more than a hundred pieces, too, are left without an improving step."""
    rng = random.Random(14)
    for _ in range(3):
        sizes = [rng.choice([3, 4, 5, 7]) for _ in range(600)] + [rng.choice([701, 850, 990]) for _ in range(4)]
        bins = packing.Bins(sizes, 1024)
        bins.best_fit(list(range(len(sizes))))
        assert max(map(len, bins.items)) > 100
        bins.search()
        if sum(map(bool, bins.items)) > bins.bound():
            assert not improving_steps(bins)


def test_packing_deals_repeated_rows_out(spark, library):
    rows = [(5, "same words here", "en", "s", 1)] * 60 + [(None, "", "en", "s", 0)] * 30 + [(6, "a b " * 3000, "en", "s", 1)] * 2
    got = packing.pack_documents(frame(spark, rows), PATH, group=10).collect()
    assert max(Counter(r.sequence_id >> 32 for r in got if r.length < 1024 and r.sequence_id >= 0).values()) <= 10
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 1024 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.length for r in got) == sum(len(library(t)) + 1 for _, t, *_ in rows)


def improving_steps(bins):
    """Moves, one-for-one and two-for-one exchanges between underfull bins that would raise the sum of squares."""
    under = [b for b, x in enumerate(bins.items) if x and bins.fill[b] < bins.capacity]
    found = []
    for a, b in itertools.permutations(under, 2):
        gives = {tuple(bins.sizes[i] for i in x) for n in (1, 2) for x in itertools.combinations(bins.items[b], n)}
        takes = {tuple(bins.sizes[i] for i in x) for n in (0, 1, 2) for x in itertools.combinations(bins.items[a], n)}
        for x, y in itertools.product(gives, takes):
            moved = sum(x) - sum(y)
            if len(x) + len(y) < 4 and 0 < moved <= bins.capacity - bins.fill[a] and bins.fill[a] - bins.fill[b] + moved > 0:
                found.append((x, y))
    return found


# ---- suffixes


def removed_by_brute_force(rows, length=100):
    seen, out = set(), {}
    for key, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - length + 1):
            w = raw[q : q + length]
            if w in seen:
                gone[q : q + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [None, 2, 100_000])
def test_suffix_dedup(spark, crowd):
    want = removed_by_brute_force(corpus())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.drop_repeated_bytes(frame(spark), crowd=crowd).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_suffix_dedup_of_repeated_ids_and_nothing(spark):
    text = words(random.Random(8), 60)
    got = suffixes.drop_repeated_bytes(frame(spark, [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, "short", "en", "s", 1)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, len(text)]
    assert suffixes.drop_repeated_bytes(frame(spark, [])).count() == 0


def test_digest_tells_fronts_apart():
    # a birthday search: about 18 pairs of these fronts collide if a front counts by 32 bits alone
    rng, after, n = random.Random(7), b"z" * 100, 400_000
    assert len({suffixes.digest(rng.randbytes(84), after) for _ in range(n)}) == n
    assert suffixes.digest(b"ab", b"c") != suffixes.digest(b"a", b"bc")


def test_multikey_sort():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (300, 24)).astype(np.uint8)
    group = np.sort(rng.integers(0, 5, 300))
    order = suffixes.multikey_sort(rows, group)
    assert [(group[i], rows[i].tobytes()) for i in order] == sorted((g, r.tobytes()) for g, r in zip(group, rows))


# ---- media


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.media_documents(frame(spark)).collect()}
    by_text = {}
    for key, text, *_ in corpus():
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        by_text.setdefault(text or "", set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.media_documents(frame(spark, [])).count() == 0


def test_media_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "words " * 900, "en", "s", 1)] * 3 + [(4, "é" * 40, "en", "s", 1)] * 2 + [(None, None, "en", "s", 0)]
    got = media.media_documents(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter({(None, 5400): 3, (4, 80): 2, (None, 0): 1})
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == 3


def test_chunks_survive_shifts():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    whole, shifted = media.chunk_payloads([data, b"inserted" + data])
    assert b"".join(whole) == data and b"".join(shifted) == b"inserted" + data
    assert len(set(whole) & set(shifted)) >= 0.8 * len(whole)
    assert all(len(c) <= media.MOST for c in whole)


def test_a_broken_chunk_is_found(spark, tmp_path):
    path = tmp_path / "pack"
    path.write_bytes(media.zstandard.ZstdCompressor().compress(b"other"))
    chunk = {"seq": 0, "digest": media.digest(b"right"), "path": f"file://{path}", "at": 0, "size": path.stat().st_size}
    with pytest.raises(ValueError):
        media.load([chunk])


# ---- fingerprints


def test_fingerprints(spark):
    rows = corpus()
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark)).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for i, (key, *_) in enumerate(rows):
        t, following = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        assert got[key].n_chars == len(t)
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[key].near_edited <= 1 and 0 <= got[key].near_next <= 1
        if edited == t:
            assert got[key].near_edited == 1
    by_text = {}
    for (key, *_), t in zip(rows, texts):
        by_text.setdefault(t, set()).add(got[key].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    far = [got[k].near_edited - got[k].near_next for k in (0, 1, 3, 4)]
    assert all(x > 0 for x in far)


def ring_by_brute_force(keys):
    """keys: the (packed) hashes of a text's numbered k-mers, with places in the low bits."""
    out, n = [], len(keys)
    ring = sorted(keys)
    for j in range(fingerprints.SKETCHES):
        point = ((j << 64) // fingerprints.SKETCHES) - (1 << 63)
        at = sum(k < point for k in ring)
        out.append(tuple(k >> fingerprints.PLACE for k in sorted((ring[(at + x) % n] for x in range(min(n, fingerprints.TUPLE))), key=lambda k: k & fingerprints.LOW)))
    return out


def test_fingerprints_keep_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, 8)], "doc_id long, _words string, _kmers int, _ring int")
    got = fingerprints.fingerprint_of(df, F.col("_words"), "mark")
    plain = fingerprints.fingerprint_of(df.select(F.col("_words").alias("text")), F.col("text"), "mark").first().mark
    assert got.columns == ["doc_id", "_words", "_kmers", "_ring", "mark"] and tuple(got.first()) == (1, "a b c d e f", 7, 8, plain)


def test_tuples_equal_a_plain_ring(spark):
    """Two texts have equal tuples where a plain reading of the definition says so, up to one shared hash function."""
    rng = random.Random(9)
    a = words(rng, 60)
    b = " ".join([*a.split(" ")[:40], *words(rng, 20).split(" ")])
    c = "x y z x y z x y z x y z"
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, " ".join(reversed(c.split(" "))))], "id long, text string")
    marks = {r.id: r.mark for r in fingerprints.fingerprint_of(df, F.col("text"), "mark").collect()}

    def packed(text):
        w = text.split(" ")
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
        words_frame = spark.createDataFrame([(i, *g) for i, g in enumerate(grams)], "i int, a string, b string, c string, d string, e string")
        hashed = words_frame.select("i", F.xxhash64(*[F.xxhash64(x) for x in "abcde"]).alias("h")).orderBy("i").collect()
        seen, keys = Counter(), []
        for r in hashed:
            keys.append((r.i, r.h, seen[r.h]))
            seen[r.h] += 1
        numbered = spark.createDataFrame(keys, "i int, h long, o int").select("i", F.xxhash64("h", "o").alias("h")).collect()
        return [(r.h >> fingerprints.PLACE << fingerprints.PLACE) | r.i for r in numbered]

    tuples = {i: ring_by_brute_force(packed(t)) for i, t in ((1, a), (2, b), (3, c))}
    for i in (1, 2, 3):
        for k in (1, 2, 3):
            assert [x == y for x, y in zip(marks[i], marks[k])] == [x == y for x, y in zip(tuples[i], tuples[k])]
    assert marks[3] != marks[4]


# ---- near duplicates


def shingle_set(text):
    """All runs of five words, all words if there are fewer; words as they are, parted by ASCII white space."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def links_by_brute_force(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9 and sets[a] & sets[b]:
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    names = {}
    for i, (key, *_) in enumerate(rows):
        if key is not None:
            names[top(i)] = min(names.get(top(i), key), key)
    return [(key, names.get(top(i)), links[i]) for i, (key, *_) in enumerate(rows)]


def by_null(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    want = links_by_brute_force(corpus())
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(frame(spark)).collect()]
    assert sorted(got) == sorted(want)
    assert max(n for *_, n in want) >= 2


def chains(seed=21):
    """Chains of texts, each a changed copy of the one before at similarities from 0.7 to 0.95, so that groups are sparse."""
    rng, rows = random.Random(seed), []
    for c in range(6):
        text = words(rng, 120).split(" ")
        for _ in range(25):
            rows.append((len(rows) * 3, " ".join(text), "en", "s", 1))
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("block", [4])
def test_links_of_chains(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    want = dict((k, n) for k, _, n in links_by_brute_force(chains()))
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(frame(spark, chains())).collect()}
    assert all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.998 * sum(want.values()) > 200


def test_prefixes_are_shortened_where_links_are_weak(spark, monkeypatch):
    """Few trees miss pairs at the first depth; going on below matched prefixes finds more of them."""
    depths, verify = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda members, depth, *rest: depths.append(depth) or verify(members, depth, *rest))
    want = sum(n for *_, n in links_by_brute_force(chains()))
    found = []
    for recall in (0.0, 0.9999):
        monkeypatch.setattr(jaccard, "RECALL", recall)
        monkeypatch.setattr(jaccard, "START", 0.6)
        found.append(sum(r.n_links for r in jaccard.near_duplicates(frame(spark, chains()), trees=4).collect()))
    assert depths[0] == depths[1] and depths[1:] == sorted(depths[1:], reverse=True) and len(depths) > 2
    assert found[0] < 0.97 * want and found[1] > 0.99 * want


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(None, a, "en", "s", 1)] * 3 + [(None, a + " more", "en", "s", 1), (7, b, "en", "s", 1), (7, b + " end", "en", "s", 1), (7, a, "en", "s", 1), (None, None, "en", "s", 0)]
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=by_null) == sorted(links_by_brute_force(rows), key=by_null)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(frame(spark, rows).withColumn("row", F.lit(1)).withColumn("_row", F.lit(2))).collect()]
    assert sorted(kept, key=by_null) in [sorted(x, key=by_null) for x in ([(7, a), (7, t), (None, None)] for t in (b, b + " end"))]
    nothing = frame(spark, [(None, x, "en", "s", 1) for x in (a, a, a + " x", b)])
    assert jaccard.keep_first(nothing).count() == 2


def test_keep_first(spark):
    want = {k for k, c, _ in links_by_brute_force(corpus()) if k == c}
    blank = {k for k, t, *_ in corpus() if not (t or "").strip()}
    assert {r.doc_id for r in jaccard.keep_first(frame(spark)).collect()} == want | blank
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_depth_meets_the_recall():
    depth = jaccard.depth_for(0.8)
    assert jaccard.chance(0.8, depth) >= jaccard.START
    assert depth == jaccard.DEPTH or jaccard.chance(0.8, depth + 1) < jaccard.START
    assert 1 - jaccard.RECALL > 1 / jaccard.chance(0.8, depth - 1) - 1  # the next depth ends the search at the threshold


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(70, 100)]
    parent = list(range(110))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert all(got.get(i, i) == top(i) for i in range(110))


# ---- mixing


def water_fill(sizes, weights, total):
    targets = {k: 0.0 for k in sizes}
    open_, left = set(sizes), total
    while open_ and left > 1e-9:
        w = sum(weights[k] for k in open_)
        excess = 0.0
        for k in list(open_):
            targets[k] += left * weights[k] / w
            if targets[k] >= 2 * sizes[k]:
                excess += targets[k] - 2 * sizes[k]
                targets[k] = 2.0 * sizes[k]
                open_.discard(k)
        left = excess
    return targets


def test_mixing(spark):
    rows = corpus()
    got = mixing.allot(frame(spark)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    targets = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for r in got:
        assert r.size == size(rows[r.doc_id][1]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
    for s in names:
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(targets[s], abs=1)
    again = mixing.allot(frame(spark).repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.allot(frame(spark, [])).count() == 0


def test_mix_emits_what_it_takes(spark):
    given = {r.doc_id: r.taken for r in mixing.allot(frame(spark)).collect()}
    got = mixing.mix(frame(spark)).collect()
    took = Counter()
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert n == r.mix_words and 0 <= r.mix_position <= 1
        took[r.doc_id] += n
    assert took == Counter({k: v for k, v in given.items() if v})


def test_mixed_documents_add_up_the_training_order(spark):
    want = sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.allot(frame(spark)).collect())
    firsts = {}
    for schedule in (mixing.SCHEDULE, ((1.0, 1.0),) * 3):
        got = mixing.mixed_documents(frame(spark), schedule=schedule).collect()
        assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == want
        mixed = mixing.mix(frame(spark), schedule=schedule).groupBy("doc_id").agg(F.min("mix_position").alias("p")).collect()
        firsts[schedule] = {r.doc_id: r.first_position for r in got if r.taken}
        assert firsts[schedule] == pytest.approx({r.doc_id: r.p for r in mixed})
    a, b = firsts.values()
    assert a.keys() == b.keys() and a != b
    assert mixing.mixed_documents(frame(spark, [])).count() == 0


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e", "en", "s", 9)] * 4 + [(None, f"p q r {i}", "en", "s", 7) for i in range(5)] + [(i, "x y z", "en", "t", 5) for i in range(20, 30)]
    given, took = Counter(), Counter()
    for r in mixing.allot(frame(spark, rows)).collect():
        given[r.doc_id] += r.taken
    got = mixing.mix(frame(spark, rows)).collect()
    for r in got:
        took[r.doc_id] += r.mix_words
    assert took == +given and max(Counter((r.doc_id, r.text, r.mix_epoch) for r in got if r.doc_id is None).values()) == 1
    assert Counter((r.doc_id, r.mix_epoch) for r in got)[7, 0] <= 4


def test_rows_of_one_document_are_summed_by_many_tasks(spark):
    rows = [(7, "a b c d e", "en", "s", 9)] * 400 + [(i, "x y", "en", "s", 3) for i in range(100, 140)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.allot(frame(spark, rows)).collect()
        again = mixing.allot(frame(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shown = lambda found: sorted((r.doc_id, r.size, r.before, r.taken) for r in found)
    befores = sorted(r.before for r in got)
    assert shown(got) == shown(again) and len(set(befores)) == 440 and sum(r.taken for r in got) == round(got[0].target)


def test_a_mix_can_be_mixed_again(spark):
    once = mixing.mix(frame(spark))
    again = mixing.mix(spark.createDataFrame(once.collect(), once.schema))
    plain = mixing.mix(spark.createDataFrame(once.select(*SCHEMA_NAMES).collect(), SCHEMA))
    assert again.columns == once.columns == plain.columns
    assert sorted((r.doc_id, r.mix_words) for r in again.collect()) == sorted((r.doc_id, r.mix_words) for r in plain.collect())


# ---- the pipeline


def test_pipeline_stages(spark, tmp_path, library):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus()
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if i % 6 == 5 else 1, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "source_mixing", "best_fit_packing"]
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select(*SCHEMA_NAMES).collect()
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
        after = docs.collect()
        assert docs.columns == SCHEMA_NAMES
        given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in before]
        if name == "line_dedup":
            want = {k: t for k, t in lines_by_brute_force(given).items()}
            assert all(want[r.doc_id] == r.text for r in after)
        if name == "jaccard_join":
            first = {k for k, c, _ in links_by_brute_force(given) if k == c}
            assert {r.doc_id for r in after} == {k for k, t, *_ in given if k in first or not (t or "").strip()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(library(r.text)) + 1 for r in docs.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in packed)


SCHEMA_NAMES = [x.strip().split()[0] for x in SCHEMA.split(",")]


# ---- paths that small tables would not take


def test_next_row_across_buckets(spark):
    ids = [0, 1, 2, 9, 10, 30, 31, 47]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    for n in (1, 4, 20, None):
        got = {r.doc_id: r._next.text for r in fingerprints.with_next(df, ["text"], n=n).collect()}
        assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    one = spark.createDataFrame([(5, "x")], "doc_id long, text string")
    assert [r._next.text for r in fingerprints.with_next(one, ["text"]).collect()] == ["x"]


def test_next_row_with_sparse_null_and_repeated_keys(spark):
    rng = random.Random(8)
    ids = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(200)} | {(1 << 62) + k for k in range(40)})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r._next.text for r in fingerprints.with_next(df, ["text"], n=8).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    rows = [(None, f"n{i}") for i in range(30)] + [(3, f"a{i}") for i in range(30)] + [(3, "same")] * 2 + [(7, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.text, r._next.text) for r in fingerprints.with_next(df, ["text"], n=4).collect()]
    assert sorted(a for a, _ in got) == sorted(b for _, b in got) == sorted(t for _, t in rows)  # one round through all
    follows = {a: b for a, b in got if a != "same"}
    assert follows["last"][0] == "n" and sum(a[0] == "n" and b[0] != "n" for a, b in got) == 1
    assert sorted(b for a, b in got if a == "same")[-1] == "same"
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(none).collect() == []


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST", -1)
    monkeypatch.setattr(suffixes, "BROADCAST", -1)
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame(spark)).collect()} == lines_by_brute_force(corpus())
    want = removed_by_brute_force(corpus())
    assert {r.doc_id: r.n_removed for r in suffixes.drop_repeated_bytes(frame(spark)).collect()} == {k: x[1] for k, x in want.items()}


def test_every_query_is_registered():
    from tidemill.llm import registry

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
