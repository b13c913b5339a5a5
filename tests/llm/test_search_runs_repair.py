"""Nearest neighbours, periodic runs and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF

from turnwise.llm import conversation_repair, nearest, periodic_runs
from turnwise.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))


def nearest_by_force(rows, most=5, every=50):
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        best = {}
        for i, w in fine:
            if i != q and len(w) == len(v):
                best[i] = max(best.get(i, -2.0), cosine(v, w))
        out += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(((-s, i) for i, s in best.items()))[:most])]
    return sorted((q, k, i, -s) for q, k, i, s in out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def alike(ours, theirs):
    assert [x[:3] for x in ours] == [x[:3] for x in theirs]
    assert np.allclose([x[3] for x in ours], [x[3] for x in theirs], rtol=0, atol=1e-12)


def test_nearest_sql(spark):
    ours = found(QUERIES["op11_nearest"](spark, SF))
    c = duckdb.connect()
    c.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    theirs = sorted(c.sql(nearest.SQL).fetchall(), key=lambda r: (r[0], r[1]))
    assert [x[:3] for x in ours] == [(r[0], r[1], r[2]) for r in ((t[0], t[1], t[2]) for t in theirs)]
    assert [x[3] for x in ours] == [t[3] for t in theirs]


def test_nearest_ties_and_hostile_rows(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 8)).round(1)
    rows = [(i, base[i % 40 if i % 3 else 0].tolist()) for i in range(600)]  # a third share one vector, others come in copies
    rows += [(None, [1.0] * 8), (700, None), (750, []), (800, [0.0] * 8), (850, [1.0, None] + [1.0] * 6), (900, [float("nan")] + [1.0] * 7), (950, [float("inf")] + [1.0] * 7)]
    rows += [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (50, base[7].tolist()), (50, base[7].tolist()), (1050, [1e-30] * 8), (1100, [3e38] * 8), (1150, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    expected = nearest_by_force(rows)
    alike(found(nearest.op11(df)), expected)
    monkeypatch.setattr(nearest, "SLICE", 200)  # many slices
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "TILE", 3)
    alike(found(nearest.op11(df)), expected)


def test_nearest_of_few_or_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert nearest.op11(empty).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest.op11(two).collect()] == [(0, 1, 1)]
    assert nearest.op11(two.where("vec_id = 0")).collect() == []


def test_product_tiles_bound_the_cosine():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(50, 64)), r.standard_cauchy(size=(80, 64))
    a, b = nearest.Coded(x), nearest.Coded(y)
    exact = (x / a.norm[:, None]) @ (y / b.norm[:, None]).T
    off = np.abs(a.scale * b.scale * (a.codes @ b.codes.T) - exact)
    assert off.max() <= a.error + (1 + a.error) * b.error + nearest._SLACK and np.abs(a.codes).max() == 127


def runs_by_force(words):
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            s, length = i, j + p - i
            if length >= max(24, 3 * p) and not any(all(words[k] == words[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.append((s, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_by_force(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_force(words)
    gone = {i for s, k, p in found for i in range(s + p, s + k)}
    best = (None,) * 4
    if found:
        s, k, p = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = s, k, p, 1000 * k // p
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def _texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        letters = "ab" if r.random() < 0.4 else [f"w{k}" for k in range(60)]
        words = [r.choice(letters) for _ in range(r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            unit = [r.choice(letters) for _ in range(r.randint(1, 30))]
            at = r.randint(0, len(words))
            words[at:at] = unit * r.randint(2, 6) + unit[: r.randint(0, len(unit))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_brute_force(seed):
    texts = [*_texts(seed), "a " * 300, "", " \n ", "a b " * 100 + "a", " x " * 40, ("x y z " * 20 + "q ") * 4]
    ids = list(range(seed * 1000, seed * 1000 + len(texts)))
    ours = periodic_runs.judge(ids, [t.encode() for t in texts])
    for i, t, row in zip(ids, texts, ours, strict=True):
        assert (i, *row) == periodic_by_force(i, t)


def test_runs_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 4000)
    monkeypatch.setattr(periodic_runs, "PLACES", 100)
    texts = [*_texts(9), None, "", "same line here\n" * 90]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame([(i, t, 0, 7) for i, t in rows], "doc_id long, text string, n_runs int, period int")
    ours = [tuple(r) for r in periodic_runs.op12(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(ours, key=key) == sorted((periodic_by_force(i, t) for i, t in rows), key=key)
    assert periodic_runs.op12(df.limit(0)).collect() == []


def test_runs_of_documents(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    short = {r["doc_id"]: r["text"] for r in t if len(r["text"] or "") < 4000}
    ours = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(ours) == len(t) and all(ours[i] == periodic_by_force(i, x) for i, x in short.items())


def test_one_long_text():
    r = random.Random(3)
    words = [str(r.randint(0, 3000)) for _ in range(60_000)]
    words[1000:1000] = ["x", "y"] * 5000
    words += words[-7000:] * 3
    (row,) = periodic_runs.judge([1], [" ".join(words).encode()])
    assert row[0] == 2 and row[1:4] == (1000, 10_000, 2)


def repaired_by_force(rows):
    """rows: (role, text) in order. All choices of edits, tried one by one."""
    legal = re.compile(r"(s?(ua)+)?")
    marks, seen = [], set()
    for role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        marks.append(fault)
    names = {"u": "user", "a": "assistant"}
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*[["D"] if m in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for m in marks]):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            if sum(map(len, ins)) > 4:
                continue
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for x in ins[k]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((names[x], ""))
                if k < len(rows):
                    c = choice[k]
                    audit += c[0]
                    cost += {"D": 2, "K": 0, "R": 1}[c[0]] + (5 if c != "D" and marks[k] == "truncated" else 0)
                    if c != "D":
                        out.append((rows[k][0] if c == "K" else names[c[1]], rows[k][1]))
            if legal.fullmatch("".join(r[:1] or " " for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    illegal = sum((a[:1] or " ") + (b[:1] or " ") not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(rows))
    return *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def conversations_by_force(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k:
                row = turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
                rows += [row] * (2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *repaired_by_force([r[1:] for r in rows])))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


CONVERSATIONS = "conv_id long, turn long, role string, text string, cost int"


def test_repair_against_all_edits(spark):
    r = random.Random(5)
    table = []
    for conv in range(150):
        for turn in range(r.randint(1, 4)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "cut off", "", " \t", None, "Why?", "Éa. \n", " ", "umpire"])
            table.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    table += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (-5, None, None, None)]
    table += [x for x in table[:10]]
    df = spark.createDataFrame([(*x, 1) for x in table], CONVERSATIONS)
    small = {c for c in {x[0] for x in table} if sum(x[0] == c for x in table) <= 4}
    ours = sorted((tuple(x) for x in conversation_repair.op13(df).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(ours) == len({x[0] for x in table})
    assert [x for x in ours if x[0] in small] == conversations_by_force([x for x in table if x[0] in small])
    assert conversation_repair.op13(df.limit(0)).collect() == []


def test_repair_in_pieces_equals_repair_at_once(monkeypatch):
    """What is let go early is what the whole composition would choose."""
    r = random.Random(6)
    for _ in range(300):
        rows = [(r.choice(["user", "assistant", "assistant", "system", "tool"]), r.choice(["Ay.", "cut", "", "Oh! " + str(r.random())])) for _ in range(r.randint(0, 60))]
        results = []
        for settle in (1, 7, 10**6):
            monkeypatch.setattr(conversation_repair, "SETTLE", settle)
            one, seen = conversation_repair.Repair(), set()
            for k, row in enumerate(rows):
                one.feed(k, *row, row in seen)
                seen.add(row)
            results.append(one.result())
        assert results[0] == results[1] == results[2]


def test_long_conversation_holds_few_rows():
    one = conversation_repair.Repair()
    for k in range(5000):
        one.feed(k, ("assistant", "user")[k % 2] if k % 7 else "system", f"Text {k}." if k % 5 else "cut", False)
        assert len(one.rows) < 3 * conversation_repair.SETTLE


def test_repair_of_the_table(spark):
    import pyarrow.parquet as pq

    table = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    small = {c for c in {x[0] for x in table} if sum(x[0] == c for x in table) <= 3}
    ours = sorted(tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF).collect())
    assert [x[0] for x in ours] == sorted({x[0] for x in table})
    assert [x for x in ours if x[0] in small] == conversations_by_force([x for x in table if x[0] in small])
