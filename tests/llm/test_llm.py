"""The training-data operators against brute force, on small fixtures with hostile rows."""

import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import html_pages
import pii_unseen
from turnwise.llm import common, crf_quality, decontaminate, html_extract, lm_score, mixing, pii, quality_rules, queries, simhash_dedup, substring_dedup, token_files

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(900)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE = prose(70)
TEXTS = [None, "", " \n\t ", "one", prose(60), prose(30) + " " + PASSAGE + " " + prose(40), prose(10) + " " + PASSAGE, "\U0001d54f é ß\n" * 30, "the " * 400, prose(9000), prose(55) + " a.b+c@mail.example.com 10.0.0.255 or 4111 1111 1111 1111 or +1 (509) 555-6973", "x" * 5000 + "@" + "1" * 5000, "<|endoftext|> it's 1.2.3.4.5 ' \x0b\x0c\x1c\x85"]
TEXTS += [TEXTS[5], TEXTS[4], TEXTS[4] + " end"]
ROWS = [(i, t, "en", "s", None, "clash") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_rules(text):
    ws, text = words(text), text or ""
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    cover = {i + k for i in range(len(ws) - 2) for k in range(3) if grams[tuple(ws[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_op2(docs, empty):
    for r in quality_rules.op2(docs).collect():
        n, chars, symbols, dup, repeat = brute_rules(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.op2(docs).where("kept").collect()}
    assert quality_rules.op2(empty).count() == 0
    rows = quality_rules.ledger(docs)
    for r in quality_rules.ablation(rows, quality_rules.STRICT).collect():
        bit = 1 << [n for n, _ in quality_rules.RULES].index(r.rule)
        failed = [x.failed for x in rows.collect()]
        assert (r.n_failed, r.n_only) == (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed))


def test_op2_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as from '{SF}/documents.parquet'")
    name = "op2_quality_rules"
    a, b = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.SQL[name]).df()
    a, b = (x[sorted(x.columns)].sort_values("doc_id").reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def brute_print(text):
    ws = words(lower(text))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    at = {i: i for i in prints}
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and at[a] != at[b]:
            lo, hi = sorted((at[a], at[b]))
            at = {k: lo if v == hi else v for k, v in at.items()}
    return at


def test_op6(docs, empty):
    prints = {i: brute_print(t) for i, t in enumerate(TEXTS)}
    want = brute_components(prints)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_dedup.op6(docs).collect()} == {i: (prints[i], want[i]) for i in prints}
    assert {r.doc_id for r in simhash_dedup.keep(docs).collect()} == set(want.values())
    assert simhash_dedup.op6(empty).count() == 0


def test_links_in_blocks(spark):
    rng, base = np.random.default_rng(5), 0x123456789ABCDEF0
    fps = {base}
    for x in [base, 77]:
        for _ in range(120):
            fps.add(x ^ int(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 6))))))
    fps = [int(np.uint64(x).view(np.int64)) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = {tuple(sorted(v)) for v in _groups(brute_components({i: x & (2**64 - 1) for i, x in enumerate(fps)}))}
    for block in (8, 512):
        edges = simhash_dedup.links(nodes, block)
        assert edges.where("bit_count(a ^ b) > 3").count() == 0
        place = {x: i for i, x in enumerate(fps)}
        got = {i: i for i in range(len(fps))}
        got |= {place[r.id]: r.component for r in common.components(edges).collect()}
        assert {tuple(sorted(v)) for v in _groups(got)} == parts


def _groups(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, []).append(k)
    return out.values()


def test_components_of_a_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 101)], "a long, b long"))
    assert {r.id: r.component for r in common.components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_op7(docs, empty):
    t = Tokenizer.from_file(token_files.tokenizer_path())
    got, start = {r.doc_id: r for r in token_files.op7(docs).collect()}, 0
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.op7(empty).count() == 0


def test_encoder():
    """Words put together give the ids of whole texts, also where a letter changes as it is lower-cased or composed."""
    marks = "aAbBzZ Éé ıİK ß ſ'’.,;:!?-<|>0９ñн\u0331\u0301 hH 中文ツ한\u1112\u01c5ªº\u0378\U0001e900    \x85\n\t"
    texts = ["".join(RNG.choice(marks) for _ in range(RNG.randint(0, 50))) for _ in range(3000)]
    texts += ["<|endoftext|>, a<|STARTOFTEXT|>. <|startoftext|>x", "don't, we're. it's! 'tis", "H\u0331, \u1e96 İ.", prose(2000) + "."]
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path())
    encode = token_files.Encoder(token_files.tokenizer_path())
    assert encode.last is not None
    for lo in range(0, len(texts), 500):
        for text, got in zip(texts[lo : lo + 500], encode([t.encode() for t in texts[lo : lo + 500]]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), (rng.pareto(1, n) * 50).astype(np.int64) % 2**31, np.full(n, 7), rng.integers(0, 2**32, n)):
        blocks, starts = token_files.pack(ids.astype(np.uint32))
        assert (token_files.unpack(blocks, starts)[:n] == ids).all()
        file = token_files.write_file([5, None], [n, 0], ids.astype(np.uint32))
        assert (token_files.read_slice(file, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_op10(docs, empty):
    got = {r.doc_id: r for r in lm_score.op10(docs).collect()}
    tokens = {i: [*words(lower(t)), "\0end"] for i, t in enumerate(TEXTS)}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), total, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.base_score - base) <= 1e-6 * max(1, abs(base)) and r.score < 0
    assert lm_score.op10(empty).count() == 0


def test_mixture_beats_unigram(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = lm_score.op10(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def stands(kind, value):
    d = re.sub("[^0-9]", "", value)
    luhn = sum(int(x) if k % 2 == 0 else 2 * int(x) - 9 * (x > "4") for k, x in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".") if len(p) < 4000), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_op9(spark, docs, empty):
    more = ["a@b.c@d.e", "a@b.cd%x@y.z mail", "+1" + " 2" * 300, "é\U0001d54f a@b.co 1.2.3.4.5 999.1.1.1 001.2.3.4", "..@..@a.b", "4111-1111-1111-1111-9"]
    texts = TEXTS + more
    model = pii.fit(spark, 2000)
    for r in pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        text = texts[r.doc_id] or ""
        for kind, pattern in BASE.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, text) if stands(kind, m.group())]
            assert [(s.start, s.end) for s in r[f"base_{kind}"]] == want
            assert all(e <= s.start or s.end <= b for s in r[f"more_{kind}"] for b, e in want)
    r = pii.op9(docs.where("doc_id = 10")).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256
    assert pii.spans(empty, model).count() == 0


def test_op3(spark):
    model, rng = html_extract.fit(), random.Random(77)
    pages = [html_pages.written_page(rng) for _ in range(60)]
    for page, got in zip(pages, html_extract.extract(pages, model), strict=True):
        leaves = (html_extract.text_of(n) for n in html_extract.nodes_of(html_extract.parse(page)) if n.tag == "#")
        assert got == " ".join(t for t in leaves if re.search(r"\bq", t))
    rows = [(0, "u", None), (1, "u", ""), (2, None, "<article><p>a&amp;b\n c<p>d</article"), (3, "u", "<nav>x</nav>" + "<div>" * 3000 + "<p>deep text here.</p>")]
    got = {r.page_id: r for r in html_extract.op3(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[0].text, got[0].n_chars, got[1].text, got[2].text) == ("", 0, "", "a&b c d")
    page = spark.read.parquet(f"{SF}/pages.parquet").first()
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", "\0", re.search(r"<article>(.*?)</article>", page.html, re.S).group(1).replace("<br>", " ")))
    want = " ".join(filter(None, (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in inner.split("\0"))))
    assert html_extract.extract([page.html], model) == [want]


def test_op4(spark, docs, empty):
    items = [(1, PASSAGE.upper()), (2, prose(20)), (3, None), (4, "..."), (5, "one"), (6, " ".join(PASSAGE.split()[:35]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def toks(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    def bag(ws, k):
        return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))

    want = {}
    for (d, text), (item, t) in itertools.product(enumerate(TEXTS), items):
        a, b = toks(text), toks(t)
        if not a or not b or len(a) > 5000:
            continue
        n, k = min(len(b), len(a)), min(5, len(b))
        for i in range(len(a) - n + 1):
            x, y = bag(a[i : i + n], k), bag(b, k)
            s = sum((x & y).values()) / sum((x | y).values()) if x or y else 0
            if s >= 0.8:
                want[d, item] = max(s, want.get((d, item), 0))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(docs, benchmark).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()} and (5, 1) in got and (3, 5) in got
    kept = decontaminate.keep(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(TEXTS))) - {d for d, _ in want}
    assert decontaminate.find(empty, benchmark).count() == 0 and decontaminate.find(docs, benchmark.limit(0)).count() == 0


def test_op5(spark, docs):
    real, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = mixing.op5(real, labels).toPandas()
    assert (rows.rate >= 0).all() and len(rows) == real.count()
    model, known = mixing.fit(real, mixing.labelled(labels), mixing.DOMAINS), mixing.labelled(labels).toPandas()
    weights = {"good": 0.8, "low": 0.15, "toxic": 0.05}  # within reach of what 87 labels teach
    met = mixing.rates(real, model, weights).toPandas()
    share = (np.stack(met.p).T * (met.n * met.rate).to_numpy()).sum(1)
    assert np.allclose(share / met.n.sum(), list(weights.values()), atol=2e-3)
    far = [np.linalg.norm((np.stack(x.p).T * (x.n * x.rate).to_numpy()).sum(1) / x.n.sum() - [0.5, 0.1, 0.4]) for x in (met.assign(rate=1.0), mixing.rates(real, model, {"good": 0.5, "low": 0.1, "toxic": 0.4}).toPandas())]
    assert far[1] < far[0]
    rows = mixing.op5(docs, labels.limit(0)).collect()
    assert len(rows) == len(TEXTS) and all(abs(r.p_good - 1 / 3) < 1e-9 for r in rows)
    kept = mixing.keep(real, model, {"good": 1.0})
    by = {(r.doc_id) for r in kept.select("doc_id").collect()}
    assert kept.columns == real.columns and known[known.domain == "good"].doc_id.isin(by).mean() > 0.97 and known[known.domain == "toxic"].doc_id.isin(by).mean() < 0.2


def test_op8(spark, docs, empty):
    real, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = crf_quality.op8(real, labels).join(labels, "doc_id").toPandas()
    assert ((rows.predicted == rows.quality)[rows.held_out]).mean() > 0.95 and rows.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows.itertuples())
    assert crf_quality.op8(docs, labels).count() == len(TEXTS) and crf_quality.op8(empty, labels).count() == 0


def test_marginals():
    rng = np.random.default_rng(0)
    scores, turn = [rng.normal(size=n) for n in (1, 4, 3)], rng.normal(size=(2, 2))
    got, pairs = crf_quality.marginals(scores, turn)
    want_pairs = np.zeros((2, 2))
    for s, g in zip(scores, got, strict=True):
        paths = {y: math.exp(sum(s[i] * y[i] for i in range(len(s))) + sum(turn[y[i], y[i + 1]] for i in range(len(s) - 1))) for y in itertools.product((0, 1), repeat=len(s))}
        z = sum(paths.values())
        assert np.allclose(g, [sum(p for y, p in paths.items() if y[i]) / z for i in range(len(s))])
        for y, p in paths.items():
            for i in range(len(s) - 1):
                want_pairs[y[i], y[i + 1]] += p / z
    assert np.allclose(pairs, want_pairs)


def test_compact_windows():
    rng = np.random.default_rng(0)
    for least in (1, 2, 5, 7):
        sizes = rng.integers(0, 60, 4)
        s, first = rng.integers(0, 50, sizes.sum()).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
        salt = substring_dedup._SALTS[0]
        key = [(int(v) & ~int(substring_dedup._PLACE)) | i for i, v in enumerate(common.mix(s ^ salt))]
        want = set()

        def split(d, lo, hi):
            if hi - lo + 1 >= least:
                c = min(range(lo, hi + 1), key=key.__getitem__)
                want.add((d, lo - first[d], c - first[d], hi - first[d]))
                split(d, lo, c - 1)
                split(d, c + 1, hi)

        for d in range(4):
            split(d, int(first[d]), int(first[d + 1]) - 1)
        text, _, l, c, r = substring_dedup.compact_windows(s, first, salt, least)
        assert set(zip(text.tolist(), l.tolist(), c.tolist(), r.tolist(), strict=True)) == want


def test_op1(spark, docs, empty):
    rows = substring_dedup.op1(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.passage_id, set()).add(r.doc_id)
    assert any({5, 6, 13} <= v for v in by.values()) and any({4, 14, 15} <= v for v in by.values())
    assert {r.doc_id for r in rows} == {4, 5, 6, 13, 14, 15}
    assert substring_dedup.op1(empty).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    seen, partners = {}, set()
    for r in real.collect():
        w = lower(r.text).split()
        if len(set(w)) > 40:
            for i in range(len(w) - 50):
                d = seen.setdefault(tuple(w[i : i + 51]), r.doc_id)
                if d != r.doc_id:
                    partners |= {(d, r.doc_id)}
    of = {}
    for r in substring_dedup.op1(real).collect():
        of.setdefault(r.doc_id, set()).add(r.passage_id)
    assert all(of.get(a, set()) & of.get(b, set()) for a, b in partners)


def test_op9_email_in_plain_prose(spark):
    """With a model that takes every proposal: neither a digit nor @ is needed for an obfuscated address."""
    df = spark.createDataFrame([(0, "please write to jane (at) example (dot) com soon"), (1, "or to jane [at] example [dot] com"), (2, "met at (noon) today")], "doc_id long, text string")
    took = {r.doc_id: len(r.more_email) for r in pii.spans(df, {"sql": "1.0D", "limits": dict.fromkeys(pii.KINDS, 0.5)}).collect()}
    assert took == {0: 1, 1: 1, 2: 0}


def _op1_passages(spark, texts):
    rows = substring_dedup.op1(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, set()).add(r.passage_id)
    return of


def test_op1_bystanders(spark):
    """Each value that two documents with a common passage share also stands in an earlier document without the passage."""
    rng = random.Random(9)
    some = lambda n: [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]
    passage, early = some(50), []
    late = [some(40) + passage + some(40) for _ in range(2)]
    found = lambda text, salt: [x.tolist() for x in substring_dedup.compact_windows(*substring_dedup._sequences(pa.array([" ".join(text)])), salt)]
    for salt in substring_dedup._SALTS[: substring_dedup.HASHES]:
        _, v, _, c, _ = found(late[0], salt)
        for value in set(v) & set(found(late[1], salt)[1]):
            at = c[v.index(value)]
            text = next(x for _ in range(10000) if value in found(x := some(45) + late[0][at : at + 5] + some(45), salt)[1])
            early.append(text)
    texts = [" ".join(x) for x in early + late]
    of = _op1_passages(spark, texts)
    assert len(early) >= 4 and set(of) == {len(early), len(early) + 1} and of[len(early)] & of[len(early) + 1]


def test_op1_recall(spark):
    """Passages of 50 words of which one is changed: 41 of 51 shingles in common, just within the contract's 0.8."""
    rng = random.Random(10)
    some = lambda n: [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]
    texts = []
    for _ in range(400):
        p = some(50)
        q = [*p]
        q[rng.randrange(5, 45)] += "x"
        texts += [" ".join(some(30) + p + some(30)), " ".join(some(30) + q + some(30))]
    want = [k for k in range(0, len(texts), 2) if substring_dedup.shared(*(substring_dedup._sequences(pa.array([t]))[0] for t in (texts[k + 1], texts[k])))]
    of = _op1_passages(spark, texts)
    got = sum(bool(of.get(k, set()) & of.get(k + 1, set())) for k in want)
    assert len(want) == 400 and got >= 0.995 * len(want), (got, len(want))


def test_shared_with_a_gap():
    a = np.arange(100, dtype=np.uint64)
    b = np.concatenate([np.arange(500, 520), np.arange(0, 50), np.arange(900, 905), np.arange(55, 100)]).astype(np.uint64)
    (found,) = substring_dedup.shared(a, b)
    assert found[:4] == (0, 100, 20, 120) and found[4] > 0.8


def test_shared_takes_every_place():
    p, q = np.arange(100, 160, dtype=np.uint64), np.arange(200, 270, dtype=np.uint64)
    apart = lambda k: np.arange(k * 1000, k * 1000 + 40, dtype=np.uint64)
    spans = lambda a, b: {x[:4] for x in substring_dedup.shared(np.concatenate(a), np.concatenate(b))}
    assert spans([p, q], [apart(1), p, apart(2), q]) == {(0, 60, 40, 100), (60, 130, 140, 210)}
    assert spans([apart(1), p, apart(2), q], [p, q]) == {(40, 100, 0, 60), (140, 210, 60, 130)}
    assert spans([p], [p, apart(1), p]) == {(0, 60, 0, 60), (0, 60, 100, 160)}
    assert spans([p], [apart(1), p, p]) == {(0, 60, 40, 100), (0, 60, 100, 160)}
    assert spans([p, p], [apart(1), p]) == {(0, 60, 40, 100), (60, 120, 40, 100)}
    assert spans([q, p], [p, q]) == {(0, 130, 0, 130)}


def test_words():
    texts = pa.array(["a bb", "", "  c\x0b", "bb"])
    w = common.Words(texts)
    h = w.hashes()
    assert w.first.tolist() == [0, 2, 2, 3, 4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ours = corpus_pipeline.run(spark, SF)
    assert sorted(ours.collect()) == sorted(docs.collect()) and ours.count() > 50


def _near(prints):
    """Texts whose fingerprints are the given ones can't be written; op6's grouping is tested on fingerprints themselves."""
    return [int(np.uint64(x).view(np.int64)) for x in prints]


def test_op6_null_ids_carry_links(spark, tmp_path):
    """1, null and 2 in a chain of steps of 3 bits are one component; of null ids alone the component is null."""
    base = 0x0123456789ABCDEF
    rows = list(zip([1, None, 2, None, None, 9], _near([base, base ^ 0b111, base ^ 0b111111, ~base & (2**64 - 1), ~base & (2**64 - 1), 0xFF00FF00FF00FF00]), strict=True))
    spark.createDataFrame(rows, "doc_id long, fp long").write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    found = {r.fp: r.least for r in simhash_dedup.groups(prints, F.col("doc_id")).collect()}
    assert [found[fp] for _, fp in rows] == [1, 1, 1, None, None, 9]


def test_op6_keep_judges_rows(spark):
    texts = [prose(60), prose(60), prose(60)]
    rows = [(None, texts[0], "a"), (None, texts[0], "a"), (5, texts[1], "a"), (5, texts[1], "a"), (3, texts[1], "b"), (None, texts[1], "c"), (7, texts[2], "x"), (7, texts[2], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    kept = sorted(((r.doc_id, r.text) for r in simhash_dedup.keep(df).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (3, texts[1]), (7, texts[2])], key=repr) and simhash_dedup.keep(df).columns == df.columns
    got = {(r.doc_id, r.component_id) for r in simhash_dedup.op6(df).collect()}
    assert got == {(None, None), (5, 3), (3, 3), (None, 3), (7, 7)}
    assert simhash_dedup.keep(df.limit(0)).count() == 0


def _reworded(rng, item):
    """A window that shares 0.89 of an item's shingles: 0.8 of the union or little more."""
    window, changed = item.copy(), int(len(item) * 0.11)
    window[rng.choice(len(item), changed, replace=False)] = rng.integers(0, 2**63, changed, dtype=np.uint64)
    return window


def test_op4_recall_of_the_radius():
    """Of items and windows whose similarity is 0.8 to 0.86, 99 % lie within the radius, and all of these are found through the blocks."""
    rng, hit, total = np.random.default_rng(3), 0, 0
    for n in (12, 20, 40, 80, 200):
        items = [rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(400)]
        windows = [_reworded(rng, x) for x in items]
        assert all(0.8 <= decontaminate.similarity(Counter(x.tolist()), Counter(y.tolist())) < 0.87 for x, y in zip(items, windows, strict=True))
        a, b = (np.concatenate([decontaminate.simhash(x, np.array([0]), n) for x in xs]) for xs in (items, windows))
        far = np.bitwise_count(a ^ b).sum(1)
        found = [set(zip(*(c.tolist() for c in decontaminate.Index.candidates({"prints": a, "lists": lists}, b)[:2]), strict=True)) for lists in (None, decontaminate.posting_lists(a))]
        assert found[0] == found[1] == {(w, i) for w in range(400) for i in np.flatnonzero(np.bitwise_count(a ^ b[w]).sum(1) <= decontaminate.RADIUS).tolist()}
        total, hit = total + 400, hit + sum((k, k) in found[1] for k in range(400))
        assert ((far <= decontaminate.RADIUS) == [(k, k) in found[1] for k in range(400)]).all()
    assert hit >= 0.99 * total and sum(r + 1 for r in decontaminate.REACH) == decontaminate.RADIUS + 1, (hit, total)


@pytest.mark.parametrize("n", [1000, 10_000])
def test_op4_prunes_among_many_items(n):
    """Unrelated windows against n items of one length: few are compared by their shingles, and posting lists read one item in seven."""
    rng = np.random.default_rng(n)
    items, windows = (rng.integers(0, 2**64, (k, 2), dtype=np.uint64) for k in (n, 2000))
    windows[:200] = items[:200] ^ np.uint64(0x10100F0)
    size = {"prints": items, "lists": decontaminate.posting_lists(items)}
    win, item, _ = decontaminate.Index.candidates(size, windows)
    assert {(w, i) for w, i in zip(win.tolist(), item.tolist(), strict=True)} >= {(k, k) for k in range(200)}
    assert len(set(win[win >= 200].tolist())) < 0.01 * 1800
    read = len(decontaminate.looked_up(size["lists"], windows[200:400], n)[0]) / (200 * n)
    assert read < 1 / 6, read


def test_op4_items_of_one_length_through_the_lists(spark, monkeypatch):
    """Many items of one length that share their first words: the same matches with and without posting lists."""
    rng = random.Random(6)
    head = [rng.choice(VOCAB) for _ in range(6)]
    items = [(k, " ".join(head + [rng.choice(VOCAB) for _ in range(24)])) for k in range(300)]
    texts = [" ".join([rng.choice(VOCAB) for _ in range(40)] + items[k][1].split() + [rng.choice(VOCAB)]) for k in range(0, 300, 10)] + [" ".join(head + [rng.choice(VOCAB) for _ in range(60)]) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for most in (10**9, 1):
        index = (monkeypatch.setattr(decontaminate, "LONG", most), decontaminate.Index(items))[1]
        assert (index.sizes[30]["lists"] is None) == (most > 1)
        found.append(sorted(index.matches(pa.array(texts))))
    assert found[0] == found[1] and {(d, i) for d, i, *_ in found[0]} == {(d, 10 * d) for d in range(30)}
    monkeypatch.undo()
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, benchmark).collect()} == {(d, 10 * d) for d in range(30)}


def test_op1_families(spark):
    """Families of six documents whose passage of 70 words has 0 to 2 words changed: of the pairs that shared() verifies, 98 % end in one passage."""
    rng = random.Random(12)
    some = lambda n: [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n)]
    texts = []
    for _ in range(40):
        p = some(70)
        for _ in range(6):
            q = [*p]
            for at in rng.sample(range(70), rng.randrange(3)):
                q[at] += "x"
            texts.append(" ".join(some(40) + q + some(40)))
    own = [substring_dedup._sequences(pa.array([t]))[0] for t in texts]
    want = [(6 * f + i, 6 * f + j) for f in range(40) for i, j in itertools.combinations(range(6), 2) if substring_dedup.shared(own[6 * f + j], own[6 * f + i])]
    of = _op1_passages(spark, texts)
    got = sum(bool(of.get(i, set()) & of.get(j, set())) for i, j in want)
    assert len(want) > 300 and got >= 0.98 * len(want), (got, len(want))


def test_op1_hostile_rows(spark):
    """Null ids are left out, repeated rows count once, and a doc_id with two texts has the passages of both."""
    p, q = prose(60), prose(70)
    rows = [(1, p), (1, p), (1, "a " * 30 + q), (2, prose(20) + " " + q), (3, p), (None, p), (None, q), (4, None), (5, q)]
    found = substring_dedup.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in found:
        by.setdefault(r.passage_id, set()).add(r.doc_id)
    assert {1, 3} in by.values() and {1, 2, 5} in by.values() and {r.doc_id for r in found} == {1, 2, 3, 5}


def test_op10_score_by_brute_force(spark):
    """Counts, the deleted fold's histogram and the mixed probabilities, token by token; null and repeated ids included."""
    rng = random.Random(6)
    common = VOCAB[:40]
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(0, 60))) for _ in range(48)] + [None, "Zz zz"]
    ids = [*range(47), None, 3, 50]
    tokens = [[*words(lower(t)), "\0end"] for t in texts]
    rest = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i in ids]
    pairs = [list(zip(["\0end", *ws[:-1]], ws, strict=True)) for ws in tokens]
    one, two = Counter(), Counter()
    fold_one, fold_two = Counter(), Counter()
    for r, ws, ps in zip(rest, tokens, pairs, strict=True):
        if r != 0:
            one.update(ws)
            two.update(ps)
        if r == 1:
            fold_one.update(ws)
            fold_two.update(ps)
    total, v, fold_total = sum(one.values()), len(one), sum(fold_one.values())

    def parts(a, b, c1, c2, n):
        context = c1[a]
        return int(math.log2(context + 1)), c2[a, b] / context * (v + 1) if context else 0.0, c1[b] / n * (v + 1)

    kept_one, kept_two = one - fold_one, two - fold_two
    events = [parts(a, b, kept_one, kept_two, total - fold_total) for r, ps in zip(rest, pairs, strict=True) if r == 1 for a, b in ps]
    level = lambda x: int(min(max(math.log2(x) * lm_score.STEPS + lm_score.LEVELS / 4, 0), lm_score.LEVELS)) if x > 0 else -1
    cells = {}
    for b, x2, x1 in events:
        cell = cells.setdefault((b, level(x2), level(x1)), [0, 0.0, 0.0])
        cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + x2, cell[2] + x1
    import pandas as pd

    mixture = lm_score.weights(pd.DataFrame([(b, k2, k1, *c) for (b, k2, k1), c in cells.items()], columns=["b", "k2", "k1", "n", "x2", "x1"]))
    exact = {}  # expectation-maximisation on the events themselves
    for b in {e[0] for e in events}:
        l = [1 / 3] * 3
        own = [(x2, x1, 1.0) for k, x2, x1 in events if k == b]
        for _ in range(lm_score.ROUNDS):
            shares = [[w * y / sum(u * z for u, z in zip(l, x, strict=True)) for w, y in zip(l, x, strict=True)] for x in own]
            l = [sum(s[k] for s in shares) / len(own) for k in range(3)]
        exact[b] = l
    assert all(np.abs(mixture[b] - exact[b]).max() < 0.03 for b in exact)
    want = []
    for i, ws, ps in zip(ids, tokens, pairs, strict=True):
        found = [parts(a, b, one, two, total) for a, b in ps]
        want.append((-1 if i is None else i, len(ws), round(sum(math.log10((mixture[k] @ [x2, x1, 1.0]) / (v + 1)) for k, x2, x1 in found), 6)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 6)) for r in lm_score.op10(df).collect()]
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_quality_ablations(spark, docs, empty):
    c = duckdb.connect()
    c.sql(f"create view documents as from '{SF}/documents.parquet'")
    a, b = queries.QUERIES["quality_ablations"](spark, SF).toPandas(), c.sql(queries.SQL["quality_ablations"]).df()
    key = ["policy", "version", "rule"]
    a, b = (x[sorted(x.columns)].sort_values(key).reset_index(drop=True) for x in (a, b))
    assert len(a) > 2 and (a.to_numpy() == b.to_numpy()).all()
    kept = {(r.policy, r.n_kept) for r in quality_rules.ablations(docs).collect()}
    assert kept == {(p.name, quality_rules.ledger(docs).where(quality_rules.passes(p)).count()) for p in quality_rules.POLICIES}
    assert quality_rules.ablations(empty).count() == 0


@pytest.mark.parametrize("most", [None, 1.0])
def test_op5_solver_against_least_squares(spark, tmp_path, most):
    """Against coordinate descent, which is exact in the limit; targets within reach and out of it."""
    rng = np.random.default_rng(9)
    for k, weights in enumerate(([0.5, 0.3, 0.2], [0.2, 0.1, 0.7], [0.9, 0.1, 0.0])):
        n, p = rng.integers(1, 200, 30).astype(float), rng.dirichlet([1.0, 1.0, 0.5], 30)
        spark.createDataFrame([(float(x), y.tolist()) for x, y in zip(n, p, strict=True)], "n double, p array<double>").write.parquet(str(tmp_path / str(k)))
        members = spark.read.parquet(str(tmp_path / str(k)))
        target = np.array(weights) * n.sum() * (0.5 if most else 1.0)
        a, r = (p * n[:, None]).T, np.ones(30)
        for _ in range(4000):
            for i in range(30):
                r[i] = np.clip(r[i] - a[:, i] @ (a @ r - target) / (a[:, i] @ a[:, i]), 0, most)
        exact = np.linalg.norm(a @ r - target) / target.sum()
        steps = mixing.solve(members, target, most)
        got = members.withColumn("rate", mixing._rate(steps, most)).toPandas()
        assert (got.rate >= 0).all() and (most is None or (got.rate <= most).all())
        far = np.linalg.norm((np.stack(got.p).T * (got.n * got.rate).to_numpy()).sum(1) - target) / target.sum()
        assert far <= exact + 2e-3, (weights, far, exact)


def test_op5_and_keep_hostile_rows(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = mixing.fit(docs, mixing.labelled(labels), mixing.DOMAINS)
    twice = docs.union(docs).withColumn("doc_id", F.expr("nullif(doc_id, 3)")).withColumnsRenamed({"fp": "n", "n_chars": "p"})
    kept = mixing.keep(twice, model, {"good": 1.0})
    assert kept.columns == twice.columns and all(v == 2 for v in Counter((r.doc_id, r.text) for r in kept.collect()).values())
    assert mixing.op5(empty, labels).count() == 0 and mixing.keep(empty, model, {"good": 1.0}).count() == 0


def test_op5_trains_on_a_text_an_id(spark):
    """Repeated rows of an id neither weigh more nor reach the driver; of several texts the shortest counts."""
    real, labels = spark.read.parquet(f"{SF}/documents.parquet"), mixing.labelled(spark.read.parquet(f"{SF}/labels.parquet"))
    longer = real.withColumn("text", F.concat("text", F.lit(" toxic words that no one is to learn")))
    once, often = (mixing.fit(x, labels, mixing.DOMAINS) for x in (real, real.union(longer).union(real)))
    assert len(once.words) and np.array_equal(once.slot, often.slot) and np.array_equal(once.words, often.words) and np.array_equal(once.dense, often.dense)


def test_op9_trees_as_sql(spark):
    """The SQL of the trees gives what MLlib's own model predicts."""
    from pyspark.ml.functions import array_to_vector

    model, rng = pii.model(spark), np.random.default_rng(2)
    rows = [([float(v) for v in rng.integers(-2, 24, pii.N_FEATURES)],) for _ in range(400)]
    x = spark.createDataFrame(rows, "x array<double>").withColumn("features", array_to_vector("x"))
    both = model["mllib"].transform(x).select("prediction", F.expr(model["sql"]).alias("s")).collect()
    assert all(r.prediction == float(r.s > 0) for r in both) and len({r.prediction for r in both}) == 2


#: Written by hand, in other words than the snippets': text and the spans a reader would add to the base ones.
OTHER_TEXTS = [
    ("Please send it to maria.lopez (at) example (dot) org before noon.", ["maria.lopez (at) example (dot) org"]), ("You can email jo_smith [at] mail.net if unsure", ["jo_smith [at] mail.net"]),
    ("Her number, (212) 555-0187, was on the door", ["(212) 555-0187"]), ("Phone 415-555-0132 after six", ["415-555-0132"]), ("call 0044 207 946018 today", ["0044 207 946018"]),
    ("She paid by card 4111.1111.1111.1111 yesterday", ["4111.1111.1111.1111"]),
    ("The meeting of 2024-03-15 1030 was moved", []), ("Order no. 8812345678 shipped", []), ("We met at (the) station", []), ("version 10.300.21.7 of the tool", []),
    ("total 123456789 items", []), ("a total of 12 345 678 901 234 567 89 units", []), ("see pages 10-12, 14-18 and 20", []), ("ISBN 9780306406157 is sold out", []),
]


def _added(spark, texts):
    """Spans added rightly, all added, and all wanted."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    right = added = wanted = 0
    for r in pii.spans(df, pii.model(spark)).collect():
        text, want = texts[r.doc_id]
        got = [text[s.start : s.end] for k in pii.KINDS for s in r[f"more_{k}"]]
        right, added, wanted = right + len(set(got) & set(want)), added + len(got), wanted + len(want)
    print("added spans:", right, added, wanted)
    return right, added, wanted


def test_op9_added_spans(spark):
    """Precision and recall of what the method adds, on texts by another writer than the training's."""
    right, added, wanted = _added(spark, OTHER_TEXTS)
    assert right >= 0.6 * wanted and right >= 0.6 * added, (right, added, wanted)


def test_op9_unseen_spans(spark):
    """On texts read once, before any change that had them in view: 14 of 19 spans found, 5 wrong. TEXTS were read earlier (7 of 18 and 1
    wrong for the model of that time) and seen by who wrote the present one. The bars were set after the readings and keep them from getting worse."""
    right, added, wanted = _added(spark, pii_unseen.LATER)
    assert right >= 14 and added - right <= 5 and wanted == 19, (right, added, wanted)
    right, added, wanted = _added(spark, pii_unseen.TEXTS)
    assert right >= 17 and added - right <= 1 and wanted == 18, (right, added, wanted)


def _resolved(text):
    """All spans of a model that takes every proposal at one score, in plain Python."""
    found = {}
    for kind in pii.KINDS:
        base = [m for m in re.finditer(pii.BASE[kind].replace(r"(?:\G|", "(?:").replace("[A-Za-z0-9._%+-]++@", "[A-Za-z0-9._%+-]+@"), text)]
        if kind == "ip":
            base = [m for m in base if all(int(x) <= 255 for x in m.group().split("."))]
        if kind in ("card", "phone"):
            digits = lambda m: re.sub("[^0-9]", "", m.group())
            base = [m for m in base if (16 <= len(digits(m)) <= 19 and sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits(m)))) % 10 == 0 if kind == "card" else 8 <= len(digits(m)) <= 15)]
        found[kind] = [m.span() for m in base]
    taken = sorted(x for v in found.values() for x in v)
    tried = {(m.start(), m.end(), i) for i, kind in enumerate(pii.KINDS) for p in pii.PROPOSALS[kind] for m in regex.finditer(p, text)}
    free = [c for c in tried if not any(b[0] < c[1] and c[0] < b[1] for b in taken)]
    rank = lambda c: (c[2], c[0] - c[1], c[0])
    more = [c for c in free if not any(rank(d) < rank(c) and d[0] < c[1] and c[0] < d[1] for d in free)]
    return {k: (found[k], sorted(c[:2] for c in more if c[2] == i)) for i, k in enumerate(pii.KINDS)}


def test_op9_spans_of_dense_texts(spark):
    """Base spans, proposals and their conflicts against plain Python, in texts full of them."""
    rng, texts = random.Random(12), ["", "x"]
    parts = ["ann@a.com", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6", "4111 1111 1111 1111", "4111111111111112", "+1 (509) 555-6973", "0049 221 123456", "joe (at) b [dot] org", "kim at b dot org", "1[.]2[.]3.4", "fe80::1:2", "1:2:3:4:5:6:7:8", "4111-1111-1111-1112", "3782 822463 10006", "212 555 0187 x44", "im", ", ", " ", ".", "-", "1", "a@", "(555) 123-4567", "é", "\U0001d54f", "\n", "12-34-56-78-90-12-34"]
    texts += ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans(df, {"sql": "1.0D", "limits": dict.fromkeys(pii.KINDS, 0.5)}).collect():
        for kind, (base, more) in _resolved(texts[r.doc_id]).items():
            assert [tuple(x) for x in r[f"base_{kind}"]] == base, (kind, texts[r.doc_id])
            assert sorted(tuple(x) for x in r[f"more_{kind}"]) == more, (kind, texts[r.doc_id])


def test_op9_time_grows_with_the_matches(spark):
    """100,000 addresses in one text, and as many that are only proposed beside three other kinds."""
    plain = "".join(f"user{k}@mail{k % 7}.example.com, " for k in range(100_000))
    hidden = "".join(f"user{k} (at) mail{k % 7} (dot) com, 10.{k % 256}.3.4 and 0049 221 {k + 100000} " for k in range(20_000))
    df = spark.createDataFrame([(1, plain), (2, hidden)], "doc_id long, text string").repartition(2)
    began = time.time()
    sizes = {r[0]: r[1:] for r in pii.spans(df, {"sql": "1.0D", "limits": dict.fromkeys(pii.KINDS, 0.5)}).select("doc_id", *(F.size(f"{w}_{k}") for k in ("email", "ip") for w in ("base", "more"))).collect()}
    assert sizes == {1: (100_000, 0, 0, 0), 2: (0, 20_000, 20_000, 0)} and time.time() - began < 90


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_op9_running_folds(spark, n):
    rows = [random.Random(n).randint(-5, 50) for _ in range(n)]
    df = spark.createDataFrame([(rows,)], "v array<int>")
    sums, tops = df.select(pii.running(F.col("v"), lambda a, x: a + x), pii.running(F.col("v"), F.greatest)).first()
    assert sums == list(itertools.accumulate(rows)) and tops == list(itertools.accumulate([max(0, x) for x in rows], max))
