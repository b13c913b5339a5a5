"""Rows that break things: null and repeated ids, null and empty texts, very long ones, clashing columns, empty tables; by operator and through the pipeline."""

import random
from collections import Counter

import pytest
from conftest import SF

import corpus_pipeline
from turnwise.llm import decontaminate, pii, quality_rules, token_files

RNG = random.Random(77)
VOCAB = ["".join(RNG.choice("abcdefghijklm") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]
PROSE = [" ".join(RNG.choice(VOCAB) for _ in range(n)) for n in (80, 120, 200, 90)]
#: Columns named like those that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, t string, h long, hit boolean, spans string, start long, fp long, n_words int"
REST = ("en", "web", 3, True, "r", "t", 7, False, "s", 9, 1, 2)
TEXTS = [(1, PROSE[0]), (1, PROSE[1]), (2, PROSE[1]), (2, PROSE[1]), (None, PROSE[2]), (None, PROSE[2]), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, " ".join([PROSE[3]] * 400)), (7, "a@b.co, " * 50 + PROSE[3]), (-(2**63) + 1, "𝕏 é\x00 " * 60)]
ITEMS = [(1, " ".join(PROSE[0].split()[10:40])), (None, " ".join(PROSE[2].split()[5:45])), (3, None), (4, ""), (1, " ".join(PROSE[0].split()[10:40]))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *REST) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


ALL = Counter(i for i, _ in TEXTS)


def test_rules(docs):
    assert ids(quality_rules.op2(docs)) == ALL and quality_rules.keep(docs).columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in quality_rules.keep(docs).collect())
    want = Counter((r.doc_id, r.n_words) for r in quality_rules.op2(docs).where("kept").collect())
    assert Counter((i, len((t or "").split())) for (i, t), n in kept.items() for _ in range(n)) == want
    assert quality_rules.keep(docs.limit(0)).collect() == []


def test_benchmark(docs, items):
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect())
    assert found == {(1, 1): 2, (None, None): 2}  # the item that stands twice counts twice, the row that stands twice too
    kept = decontaminate.keep(docs, items)
    assert kept.columns == docs.columns and ids(kept) == ALL - Counter({1: 1, None: 2})
    assert ids(decontaminate.keep(docs, items.limit(0))) == ALL and decontaminate.keep(docs.limit(0), items).collect() == []


def test_tokens(docs):
    rows = sorted(token_files.op7(docs).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in rows) == ALL and [r.doc_id for r in rows][:3] == [None] * 3 and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert Counter(r.n_tokens for r in rows)[1] >= 3 and token_files.op7(docs.limit(0)).collect() == []


def test_personal_data(docs):
    rows = pii.op9(docs).collect()
    assert Counter(r.doc_id for r in rows) == ALL and {r.doc_id: r.n_email for r in rows}[7] == 50
    assert all(r.spans == "" and r.n_email == r.n_ip == r.n_card == r.n_phone == 0 for r in rows if r.doc_id in (3, 4, 5)) and pii.op9(docs.limit(0)).collect() == []


def _folder(spark, tmp_path, docs, items):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline(spark, tmp_path, docs, items):
    """Each stage on hostile rows; what a stage drops, later ones don't see, and columns stay those of documents."""
    d = _folder(spark, tmp_path, docs, items)
    rows, kept = docs, ALL
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, d)
        if name == "token_output":
            assert ids(out) == kept and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            break
        assert out.columns == docs.columns, name
        assert ids(out) <= kept, name
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        kept = ids(rows)
        if name == "simhash_dedup":
            assert kept[None] == 1 and kept[2] <= 1  # repeated rows and copies have one survivor
        if name == "decontamination":
            assert not {r.text for r in rows.collect()} & {PROSE[0], PROSE[2]}


def test_pipeline_of_no_documents(spark, tmp_path, docs, items):
    d = _folder(spark, tmp_path, docs.limit(0), items)
    assert corpus_pipeline.run(spark, d).collect() == []
