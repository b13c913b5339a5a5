"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps its measurements and one failure bit a rule. A policy is a versioned
mask over those bits, so trying another policy, or counting what a rule alone removes, reads the ledger only.

Null text counts as empty (all measurements 0, the word-count rule fails). Extra columns are ignored. Repeated rows
give repeated ledger rows; a null doc_id stays null. An empty table gives an empty ledger."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnwise.llm.common import SPACES, durable, whole_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
SCHEMA = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
#: name and failure condition; the place in this list is the bit.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("repeated_lines", "n_lines >= 5 and 100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "n_letters >= 20 and 100 * n_upper > 60 * n_letters"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_NOT_LETTER = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122))
_NOT_FIRST = bytes(x for x in range(256) if not 0x80 <= x < 0xC0)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, (name, _) in enumerate(RULES) if name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(name for name, _ in RULES))


def _covered(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    two = a[:-1] * len(ids) + a[1:]
    if len(ids) > 2_000_000:  # three ids no longer fit 63 bits
        two = np.unique(two, return_inverse=True)[1]
    three = two[:-1] * len(ids) + a[2:]
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    again = np.zeros(len(three), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(a), bool)
    for k in range(3):
        cover[k : k + len(again)] |= again
    return int(cover.sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of one text."""
    b = text.encode()
    words, packed = b.split(), b.translate(None, SPACES)
    lines = [x for x in b.split(b"\n") if x.strip()]
    letters = b.translate(None, _NOT_LETTER)
    return (
        len(words), len(packed) - len(packed.translate(None, _NOT_FIRST)), len(b) - len(b.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), _covered(words), len(lines), len(letters) - len(letters.translate(None, _UPPER)), len(letters),
    )


def _measured(batches):
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])


def failures() -> Column:
    """The failure bits of a measured row."""
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the failed rules. One pass, no shuffle."""
    return whole_text(docs).mapInArrow(_measured, SCHEMA).withColumn("failed", failures())


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once; policies and ablations read it and never the texts again."""
    return durable(ledger(docs), "ledger")


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def ablation(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and those that only it rejects (kept again without it).

    The ledger collapses to a count for each failure mask first (at most 2^rules rows)."""
    masks = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = masks.sparkSession.createDataFrame([(name, 1 << i) for i, (name, _) in enumerate(RULES) if name in policy.rules], "rule string, bit bigint")
    hit = F.expr("m & bit") != 0
    return masks.join(F.broadcast(rules), hit).groupBy("rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


POLICIES = (BASE, STRICT)


def ablations(docs: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, version, n_kept, and for each of its rules: rule, n_failed, n_only; all from one stored ledger."""
    rows, out = stored(docs), None
    for policy in policies:
        kept = rows.agg(F.count_if(passes(policy)).alias("n_kept"))
        name = [F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version")]
        part = ablation(rows, policy).select(*name, "rule", "n_failed", "n_only").join(F.broadcast(kept.select(*name, "n_kept")), ["policy", "version"])
        out = part if out is None else out.unionByName(part)
    return out


def op2(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    base = ~passes(BASE)
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failed")


def keep(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of docs that pass, with their own columns; each row is judged in the scan, so ids may repeat and nothing is joined."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("t"))

    def measured(batches):
        for batch in batches:
            found = [measure(t) for t in batch.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["row", *MEASURES])

    schema = StructType([rows.schema["row"], *(StructField(m, LongType()) for m in MEASURES)])
    failed = rows.mapInArrow(measured, schema).withColumn("failed", failures())
    return failed.where(passes(BASE) & passes(policy)).select("row.*")


def _ledger_sql() -> str:
    failed = " + ".join(f"case when {rule} then {1 << i} else 0 end" for i, (_, rule) in enumerate(RULES))
    return rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as ls, t from d),
x as (select doc_id, generate_subscripts(ws, 1) as i, ws from w),
g as (select doc_id, i, row(ws[i], ws[i+1], ws[i+2]) as k from x where i + 2 <= len(ws)),
r as (select doc_id, i, count(*) over (partition by doc_id, k) as c from g),
p as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i+1, i+2]) as j from r where c > 1) group by 1),
m as (select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
 len(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) as n_lines,
 len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) as n_distinct,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters,
 coalesce(p.n, 0) as n_repeat_words from w left join p using (doc_id)),
f as (select *, n_lines - n_distinct as n_dup_lines from m),
b as (select *, {failed} as failed from f)"""


def _sql() -> str:
    return rf"""{_ledger_sql()}
 select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
 n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, (failed & {BASE.mask}) <> 0 as base_failed,
 (failed & {BASE.mask | STRICT.mask}) = 0 as kept, failed::bigint as failed from b"""


def _ablation_sql() -> str:
    """Only rules that some document fails have a row."""
    parts = []
    for policy in POLICIES:
        for i, (name, _) in enumerate(RULES):
            if name in policy.rules:
                parts.append(f"select '{policy.name}' as policy, {policy.version} as version, '{name}' as rule, count(*) filter ((failed & {1 << i}) <> 0) as n_failed, count(*) filter ((failed & {policy.mask}) = {1 << i}) as n_only, count(*) filter ((failed & {policy.mask}) = 0) as n_kept from b")
    return f"{_ledger_sql()}, a as ({' union all '.join(parts)}) select policy, version, n_kept, rule, n_failed, n_only from a where n_failed > 0"


SQL, ABLATION_SQL = _sql(), _ablation_sql()
