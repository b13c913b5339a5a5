"""Personal data by candidate gradient boosting, with DataFrame and SQL functions only.

Base patterns give spans that always stay. High-recall generators, two or three a kind, then propose further spans, which may
overlap within a kind and between kinds; boosted trees score every proposal from its format and its context, and those above a
calibrated threshold are added where they meet no base span and overlap no proposal of a higher score (ties: the kind that is
listed first, then the longer, then the earlier). The trees are trained here, by MLlib, on snippets that a rule writes (SNIPPETS
rows: real formats and look-alikes such as dates, versions, times, hardware addresses and order numbers), three quarters for
training, one for the thresholds (the smallest at which PRECISION holds). The trained trees become one SQL expression, so every
document is handled in its own row: one scan, no shuffle, no Python.

Null text counts as empty: no spans. Repeated rows give repeated results, a null doc_id stays; an empty table gives no rows, other
columns are not read, and a text of any length is handled whole. Offsets are code points, end exclusive."""

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
SNIPPETS, TREES, DEPTH, PRECISION, NEAR = 6000, 16, 4, 0.98, 24
#: Values that are folded at once. Proposals on either side among which those are that can overlap one: none is longer than 500 characters or shorter than 5, and one generator's don't overlap (9 generators by 500 / 6).
RUN, AROUND = 128, 768
_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Possessive forms match what the plain ones do without deep recursion; an address starts where its run of characters does.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAME = r"[\p{L}0-9-]{1,64}+"
_OWNER = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+"
#: Generators by kind: a wide one first, then narrower ones, which find spans that a wide one runs past.
PROPOSALS = {
    "email": (
        rf"[\p{{L}}0-9._%+-]{{1,64}}+\x20?(?:@|\(at\)|\[at\])\x20?{_NAME}(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?){_NAME}){{1,5}}+",
        rf"(?i){_OWNER}\x20at\x20{_NAME}(?:\x20dot\x20{_NAME}){{1,5}}+",
    ),
    "ip": (
        r"[0-9]{1,3}+(?:\.[0-9]{1,3}+){3,7}+",
        r"(?i)[0-9]{1,3}+(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+){2}+",
        r"(?i)(?<![0-9a-z:])(?=[0-9a-f:]{5})(?:[0-9a-f]{0,4}:){2,7}+[0-9a-f]{1,4}+(?![0-9a-z:])",
    ),
    "card": (
        r"[0-9](?:[\x20.-]?[0-9]){11,22}+",
        r"(?<![0-9])[0-9]{4}([\x20.-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5})(?![0-9])",
    ),
    "phone": (
        r"(?:\+|00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}+",
        r"(?i)(?<![0-9])(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?:,?\x20(?:ext\.?|x|extension)\x20?[0-9]{1,5}+)?+(?![0-9])",
    ),
}
_HINT = {
    "email": r"(?i)mail|contact|write|inbox|send|reach|correo|courriel|schick|office", "ip": r"(?i)\bip\b|host|server|addr|login|from|answers|router|home to|node|ping",
    "card": r"(?i)card|visa|credit|pay|karte|carte|tarjeta|express|charge|master", "phone": r"(?i)tel|phone|call|fax|mobil|tél|ruf|ring|cell|line|number|appel|llam|dial|reach|text",
}
_OTHER = r"(?i)order|isbn|version|date|total|price|ref|serial|id\b|no\.?$|invoice|part|track|section|score|popul|sold|release|item|build|lot\b"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(i):
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), add), F.lit(0), lambda a, x: a + x) % 10 == 0


def _short(value: Column, least: int, most: int) -> Column:
    return F.length(_digits(value)).between(least, most)


def valid(kind: str, value: Column) -> Column:
    """Whether a base match stands."""
    return {
        "email": F.lit(True), "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(_short(value, 16, 19), luhn(_digits(value))).otherwise(False), "phone": _short(value, 8, 15),
    }[kind]


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body has it, within functions of arrays too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold, zero: int = 0) -> Column:
    """The running fold (a sum or a maximum) of an array of int, RUN values at a time, so that arrays aren't copied for each value."""
    empty, at = F.from_json(F.lit("[]"), "array<int>"), lambda x: x.cast("int").alias("at")

    def along(part, first):
        """The fold after each value of a short array."""
        step = lambda s, x: let(fold(s["at"], x), lambda y: F.struct(F.concat(s["out"], F.array(y)).alias("out"), at(y)))
        return F.aggregate(part, F.struct(empty.alias("out"), at(first)), step)["out"]

    def whole(v):
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(RUN))
        sums = F.transform(starts, lambda b: F.aggregate(F.slice(v, b + 1, F.lit(RUN)), F.lit(zero), lambda s, x: fold(s, x).cast("int")))
        carry = let(sums, lambda t: F.concat(F.array(F.lit(zero)), along(t, F.lit(zero))))
        return let(carry, lambda c: F.flatten(F.transform(starts, lambda b, i: along(F.slice(v, b + 1, F.lit(RUN)), F.get(c, i)))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(empty))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, end, value, before, after). Gaps and matches alternate, so running sums of
    their lengths give places. before has up to NEAR characters, back to the match before at most; after has 4, up to the match
    behind. The time grows with the text and its matches, not with their product."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(s, ends):
        def one(v, i):
            # coalesce: the first match has none before it
            back = F.concat(F.coalesce(F.get(s["found"], i - 1), F.lit("")), F.get(s["gaps"], i))
            ahead = F.concat(F.get(s["gaps"], i + 1), F.coalesce(F.get(s["found"], i + 1), F.lit("")))
            return F.struct(F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end"), v.alias("value"), F.right(back, F.lit(NEAR)).alias("before"), F.left(ahead, F.lit(4)).alias("after"))

        return F.transform(s["found"], one)

    lengths = lambda s: F.flatten(F.transform(s["found"], lambda v, i: F.array(F.length(F.get(s["gaps"], i)), F.length(v))))
    return let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda s: let(running(lengths(s), lambda a, x: a + x), lambda ends: placed(s, ends)))


#: Whether the digits of a column d are a card's, in SQL.
_LUHN = "aggregate(transform(filter(split(reverse(d), ''), c -> c <> ''), (c, i) -> IF(i % 2 = 1, 2 * int(c) - IF(c > '4', 9, 0), int(c))), 0, (a, x) -> a + x) % 10"


def features(kind: str) -> list[str]:
    """Format of the span m.value, whose digits are d, then its context (m.before, m.after), as SQL."""
    is_ = lambda p, what="m.value": f"IF({what} RLIKE r'{p}', 1, 0)"
    count = lambda c: f"length(m.value) - length(regexp_replace(m.value, r'{c}', ''))"
    cols = [
        str(KINDS.index(kind)), "length(m.value)", "length(d)", count("[.]"), count("-"), count(" "), count("[()]"), count(":"), count("[A-Fa-f]"),
        "CASE WHEN m.value LIKE '+%' THEN 3 WHEN m.value LIKE '00%' THEN 2 WHEN m.value RLIKE r'^\\(?0' THEN 1 ELSE 0 END",
        f"IF(length(d) BETWEEN 12 AND 23, IF({_LUHN} = 0, 1, 0), -1)", is_(rf"^{_PART}(?:(?:\[?\(?(?:\.|dot)\)?\]?){_PART}){{3}}$"),
        "CASE WHEN m.value LIKE '%@%' THEN 2 WHEN m.value RLIKE r'[(\\[]at' THEN 1 ELSE 0 END", is_(r"[.\])\x20][A-Za-z]{2,6}$"),
        is_(r"(?i)\x20(?:at|dot)\x20(?:the|a|an|this|that|my|our|his|her|its|their)\x20"), is_(r"^(?:19|20)[0-9]{2}[.\x20-]?(?:0[1-9]|1[0-2])[.\x20-]?[0-3][0-9]"),
        is_(r"^(?:19|20)[0-9]{2}[\x20-]"), is_(r"^(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"), is_(r"^0[0-9](?:[\x20.-][0-9]{2}){4}$"),
        is_(r"^[0-9]{4}([\x20.-]?)(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5})$"), is_(r"(?i)^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^[^.]*::[^.]*$"),
        is_(r"(?i)^[0-9a-f]{2}(?::[0-9a-f]{2}){5}$"), is_(r"(?i)x"),
        is_(_HINT[kind] + r"[^.\n]{0,14}$", "m.before"), is_(r"(?:" + _OTHER + r")[^.\n]{0,9}$", "m.before"), is_(r"[\p{L}0-9.$€#-]$", "m.before"), is_(r"^[\p{L}0-9%-]", "m.after"),
    ]
    return [f"double({c})" for c in cols]


N_FEATURES = 27
#: Snippets: # stands for a digit, ! for the check digit of those before, ~ for a word, ^ for 0 to 255, $ for one to four hexadecimal digits, % for two.
_WORDS = "anna lee maria rob info kim sales tom hello karl ines acme north river studio press desk lab blue stone garden peters jo vega".split()
_YES = {
    "email": ("~.~@~.com", "~## (at) ~.org", "~_~ [at] ~ [dot] de", "~ at ~ dot com", "~.~ at ~ dot co dot uk", "~ @ ~.net", "~.~(at)~.de", "~ (at) ~ (dot) org", "~[at]~.example.com"),
    "ip": ("^.^.^.^", "^[.]^[.]^[.]^", "^(.)^(.)^(.)^", "^.^.^[.]^", "^[dot]^[dot]^[dot]^", "$:$:$:$:$:$:$:$", "$:$:$::$", "$::$:$:$:$", "20##:$:$:0:0:$:$:$", "fe80::$:$:$:$"),
    "card": ("#### #### #### ###!", "####.####.####.###!", "####-####-####-###!", "###############!", "3##############!", "3#############!", "3### ###### ####!", "3###-######-####!", "3### ###### ###!"),
    "phone": ("(###) ###-####", "(0##) ###-####", "00## ### ######", "00## ## ########", "###-###-####", "###-###-####", "###.###.####", "### ### ####", "1-###-###-####", "0# ## ## ## ##", "0### ######", "0## #### ####", "###-###-#### ext. ##", "(###) ###-#### x###", "+# (###) ###-####"),
}
_NO = {
    "email": ("## @ #.##", "~ @ ##.##", "~ at the dot com ~", "us at a dot com ~", "# @ #.##", "~ at this dot ~"),
    "ip": ("###.5##.##.###", "^.^.^.^.^.^", "1#:##:##", "0#:##:##:##", "%:%:%:%:%:%", "#.##.#.3##", "##:##:##.###", "#:##:##"),
    "card": ("#################", "########-########", "97###########", "#### #### #### ####", "####-####-####", "## ### ### ### ###", "######################", "978-#-###-#####-#", "############"),
    "phone": ("20##-0#-1# ####", "20##-1#-2#", "20##-###-####", "#########", "###.###.###", "##############", "# ### ### ###", "## ### ###", "####-####-####", "978-#-##-######-#", "##-## ##-## ##-##", "######-####"),
}
_BEFORE = {
    "email": ("mail me: ", "contact ", "write to ", "e-mail: ", "reach us via ", "send it to ", "inbox: ", "correo: "), "ip": ("from ", "host ", "server at ", "login by ", "ping ", "address: ", "the router answers at "),
    "card": ("card ", "pay with ", "charge it to ", "credit card no. ", "visa: ", "carte ", "her card was "), "phone": ("call ", "tel. ", "phone: ", "fax: ", "her cell is ", "ring us on ", "text ", "the number is ", "dial "),
}
_PLAIN = ("of the ", "and ", "or ", "it was ", "then ", "we saw ", "is still ")
_BAD = ("order no. ", "total ", "version ", "id ", "dated ", "ref: ", "invoice ", "part no. ", "ISBN ", "tracking number ", "sections ", "sold ", "the scores ", "release ", "item ", "between ", "at ")
_AFTER = (" and", ".", ", is", " today", " please", ", thanks")


def snippets(spark: SparkSession, n: int = SNIPPETS) -> DataFrame:
    """(id, kind, text, y): written by rule from hashes of the id, half of them look-alikes. Three in ten of either have a plain context."""
    hashed = lambda *k: f"pmod(xxhash64(id, {', '.join(k)}), {{}})"
    pick = lambda xs, k: "element_at(array(" + ", ".join(f"'{x}'" for x in xs) + f"), int({hashed(k).format(len(xs))}) + 1)"
    by_kind = lambda of, k: "CASE kind " + " ".join(f"WHEN '{kind}' THEN {pick(of[kind], k)}" for kind in KINDS) + " END"
    tail = lambda size: f"right(lower(hex(xxhash64(id, i, 'x'))), int({size}))"
    signs = {"#": f"string({hashed('i').format(10)})", "~": pick(_WORDS, "i + 100"), "^": f"string({hashed('i').format(256)})", "$": tail(hashed("i", "'n'").format(4) + " + 1"), "%": tail("2")}
    filled = "array_join(transform(split(form, ''), (c, i) -> CASE c " + " ".join(f"WHEN '{c}' THEN {sql}" for c, sql in signs.items()) + " ELSE c END), '')"
    rows = spark.range(0, n, 1, 2).selectExpr("id", "element_at(array('" + "', '".join(KINDS) + "'), int(id % 4) + 1) kind", "pmod(floor(id / 4), 2) = 0 y")
    rows = rows.selectExpr("id", "kind", "y", f"IF(y, {by_kind(_YES, '1')}, {by_kind(_NO, '2')}) form")
    rows = rows.selectExpr("id", "kind", "y", f"{filled} body", f"IF({hashed('3').format(10)} < 3, {pick(_PLAIN, '4')}, IF(y, {by_kind(_BEFORE, '5')}, {pick(_BAD, '6')})) lead", f"{pick(_AFTER, '7')} tail")
    rows = rows.selectExpr("id", "kind", "y", "body", "lead", "tail", "regexp_replace(replace(body, '!', '0'), '[^0-9]', '') d")
    return rows.selectExpr("id", "kind", f"concat(lead, replace(body, '!', IF(body LIKE '%!%', string(pmod(-{_LUHN}, 10)), '')), tail) text", "double(y) y")


def with_proposals(rows: DataFrame, kind: str, use: Column | None = None) -> DataFrame:
    """rows with try_<kind>: the proposals of all its generators with their features, an array of (start, end, x); null where use is false."""
    found = F.concat(*(matches(F.col("text"), p) for p in PROPOSALS[kind]))
    rows = rows.withColumn("_found", found if use is None else F.when(use, found))
    x = "transform(array(regexp_replace(m.value, '[^0-9]', '')), d -> array({}))[0]".format(", ".join(features(kind)))
    return rows.withColumn(f"try_{kind}", F.expr(f"transform(_found, m -> named_struct('start', m.start, 'end', m.end, 'x', {x}))")).drop("_found")


def _tree_sql(lines: list[str], x: str) -> str:
    """A tree's printed form as nested CASE expressions."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return repr(float(head.split(":")[1])) + "D"
    feature, limit = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", head).groups()
    left = _tree_sql(lines, x)
    lines.pop(0)
    return f"CASE WHEN {x}[{feature}] <= {float(limit)}D THEN {left} ELSE {_tree_sql(lines, x)} END"


def fit(spark: SparkSession, n: int = SNIPPETS) -> dict:
    """The trees as SQL over an array x, and the threshold of each kind."""
    found = snippets(spark, n).cache()
    rows = None
    for kind in KINDS:
        part = with_proposals(found.where(F.col("kind") == kind), kind).select("id", "kind", "y", F.explode(f"try_{kind}").alias("p")).select("id", "kind", "y", *(F.col("p.x")[i].alias(f"f{i}") for i in range(N_FEATURES)))
        rows = part if rows is None else rows.unionByName(part)
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(N_FEATURES)], outputCol="features").transform(rows).cache()
    train = rows.where("pmod(xxhash64(id, 'split'), 4) > 0")
    model = GBTClassifier(labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(train)
    text, trees = model.toDebugString.split("\n")[1:], []
    for line in text:
        if re.match(r"\s*Tree \d+", line):
            trees.append([])
        elif line.strip():
            trees[-1].append(line)
    sql = " + ".join(f"{w}D * ({_tree_sql(t, 'x')})" for t, w in zip(trees, model.treeWeights, strict=True))
    x = F.array(*(F.col(f"f{i}") for i in range(N_FEATURES))).alias("x")
    held = rows.where("pmod(xxhash64(id, 'split'), 4) = 0").select("kind", "y", x).select("kind", "y", F.expr(sql).alias("s"))
    steps = held.groupBy("kind", F.round("s", 2).alias("s")).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()  # a few hundred rows
    rows.unpersist()
    found.unpersist()
    limits = {}
    for kind in KINDS:
        own = sorted(((r.s, r.p, r.n) for r in steps if r.kind == kind), reverse=True)
        good, total, limits[kind] = 0.0, 0, 10.0
        for s, p, k in own:
            good, total = good + p, total + k
            if good >= PRECISION * total:
                limits[kind] = max(s - 0.005, 0.3)
    return {"sql": sql, "limits": limits, "mllib": model}


def _stands(kind: str):
    return lambda m: valid(kind, m["value"])


def _free(taken: Column, scored: Column) -> Column:
    """Proposals that meet no taken span: of all spans that begin before a proposal ends, none ends after it begins."""
    whole = lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("taken"), b["end"].alias("reach"), F.lit(0.0).alias("s"), F.lit(0).alias("kind"), b["start"].alias("start"))
    tried = lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("taken"), F.lit(0).alias("reach"), c["s"].alias("s"), c["kind"].alias("kind"), c["start"].alias("start"))
    events = F.array_sort(F.concat(F.transform(taken, whole), F.transform(scored, tried)))

    def clear(e):
        marked = lambda reach: F.transform(e, lambda x, i: F.struct(x["start"].alias("start"), x["at"].alias("end"), x["s"].alias("s"), x["kind"].alias("kind"), ((x["taken"] == 0) & (F.get(reach, i) <= x["start"])).alias("free")))
        return F.filter(let(running(F.transform(e, lambda x: x["reach"]), F.greatest), marked), lambda x: x["free"])

    return let(events, clear)


def _unbeaten(free: Column) -> Column:
    """Proposals that overlap none of a higher score (or as high, and its kind is listed first, or it is longer, or begins earlier).
    A span that several generators propose counts once."""
    def best(m):
        def beaten(c, i):
            near = F.slice(m, F.greatest(i + 1 - AROUND, F.lit(1)), F.lit(2 * AROUND + 1))
            meets = lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"])
            rank = lambda d: F.struct((-d["s"]).alias("s"), d["kind"].alias("kind"), (d["start"] - d["end"]).alias("n"), d["start"].alias("start"))
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.exists(near, lambda d: meets(d) & (rank(d) < rank(c))).alias("beaten"))

        return F.filter(F.transform(m, beaten), lambda c: ~c["beaten"])

    once = lambda m: F.filter(m, lambda c, i: (i == 0) | (c != F.get(m, i - 1)))
    return let(let(F.array_sort(free), once), best)


def spans(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and, for each kind, the base spans (base_<kind>) and the added ones (more_<kind>), each an array of (start, end)."""
    texts = whole_text(docs)
    text = F.col("text")
    pair = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>")
    needs = {
        "email": text.rlike(r"(?i)@|[(\[]at|\x20dot\x20"), "ip": text.rlike(r"(?i)[0-9][\])]?\.|[0-9][(\[]|[0-9a-f]?:[0-9a-f]*:"), "card": text.rlike(r"[0-9](?:[\x20.-]?[0-9]){11}"),
        "phone": text.rlike(r"\+[0-9]|[0-9](?:[\x20().-]{0,2}[0-9]){6}"),
    }
    out = texts
    for kind in KINDS:
        base = F.transform(F.filter(matches(text, BASE[kind]), _stands(kind)), pair)
        out = with_proposals(out.withColumn(f"base_{kind}", F.when(needs[kind], base).otherwise(nothing)), kind, needs[kind])
    for kind in KINDS:
        scored = F.expr(f"filter(transform(try_{kind}, c -> named_struct('start', c.start, 'end', c.end, 's', transform(array(c.x), x -> {model['sql']})[0])), c -> c.s > {model['limits'][kind]}D)")
        out = out.withColumn(f"scored_{kind}", scored)
    # What meets a base span of any kind is not added again, nor what meets a better proposal of another kind.
    def of(i):
        return lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), F.lit(i).alias("kind"))

    def of_kind(i):
        return lambda c: c["kind"] == i

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,s:double,kind:int>>")
    tried = F.concat(*(F.coalesce(F.transform(F.col(f"scored_{k}"), of(i)), none) for i, k in enumerate(KINDS)))
    taken = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    added = let(tried, lambda t: F.when(F.size(t) > 0, _unbeaten(_free(taken, t))))
    out = out.withColumn("added", added)
    for i, kind in enumerate(KINDS):
        own = F.transform(F.filter("added", of_kind(i)), pair)
        out = out.withColumn(f"more_{kind}", F.coalesce(own, nothing))
    return out.select("doc_id", *(f"{w}_{k}" for k in KINDS for w in ("base", "more")))


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _listed(prefixes: tuple[str, ...]) -> Column:
    parts = [F.transform(F.array_sort(F.concat(*(F.col(f"{p}_{k}") for p in prefixes))), _named(k)) for k in KINDS]
    return F.array_join(F.concat(*parts), ",")


_fitted: dict[int, dict] = {}


def model(spark: SparkSession, n: int = SNIPPETS) -> dict:
    """fit(), once a Python process for each n: the snippets are the same every time."""
    if n not in _fitted:
        _fitted[n] = fit(spark, n)
    return _fitted[n]


def op9(docs: DataFrame) -> DataFrame:
    found = spans(docs, model(docs.sparkSession))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(("base",)).cast("binary"), 256).alias("base_sha256"), _listed(("base", "more")).alias("spans"))
