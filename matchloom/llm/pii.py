"""Personal data by pattern, and terms that disclose it by corpus co-occurrence.  DataFrame and SQL functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers; keys and tokens (long strings of mixed letters and
digits) are found beside them.  A protected entity is the string of such a span.  A context is a distinct line of text, so
that copies of a passage count once.  A term is a word of two letters or more that starts with a capital or is of a
script without case, outside those spans.  It discloses an entity if they share SUPPORT contexts at least,
P(entity | term) over contexts is SHARE at least, and seeing the term raises the entity's probability by BITS bits at
least.  A frequent entity's probability cannot rise so far: there P(entity | term) must be CERTAIN at least and the shared
contexts must bring SUPPORT * BITS bits together.  Everything is counted over all distinct lines.

A term that is seen at the start of sentences only, and whose lower-case form is as frequent, is an ordinary word and is
spared.  Disclosing terms become spans wherever they occur: `term` where P(entity | term) is CERTAIN at least, which
sanitise removes, and `name` where only some contexts disclose, which it generalises to the word class `<name>`.

All work on a text is about linear in its length: matches are placed block by block, contexts are made line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import scratch
from matchloom.llm.repeats import boxed

#: Possessive quantifiers where nothing can be given back: same matches, no deep recursion on long texts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
GATES = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Keys and tokens: strings of SECRET characters or more with that many digits and letters at least.
SECRET, MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 5
KINDS = [*PATTERNS, "secret", "name", "term"]
TERM = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]++"
WORD, WHOLE_TERM = r"\p{L}[\p{L}\p{M}]++", r"(?<![\p{L}\p{M}])" + TERM
#: What is before a term (back to the term before it or the line's start) if it opens a sentence.
OPENS_LINE, OPENS = r"^[^\p{L}]*$", r"[.!?:][\"')\]]*\s+[\"'(\[]*$"
SUPPORT, SHARE, BITS, CERTAIN = 3, 0.5, 4.0, 0.9
#: Slots of the fixed-size filter that tells which words need a closer look (bits in BUCKETS / 64 longs): 16 bits of a hash.
BUCKETS = 1 << 16
#: Terms up to which texts are searched for the terms themselves; beyond, by the filter.  The result is the same.
LISTED = 500
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
PLACE = "struct<start:int,end:int,value:string,gap:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(x), ""), lambda c, i: F.when(c == "", 0).otherwise(value(c, i))), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(x)).between(14, 19) & _luhn(_digits(x))
    if kind == "secret":
        return (F.length(_digits(x)) >= MIXED) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= MIXED)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _bound(x: Column, f) -> Column:
    """f(x) with x made once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _blocks(xs: Column) -> Column:
    """xs in runs of about the root of their number, so that work within runs and over runs stays far from quadratic."""
    size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(16))
    runs = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / size).cast("int")), lambda b: F.slice(xs, b * size + 1, size))
    return runs


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, gap) of all matches, in code points: gaps and matches alternate."""
    gap, value = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = _bound(value, lambda v: F.arrays_zip(F.slice(gap, 1, F.size(v)).alias("gap"), v.alias("value")))

    def place(xs: Column) -> Column:
        runs = _blocks(xs)
        sizes = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + F.length(x["gap"]) + F.length(x["value"])))
        return _bound(F.struct(runs.alias("runs"), sizes.alias("sizes")), lambda y: F.flatten(F.transform(y["runs"], lambda r, b: one(r, F.aggregate(F.slice(y["sizes"], 1, b), F.lit(0), lambda a, k: a + k)))))

    def one(run: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{PLACE}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["gap"])
            e = s + F.length(x["value"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["value"].alias("value"), x["gap"].alias("gap")))).alias("out"))

        return F.aggregate(run, start, step, lambda acc: acc["out"])

    return F.when(F.size(value) > 0, _bound(pairs, place)).otherwise(F.array().cast(f"array<{PLACE}>"))


def _found(text: Column, pattern: str, rank: int, kind: str) -> Column:
    return F.transform(_placed(text, pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))


def _of_pattern(text: Column, kind: str, pattern: str, gate: str) -> Column:
    return F.when(text.rlike(gate), F.filter(_found(text, pattern, KINDS.index(kind), kind), _check(kind))).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Array of base spans (start, rank, end, kind, value), sorted by start, then kind."""
    return F.sort_array(F.concat(*(_of_pattern(text, k, PATTERNS[k], GATES[k]) for k in PATTERNS)))


def secret_spans(text: Column) -> Column:
    return _of_pattern(text, "secret", SECRET, "[A-Za-z0-9+/_=-]{20}")


def protected(text: Column, base: Column) -> Column:
    """Base spans and secrets, sorted by start, then kind."""
    return F.sort_array(F.concat(base, secret_spans(text)))


def _bucket(x: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(x), 48).cast("int")


def _may(x: Column, bits: list[int]) -> Column:
    b = _bucket(x)
    return F.getbit(F.element_at(F.lit(bits).cast("array<bigint>"), F.shiftright(b, 6) + 1), b.bitwiseAND(63)) == 1


def _filter(values: Column, of: DataFrame) -> list[int]:
    """The filter that passes the values (some others too, but none of them is missed); empty if there are none."""
    slots = [r[0] for r in of.select(_bucket(values)).distinct().collect()]
    bits = [0] * (BUCKETS // 64 if slots else 0)
    for s in slots:
        bits[s // 64] |= 1 << (s % 64)
    return [b - (1 << 64) if b >> 63 else b for b in bits]


def entity_lines(rows: DataFrame) -> DataFrame:
    """context, entities and terms (outside spans) of the distinct lines that hold an entity.  No span crosses a line."""
    lines = rows.where(F.size("spans") > 0).select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("line", protected(F.col("line"), base_spans(F.col("line"))).alias("spans")).where(F.size("spans") > 0)
    entities = F.array_distinct(F.transform("spans", lambda x: x["value"]))
    terms = F.array_distinct(F.filter(F.regexp_extract_all(masked(F.col("line"), F.col("spans")), F.lit(WORD), 0), lambda w: w.rlike("^" + TERM)))
    return lines.select(F.xxhash64("line").alias("context"), entities.alias("entities"), terms.alias("terms")).dropDuplicates(["context"])


def _lines(rows: DataFrame) -> DataFrame:
    """kd, kt, line and its place `at` in the text, for rows(kd, kt, text)."""
    def ends(xs: Column) -> Column:
        def one(run: Column, at: Column) -> Column:
            start = F.struct(at.alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("out"))
            return F.aggregate(run, start, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), x.alias("line")))).alias("out")), lambda a: a["out"])

        runs = _blocks(xs)
        sizes = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + F.length(x) + 1))
        return _bound(F.struct(runs.alias("runs"), sizes.alias("sizes")), lambda y: F.flatten(F.transform(y["runs"], lambda r, b: one(r, F.aggregate(F.slice(y["sizes"], 1, b), F.lit(0), lambda a, k: a + k)))))

    return rows.select("kd", "kt", F.explode(_bound(F.split("text", "\n"), ends)).alias("x")).select("kd", "kt", "x.at", "x.line")


def occurrences(rows: DataFrame, terms: DataFrame, bits: list[int], pattern: str) -> DataFrame:
    """kd, kt, term, start, context, opens of the words of rows(kd, kt, text) of the pattern that pass the filter of terms(term)."""
    few = [r[0] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]

    def some(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        return F.arrays_overlap(found, F.lit(few)) if len(few) <= LISTED else F.exists(found, lambda w: _may(w, bits))

    lines = _lines(rows.where(some(F.col("text")))).where(some(F.col("line")))
    opens = lambda x, i: F.when(i == 0, x["gap"].rlike(OPENS_LINE) | x["gap"].rlike(OPENS)).otherwise(x["gap"].rlike(OPENS))
    hits = F.transform(_placed(F.col("line"), pattern), lambda x, i: F.struct(x["value"].alias("term"), x["start"].alias("start"), opens(x, i).alias("opens")))
    lines = lines.select("kd", "kt", "at", F.xxhash64("line").alias("context"), F.filter(hits, lambda x: _may(x["term"], bits)).alias("hits"))
    return lines.select("kd", "kt", "at", "context", F.explode("hits").alias("h")).select("kd", "kt", F.col("h.term").alias("term"), (F.col("at") + F.col("h.start")).cast("int").alias("start"), "context", F.col("h.opens").alias("opens"))


def ordinary(rows: DataFrame, terms: DataFrame) -> DataFrame | None:
    """Of terms(term, alone) that only open sentences, those whose lower-case form is on as many lines; None if there are none."""
    lower = scratch.checkpoint(terms.select("term", "alone", F.lower("term").alias("low")).where("low <> term"))
    bits = _filter(F.col("low"), lower)
    if not bits:
        return None
    seen = occurrences(rows, lower.select(F.col("low").alias("term")), bits, WORD).select(F.col("term").alias("low"), "context").distinct().groupBy("low").agg(F.count("*").alias("n"))
    return lower.join(seen, "low").where((F.col("n") >= SUPPORT) & (F.col("n") >= F.col("alone"))).select("term")


def disclosing(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """From rows(kd, kt, text, spans): (terms(term, kind), occurrences(kd, kt, term, start)), or None without candidates.

    Everything is counted over all rows.  Only filters of fixed size (BUCKETS bits) reach the driver.
    """
    contexts = scratch.checkpoint(entity_lines(rows))
    entities = contexts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("times")).where(F.col("times") >= SUPPORT)
    often = _filter(F.col("entity"), entities)
    if not often:
        return None
    pairs = contexts.select(F.explode(F.filter("entities", lambda x: _may(x, often))).alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    # a term is on `among` lines at least, so that pairs without the share among them can be left here
    among = scratch.checkpoint(contexts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("among")).where(F.col("among") >= SUPPORT))
    pairs = scratch.checkpoint(pairs.join(among, "term").where(F.col("both") / F.col("among") >= SHARE))
    bits = _filter(F.col("term"), pairs)
    if not bits:
        return None
    hits = occurrences(rows.select("kd", "kt", "text"), pairs, bits, WHOLE_TERM)
    hits = scratch.checkpoint(hits.join(pairs.select("term").distinct(), "term", "left_semi"))
    # copies of a line are one context, before anything is dealt by term
    alone = hits.groupBy("term", "context").agg(F.min("opens").alias("opens")).groupBy("term").agg(F.count("*").alias("alone"), F.min("opens").alias("opens"))
    alone = scratch.checkpoint(alone)
    total = rows.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("context")).distinct().count()
    share = F.col("both") / F.greatest("alone", "among")
    gain = F.log2(share * F.lit(float(total)) / F.col("times"))
    tells = (gain >= BITS) | ((share >= CERTAIN) & (F.col("both") * gain >= SUPPORT * BITS))
    told = pairs.join(alone, "term").join(entities, "entity").where((share >= SHARE) & tells)
    terms = scratch.checkpoint(told.groupBy("term").agg(F.when(F.max(share) >= CERTAIN, "term").otherwise("name").alias("kind"), F.first("opens").alias("opens"), F.first("alone").alias("alone")))
    spared = ordinary(rows.select("kd", "kt", "text"), terms.where("opens"))
    terms = terms if spared is None else terms.join(spared, "term", "left_anti")
    return terms.select("term", "kind"), hits.select("kd", "kt", "term", "start")


def spotted(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text (null: empty), base and spans: arrays sorted by start, then kind.

    Pattern spans are found once, in a table of the shared folder that the result still reads.
    """
    rows = boxed(docs).withColumn("base", base_spans(F.col("text")))
    rows = scratch.Table(rows.withColumn("spans", protected(F.col("text"), F.col("base"))), "spotted").read()
    found = disclosing(rows.select("kd", "kt", "text", "spans"))
    if found is None:
        return rows.select("row", "text", "base", "spans")
    terms, hits = found
    span = F.struct("start", F.when(F.col("kind") == "term", KINDS.index("term")).otherwise(KINDS.index("name")).alias("rank"), (F.col("start") + F.length("term")).cast("int").alias("end"), F.col("kind"), F.col("term").alias("value")).cast(SPAN)
    own = hits.join(terms, "term").groupBy("kd", "kt").agg(F.collect_set(span).alias("more"))
    rows = rows.join(own, ["kd", "kt"], "left")
    # a term inside a pattern's span is covered already
    outside = F.filter(F.coalesce("more", F.array().cast(f"array<{SPAN}>")), lambda x: ~F.exists("spans", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return rows.select("row", "text", "base", F.sort_array(F.concat("spans", outside)).alias("spans"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base, spans for every row of docs(doc_id, text).

    A null text is an empty one and has no span.  Repeated rows get equal spans; an empty table gives no rows; other
    columns are ignored, whatever their names.  Spans of one start (ties) are listed in the order of KINDS.
    """
    return spotted(docs.select("doc_id", "text")).select("row.doc_id", "text", "base", "spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs (all columns) with spans of text replaced by their kind in angle brackets, terms removed; null texts stay null."""
    clean = F.when(F.col("row.text").isNotNull(), masked(F.col("text"), F.col("spans")))
    return spotted(docs).select(*((clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets, terms by nothing.

    A span that starts inside another is dropped.  Spans are taken run by run: a run's stretch of text is cut out once.
    """
    def stretch(acc: Column, run: Column) -> Column:
        # at least as far as the run reaches
        end = F.greatest(acc["at"], F.array_max(F.transform(run, lambda x: x["end"])))

        def fill(cut: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                mark = F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
                put = F.concat(a["out"], F.substr(cut, a["at"] - acc["at"] + 1, x["start"] - a["at"]), mark)
                return F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), put.alias("out")))

            return F.aggregate(run, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step)

        done = _bound(F.substr(text, acc["at"] + 1, end - acc["at"]), fill)
        return _bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(_blocks(spans), start, stretch, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
