"""Declarative link additions and the joins behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that an acronym leaves out.
LEGAL = (
    "sarl sas sasu sa eurl ei sci snc scop selarl gie ltd llc l.l.c. inc inc. corp corp. pvt pvt. private limited llp lp "
    "pllc pc p.c. co co. company corporation incorporated plc ltd."
).split()
SMALL = "de la le les du des l' d' et & and of the a à en pour sur au aux".split()


def initials(ascii_name: Column) -> Column:
    """Upper-case first letters of the words that count (input: lower case, without accents)."""
    bare = F.regexp_replace(F.regexp_replace(ascii_name, "\\((?:france|india|usa|us)\\)", " "), "\\b([ld])'", "$1' ")
    words = F.filter(F.split(bare, "[\\s,]+"), lambda w: ~w.isin(*LEGAL, *SMALL) & w.rlike("[a-z]"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(F.regexp_replace(w, "^[(\\[\"]+", ""), 1, 1)), ""))


def acronym_pairs(targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """tid, aid where the target's name is the initials of the anchor's (columns id, country, name | initials)."""
    t = targets.where(F.col("name").rlike("^[A-Z]{2,}$")).select(F.col("id").alias("tid"), "country", F.col("name").alias("initials"))
    return t.join(anchors.select(F.col("id").alias("aid"), "country", "initials"), ["country", "initials"]).select("tid", "aid")


def acronym_rule(scored: DataFrame, sim: float = 0.3, gap: float = 0.3) -> DataFrame:
    """Firing pairs of scored(tid, aid, sim, same_number): clear best, or the only candidate at the same first house
    number; targets on which firing pairs disagree are dropped."""
    per = Window.partitionBy("tid")
    x = scored.withColumn("r", F.row_number().over(per.orderBy(F.desc("sim"), "aid"))).withColumn("next", F.lead("sim", 1, 0.0).over(per.orderBy(F.desc("sim"), "aid"))).withColumn("alike", F.sum("same_number").over(per))
    clear = (F.col("r") == 1) & (F.col("sim") >= sim) & (F.col("sim") - F.col("next") >= gap)
    sole = (F.col("same_number") == 1) & (F.col("alike") == 1) & (F.col("sim") >= sim)
    fired = x.where(clear | sole).select("tid", "aid").distinct()
    return fired.join(fired.groupBy("tid").agg(F.countDistinct("aid").alias("n")).where("n = 1"), "tid").select("tid", "aid")


def unique_key_pairs(targets: DataFrame, anchors: DataFrame, *keys: str) -> DataFrame:
    """tid, aid where the key names exactly one anchor."""
    sole = anchors.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("aid")).where("n = 1")
    return targets.select(F.col("id").alias("tid"), *keys).join(sole, list(keys)).select("tid", "aid")


def number_blocks(targets: DataFrame, anchors: DataFrame, most: int = 20_000) -> DataFrame:
    """tid, aid, shared: common house numbers that at most ``most`` anchors have (columns id, country, numbers)."""
    a = anchors.select(F.col("id").alias("aid"), "country", F.explode(F.array_distinct("numbers")).alias("number"))
    rare = a.groupBy("country", "number").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    t = targets.select(F.col("id").alias("tid"), "country", F.explode(F.array_distinct("numbers")).alias("number"))
    return t.join(a.join(rare, ["country", "number"]), ["country", "number"]).groupBy("tid", "aid").agg(F.count("*").alias("shared"))


# Legal words that a domain may leave out.
DOMAIN_LEGAL = "sarl sas sasu sa eurl ei sci snc ltd llc inc corp pvt private limited llp lp pllc pc plc co company corporation incorporated l c p".split()


def domain_keys(words: Column) -> Column:
    """Ways a name may be run together in a domain: all rotations, any number of leading words as initials, with and without legal words."""

    def run_together(ws: Column) -> Column:
        n = F.size(ws)
        steps = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        turned = lambda k: F.concat(F.slice(ws, k + 1, n), F.slice(ws, 1, k))
        short = lambda w, i: F.concat(F.array_join(F.transform(F.slice(w, 1, i), lambda x: F.substring(x, 1, 1)), ""), F.array_join(F.slice(w, i + 1, n), ""))
        return F.flatten(F.transform(steps, lambda k: F.transform(steps, lambda i: short(turned(k), i))))

    both = F.concat(run_together(words), run_together(F.filter(words, lambda w: ~w.isin(*DOMAIN_LEGAL))))
    return F.filter(F.array_distinct(both), lambda x: x != "")


def house_number_relation(a: Column, b: Column) -> Column:
    """same, missing, one_digit, nearby (within 20) or unrelated, of two digit strings."""
    same_length = F.length(a) == F.length(b)
    differing = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, v: s + v)
    near = F.abs(a.try_cast("bigint") - b.try_cast("bigint")) <= 20
    return F.when((a == "") | (b == ""), "missing").when(a == b, "same").when(same_length & (differing == 1), "one_digit").when(near, "nearby").otherwise("unrelated")


def one_word_swap(a: Column, b: Column) -> Column:
    """True for token lists of one length that differ in exactly one place."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, v: s + v)
    return (F.size(a) == F.size(b)) & (odd == 1)


def fillers(targets: DataFrame, anchors: DataFrame, legal: list[str], least: int = 300, factor: int = 10) -> DataFrame:
    """word: frequent among targets, at least ``factor`` times rarer among anchors, no legal form (column words)."""
    count = lambda df, c: df.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias(c))
    x = count(targets, "t").join(count(anchors, "a"), "word", "left")
    return x.where((F.col("t") >= least) & (F.coalesce("a", F.lit(0)) * factor < F.col("t")) & ~F.col("word").isin(*legal)).select("word")


def decoy_signature(a_words: Column, q_words: Column, a_number: Column, q_number: Column, filler: Column) -> Column:
    """0: other words; 1: same words but for fillers, same number; 2: same words, other number."""
    return signature_of(same_words(a_words, q_words, filler), a_number, q_number)


def same_words(a_words: Column, q_words: Column, filler: Column) -> Column:
    return F.array_sort(F.array_except(a_words, filler)) == F.array_sort(F.array_except(q_words, filler))


def signature_of(same: Column, a_number: Column, q_number: Column) -> Column:
    return F.when(~same, 0).when(a_number == q_number, 1).otherwise(2)


def id_code(x: Column) -> Column:
    """`S2-n`, `S3-n` as one integer: n plus the source in the top bits; null if the id is no such thing."""
    source, number = F.regexp_extract(x, "^S([23])-([0-9]{1,9})$", 1), F.regexp_extract(x, "^S([23])-([0-9]{1,9})$", 2)
    return F.when(source != "", F.shiftleft(source.try_cast("bigint"), 60) + number.try_cast("bigint"))


def numbers(address: Column) -> Column:
    """Distinct house numbers without leading zeros; digits joined by a hyphen, slash or space are one number."""
    joined = F.regexp_replace(address, "(?<=[0-9])[-/ ](?=[0-9])", "")
    bare = F.transform(F.regexp_extract_all(joined, F.lit("[0-9]+"), 0), lambda x: F.ltrim(x, F.lit("0")))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def close_numbers(a: Column, b: Column) -> Column:
    """Equal, one part of the other (two digits at least), or one digit apart."""
    odd = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, v: s + v)
    part = (F.length(a) >= 2) & (F.length(b) >= 2) & (a.contains(b) | b.contains(a))
    return (a == b) | part | ((F.length(a) == F.length(b)) & (odd == 1))


def number_agreement(a: Column, b: Column) -> Column:
    """none, close or disjoint, of two lists of house numbers: a label-free sign of precision."""
    hit = F.exists(a, lambda x: F.exists(b, lambda y: close_numbers(x, y)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "none").when(hit, "close").otherwise("disjoint")


def digit_dropped(a: Column, b: Column) -> Column:
    """Whether the longer of two digit strings is the other with one digit more, anywhere."""
    long_, short = F.when(F.length(a) > F.length(b), a).otherwise(b), F.when(F.length(a) > F.length(b), b).otherwise(a)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(long_), F.lit(1))), lambda i: F.concat(F.substr(long_, F.lit(1), i - 1), F.substr(long_, i + 1)))
    return (F.abs(F.length(a) - F.length(b)) == 1) & F.array_contains(cuts, short)


def domain_pairs(targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """tid, aid, n_candidates: targets named by a domain, and the one anchor whose name may be run together so.

    Of several anchors, one counts if only it shares a house number (targets: id, country, name, numbers; anchors: id,
    country, words, numbers).
    """
    stem = F.replace(F.lower(F.regexp_extract(F.trim("name"), "(?i)^(?:www\\.)?([^\\s.]+)\\.c[o0]m$", 1)), F.lit("0"), F.lit("o"))
    t = targets.select(F.col("id").alias("tid"), "country", stem.alias("key"), F.col("numbers").alias("t_numbers")).where("key <> ''")
    a = anchors.select(F.col("id").alias("aid"), "country", F.explode(domain_keys(F.col("words"))).alias("key"), F.col("numbers").alias("a_numbers")).withColumn("key", F.replace("key", F.lit("0"), F.lit("o")))
    hit = t.join(a, ["country", "key"]).dropDuplicates(["tid", "aid"])
    per = Window.partitionBy("tid")
    x = hit.withColumns({"n": F.count("*").over(per), "near": F.arrays_overlap("t_numbers", "a_numbers").cast("int")})
    x = x.withColumn("n_near", F.sum("near").over(per))
    return x.where((F.col("n") == 1) | ((F.col("near") == 1) & (F.col("n_near") == 1))).select("tid", "aid", F.col("n").alias("n_candidates"))


def kill_switch(linked: DataFrame, high: float = 0.9, low: float = 0.2) -> DataFrame:
    """Links (tid, aid, word lists core, address, a_core, a_address) at one address under another name."""
    return linked.where(renamed_at_address(high, low)).select("tid", "aid")


def renamed_at_address(high: float = 0.9, low: float = 0.2) -> Column:
    """The condition of ``kill_switch``, which hangs on the words alone."""
    from matchloom.functions.similarity import jaccard

    return (F.size("address") >= 3) & (jaccard(F.col("address"), F.col("a_address")) >= high) & (jaccard(F.col("core"), F.col("a_core")) <= low)


def number_offset(target: Column, anchor: Column) -> Column:
    """Class of the difference of two house numbers (null: none)."""
    d = target - anchor
    return F.when(d.isNull(), "none").when(d == 0, "0").when(d.between(1, 20), "+1..+20").when(d.between(-20, -1), "-20..-1").when(d > 20, "> +20").otherwise("< -20")


def swapped_at_address(a_words: Column, q_words: Column, a_address: Column, q_address: Column) -> Column:
    """One word of two or more swapped, and the target's address (three words at least) inside the anchor's."""
    inside = (F.size(q_address) >= 3) & (F.size(F.array_except(q_address, a_address)) == 0)
    other = F.array_sort(F.array_distinct(a_words)) != F.array_sort(F.array_distinct(q_words))
    return (F.size(q_words) >= 2) & one_word_swap(a_words, q_words) & other & inside


def address_blocks(targets: DataFrame, anchors: DataFrame, keep: int = 3, most: int = 20_000) -> DataFrame:
    """tid, aid, sim, overlap, n_cand: anchors that share a rare house number, the best by name similarity plus a little per number.

    Records: id, country, numbers, grams (character n-grams of the name's skeleton).
    """
    from matchloom.functions.similarity import ratio

    shared = number_blocks(targets, anchors, most).withColumnRenamed("shared", "overlap")
    x = shared.join(targets.select(F.col("id").alias("tid"), F.col("grams").alias("q")), "tid").join(anchors.select(F.col("id").alias("aid"), F.col("grams").alias("a")), "aid")
    x = x.withColumn("sim", ratio(F.size(F.array_intersect("q", "a")), F.sqrt(F.size("q") * F.size("a"))))
    per = Window.partitionBy("tid")
    best = per.orderBy(F.desc(F.round(F.col("sim") + 0.02 * F.col("overlap"), 9)), "aid")
    return x.withColumns({"n_cand": F.count("*").over(per), "r": F.row_number().over(best)}).where(F.col("r") <= keep).select("tid", "aid", "sim", "overlap", "n_cand")


def new_pairs(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs (tid, aid, ...) that were not scored before."""
    return now.join(before.select("tid", "aid"), ["tid", "aid"], "left_anti")
