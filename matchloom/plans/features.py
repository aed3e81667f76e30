"""The comparison columns of a pair beside SQL, by family: each part name with the next one of its brand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import blocking, pair_features
from matchloom.plans.blocking_steps import grams, words
from matchloom.plans.common import table
from matchloom.registry import register


def _edit(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 WHEN {x} = {y} THEN 1 ELSE 1 - levenshtein({x}, {y}) / greatest(len({x}), len({y}))::DOUBLE END"


def _both(x: str, y: str) -> str:
    return f"len(list_intersect({x}, {y}))"


def _over(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0 ELSE ({top}) / ({bottom})::DOUBLE END"


def _jaccard(x: str, y: str) -> str:
    return _over(_both(x, y), f"len({x}) + len({y}) - {_both(x, y)}")


def _dice(x: str, y: str) -> str:
    return _over("2 * " + _both(x, y), f"len({x}) + len({y})")


def _least(x: str, y: str) -> str:
    return _over(_both(x, y), f"least(len({x}), len({y}))")


def _most(x: str, y: str) -> str:
    return _over(_both(x, y), f"greatest(len({x}), len({y}))")


LEGAL = "CASE p_size % 4 WHEN 0 THEN 'llc' WHEN 1 THEN 'inc' ELSE '' END"
REC = f"""rec AS (SELECT id, country, norm, core, address, phonetic, legal, non_ascii, missing, source, list_sort({words('core')}) AS n, list_sort({words('address')}) AS a, list_sort({words('phonetic')}) AS p, list_sort({words('norm')}) AS w, {grams('core')} AS g, {grams('address')} AS ga,
  list_sort(list_distinct(list_transform(regexp_extract_all(address, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')))) AS num, coalesce(list_transform(regexp_extract_all(address, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1'))[1], '') AS first,
  coalesce(string_split(core, ' ')[1], '') AS head, coalesce({words('address')}[1], '') AS x0, coalesce(list_filter(string_split(address, ' '), lambda w: w <> '')[1], '') AS a_head, coalesce(list_filter(string_split(address, ' '), lambda w: w <> '')[-1], '') AS a_tail
 FROM (SELECT p_partkey AS id, p_brand AS country, p_name || CASE WHEN {LEGAL} = '' THEN '' ELSE ' ' || {LEGAL} END AS norm, CASE WHEN p_size % 11 = 0 THEN '' ELSE CASE WHEN p_size % 5 = 0 THEN p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'two' ELSE 'three' END ELSE p_name END END AS core,
  CASE WHEN p_size % 7 = 0 THEN '' ELSE '0' || p_size || ' ' || lower(p_type) || ' rd ' || p_partkey % 9 END AS address, replace(p_name, 'a', '') AS phonetic, {LEGAL} AS legal, p_size % 2 AS non_ascii, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS missing, CASE WHEN p_partkey % 2 = 0 THEN 'S2' ELSE 'S3' END AS source FROM part)),
 pr AS (SELECT id AS aid, lead(id) OVER (PARTITION BY country ORDER BY id) AS tid FROM rec QUALIFY tid IS NOT NULL),
 f AS (SELECT aid, tid, l AS a, r AS q FROM pr JOIN rec l ON l.id = aid JOIN rec r ON r.id = tid)"""


def _sql(columns: dict[str, str], more: str = "", source: str = "f") -> str:
    return f"WITH {REC}{more} SELECT aid, tid, " + ", ".join(f"round(({v})::FLOAT::DOUBLE, 5) AS {k}" for k, v in columns.items()) + f" FROM {source}"


def records(spark, d):
    p, k, s = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    legal = F.when(s % 4 == 0, "llc").when(s % 4 == 1, "inc").otherwise("")
    core = F.when(s % 11 == 0, "").when(s % 5 == 0, F.concat("p_name", F.lit(" "), F.when(k % 2 == 0, "two").otherwise("three"))).otherwise(F.col("p_name"))
    address = F.when(s % 7 == 0, "").otherwise(F.concat(F.lit("0"), s.cast("string"), F.lit(" "), F.lower("p_type"), F.lit(" rd "), (k % 9).cast("string")))
    return p.select(
        k.alias("id"), F.col("p_brand").alias("country"), F.concat("p_name", F.when(legal == "", "").otherwise(F.concat(F.lit(" "), legal))).alias("norm"), core.alias("core"), address.alias("address"),
        F.replace("p_name", F.lit("a"), F.lit("")).alias("phonetic"), legal.alias("legal"), (s % 2).alias("non_ascii"), (s % 7 == 0).cast("int").alias("missing"), F.when(k % 2 == 0, "S2").otherwise("S3").alias("source"),
    )


def _compared(spark, d, names):
    x = records(spark, d)
    pairs = x.select(F.col("id").alias("aid"), F.lead("id").over(Window.partitionBy("country").orderBy("id")).alias("tid")).where("tid IS NOT NULL")
    late = ("retrieval_name_score", "retrieval_address_score", "retrieval_combined", "retrieval_rank", "retrieval_best_margin", "near_identical_candidates", "dense_route")
    terms, _ = blocking.postings(blocking.keys(x), x.count())
    out = pair_features.compare(pairs.withColumns({c: F.lit(float(i)) for i, c in enumerate(late)}), x, x, terms)
    return out.select("aid", "tid", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in names))


NAMES = {
    "name_edit": _edit("a.core", "q.core"), "name_trigram_dice": _dice("a.g", "q.g"), "name_sorted_edit": _edit("array_to_string(a.n, ' ')", "array_to_string(q.n, ' ')"), "name_token_jaccard": _jaccard("a.n", "q.n"),
    "name_token_min": _least("a.n", "q.n"), "name_token_max": _most("a.n", "q.n"), "name_exact": "(a.core = q.core)::INTEGER", "name_compact_exact": "(replace(a.core, ' ', '') = replace(q.core, ' ', ''))::INTEGER",
    "full_name_edit": _edit("a.norm", "q.norm"), "name_length_ratio": _over("least(len(a.core), len(q.core))", "greatest(len(a.core), len(q.core))"), "phonetic_edit": _edit("a.phonetic", "q.phonetic"),
    "phonetic_token_overlap": _least("a.p", "q.p"), "first_name_word_edit": _edit("a.head", "q.head"), "raw_name_token_jaccard": _jaccard("a.w", "q.w"), "phonetic_compact_exact": "(replace(a.phonetic, ' ', '') = replace(q.phonetic, ' ', ''))::INTEGER",
    "name_core_empty": "(a.core = '' OR q.core = '')::INTEGER", "name_shared_words": _both("a.n", "q.n"), "anchor_name_words": "len(a.n)", "target_name_words": "len(q.n)",
}
ADDRESSES = {
    "address_edit": _edit("a.address", "q.address"), "address_trigram_dice": _dice("a.ga", "q.ga"), "address_token_jaccard": _jaccard("a.a", "q.a"), "address_token_min": _least("a.a", "q.a"), "address_token_max": _most("a.a", "q.a"),
    "address_length_ratio": _over("least(len(a.address), len(q.address))", "greatest(len(a.address), len(q.address))"), "address_exact": "(a.address = q.address AND a.address <> '')::INTEGER",
    "name_address_product": f"({_dice('a.g', 'q.g')}) * ({_dice('a.ga', 'q.ga')})", "name_address_min": f"least({_dice('a.g', 'q.g')}, {_dice('a.ga', 'q.ga')})", "same_first_address_token": "(a.a_head <> '' AND a.a_head = q.a_head)::INTEGER",
    "same_last_address_token": "(a.a_tail <> '' AND a.a_tail = q.a_tail)::INTEGER", "address_shared_words": _both("a.a", "q.a"), "anchor_address_words": "len(a.a)", "target_address_words": "len(q.a)", "target_address_missing": "q.missing",
    "anchor_name_nonascii": "a.non_ascii", "target_name_nonascii": "q.non_ascii", "source_is_s3": "(q.source = 'S3')::INTEGER", "legal_both_present": "(a.legal <> '' AND q.legal <> '')::INTEGER", "legal_conflict": "(a.legal <> '' AND q.legal <> '' AND a.legal <> q.legal)::INTEGER",
    "retrieval_name_score": "0", "retrieval_address_score": "1", "retrieval_combined": "2", "retrieval_rank": "3", "retrieval_best_margin": "4", "near_identical_candidates": "5", "dense_route": "6",
}
ONLY_A, ONLY_Q = "list_filter(a.num, lambda x: NOT list_contains(q.num, x))", "list_filter(q.num, lambda x: NOT list_contains(a.num, x))"
SAID = "list_sort(list_intersect({0}, [" + ", ".join(f"'{w}'" for w in pair_features.NUMBER_WORDS) + "]))"
NUMBERS = {
    "number_jaccard": _jaccard("a.num", "q.num"), "number_min": _least("a.num", "q.num"), "both_have_numbers": "(len(a.num) > 0 AND len(q.num) > 0)::INTEGER", "first_number_equal": "(a.first <> '' AND a.first = q.first)::INTEGER",
    "first_number_conflict": "(a.first <> '' AND q.first <> '' AND a.first <> q.first)::INTEGER", "number_count_difference": "len(a.num) - len(q.num)", "anchor_only_numbers": f"len({ONLY_A})", "target_only_numbers": f"len({ONLY_Q})",
    "unmatched_number_min_log_diff": f"coalesce(list_min(flatten(list_transform({ONLY_A}, lambda x: list_transform({ONLY_Q}, lambda y: ln(1 + abs(x::DOUBLE - y::DOUBLE)))))), -1)",
    "name_number_word_conflict": f"(len({SAID.format('a.n')}) > 0 AND len({SAID.format('q.n')}) > 0 AND {SAID.format('a.n')} <> {SAID.format('q.n')})::INTEGER",
}
BEST = f"list_transform(q.n, lambda w: coalesce(list_max(list_transform(a.n, lambda v: {_edit('v', 'w')})), 0))"
FUZZY = {"name_token_fuzzy_mean": f"coalesce(list_avg({BEST}), 0)", "name_token_fuzzy_min": f"coalesce(list_min({BEST}), 0)", "name_token_fuzzy_max": f"coalesce(list_max({BEST}), 0)"}
IDF_CTE = """, tok AS (SELECT id, country, 1 AS type, unnest(n) AS token FROM rec UNION ALL SELECT id, country, 3, unnest(a) FROM rec),
 idf AS (SELECT country, type, token, ln(1 + (SELECT count(*) FROM rec)::DOUBLE / (1 + count(*))) AS idf FROM tok WHERE len(token) >= 2 GROUP BY ALL),
 tw AS (SELECT id, type, token, idf FROM tok JOIN idf USING (country, type, token)),
 sums AS (SELECT id, type, sum(idf) AS s FROM tw GROUP BY ALL),
 common AS (SELECT aid, tid, x.type, sum(x.idf) AS s FROM pr JOIN tw x ON x.id = aid JOIN tw y ON y.id = tid AND y.type = x.type AND y.token = x.token GROUP BY ALL),
 odd AS (SELECT aid, tid, max(idf) AS m FROM (SELECT aid, tid, t.idf FROM pr JOIN tw t ON t.id = aid AND t.type = 1 WHERE NOT EXISTS (SELECT 1 FROM tok o WHERE o.id = tid AND o.type = 1 AND o.token = t.token)
  UNION ALL SELECT aid, tid, t.idf FROM pr JOIN tw t ON t.id = tid AND t.type = 1 WHERE NOT EXISTS (SELECT 1 FROM tok o WHERE o.id = aid AND o.type = 1 AND o.token = t.token)) GROUP BY ALL),
 df AS (SELECT country, replace(core, ' ', '') AS c, count(*) AS n FROM rec GROUP BY ALL), size AS (SELECT country, count(*) AS n FROM rec GROUP BY country),
 g AS (SELECT pr.aid, pr.tid, coalesce(n.s, 0) AS ns, least(coalesce(na.s, 0), coalesce(nq.s, 0)) AS nm, coalesce(ad.s, 0) AS ads, least(coalesce(aa.s, 0), coalesce(aq.s, 0)) AS am, coalesce(odd.m, 0) AS m, ln(coalesce(df.n, 0) + 1) - ln(size.n) AS fl
  FROM pr LEFT JOIN common n ON n.aid = pr.aid AND n.tid = pr.tid AND n.type = 1 LEFT JOIN common ad ON ad.aid = pr.aid AND ad.tid = pr.tid AND ad.type = 3 LEFT JOIN sums na ON na.id = pr.aid AND na.type = 1 LEFT JOIN sums nq ON nq.id = pr.tid AND nq.type = 1
  LEFT JOIN sums aa ON aa.id = pr.aid AND aa.type = 3 LEFT JOIN sums aq ON aq.id = pr.tid AND aq.type = 3 LEFT JOIN odd ON odd.aid = pr.aid AND odd.tid = pr.tid JOIN rec q ON q.id = pr.tid JOIN rec a ON a.id = pr.aid JOIN size ON size.country = a.country LEFT JOIN df ON df.country = a.country AND df.c = replace(q.core, ' ', ''))"""
IDF = {"name_idf_overlap": "CASE WHEN nm = 0 THEN 0 ELSE ns / nm END", "address_idf_overlap": "CASE WHEN am = 0 THEN 0 ELSE ads / am END", "rare_unmatched_name_idf": "m", "name_frequency_log": "fl"}


@register(_sql(NAMES))
def features_names(spark, d):
    return _compared(spark, d, NAMES)


@register(_sql(ADDRESSES))
def features_addresses(spark, d):
    return _compared(spark, d, ADDRESSES)


@register(_sql(NUMBERS))
def features_numbers(spark, d):
    return _compared(spark, d, NUMBERS)


@register(_sql(FUZZY))
def features_fuzzy_tokens(spark, d):
    return _compared(spark, d, FUZZY)


@register(_sql(IDF, IDF_CTE, "g"))
def features_idf(spark, d):
    return _compared(spark, d, IDF)


@register(f"SELECT {len(NAMES) + len(ADDRESSES) + len(NUMBERS) + len(FUZZY) + len(IDF)} AS covered, 0 AS without_twin")
def features_covered(spark, d):
    """Every one of the 63 columns is in one family above."""
    known = [*NAMES, *ADDRESSES, *NUMBERS, *FUZZY, *IDF]
    return spark.createDataFrame([(len(set(known)), len(set(pair_features.columns()) - set(known)))], "covered int, without_twin int")
