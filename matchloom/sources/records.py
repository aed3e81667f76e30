"""Literal tab-separated records in, ordered match lists out, with integrity audits."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_literal(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS, strict: bool = True) -> DataFrame:
    """Tab-separated text without quoting: every field is data, an empty field stays '', `NA` and `null` stay text.

    The header must name the columns; with ``strict`` a line of another width fails the read.
    """
    lines = spark.read.text(path)
    head = "\t".join(columns)
    parts = F.split("value", "\t", -1)
    rows = lines.where(F.col("value") != head).select(parts.alias("p"))
    if strict:
        rows = rows.where(F.coalesce(F.assert_true(F.size("p") == len(columns), F.concat(F.lit("fields: "), F.size("p").cast("string"))).isNull(), F.lit(True)))
    return rows.select(*(F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """rid 0.. in the order of a key column that the source provides (its line number, or its id)."""
    from matchloom.operators.order import numbered as place

    return place(df, order)


def fold(name: Column, address: Column, country: Column) -> Column:
    """0..99 from the first 32 bits of SHA-256 over lower-case name, address and country joined by a vertical bar."""
    digest = F.sha2(F.concat(F.lower(name), F.lit("|"), F.lower(address), F.lit("|"), country), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def truth_links(truth: DataFrame) -> DataFrame:
    """source1_entity_id, target_id from comma lists; '' means none."""
    return truth.where(F.length("matched_entity_ids") > 0).select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("target_id"))


def link_audit(links: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of violations: repeated links, shared targets, orphan anchors and targets, links across countries."""
    a = anchors.select(F.col("entity_id").alias("source1_entity_id"), F.col("country").alias("a_country"))
    t = targets.select(F.col("entity_id").alias("target_id"), F.col("country").alias("t_country"))
    tests = {
        "repeated": links.groupBy("source1_entity_id", "target_id").count().where("count > 1"),
        "shared": links.groupBy("target_id").agg(F.countDistinct("source1_entity_id").alias("n")).where("n > 1"),
        "orphan_anchor": links.join(a, "source1_entity_id", "left_anti"),
        "orphan_target": links.join(t, "target_id", "left_anti"),
        "cross_country": links.join(a, "source1_entity_id").join(t, "target_id").where("a_country <> t_country"),
    }
    counts = [d.agg(F.count("*").alias(k)) for k, d in tests.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # single rows
    return out


def list_of(ids: str, by: str | None = None) -> Column:
    """Comma list of distinct ids, ordered by ``by`` (the ids themselves if not given)."""
    pairs = F.collect_set(F.struct(F.col(by or ids).alias("o"), F.col(ids).alias("i")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["i"].cast("string")), ",")


def match_lines(anchors: DataFrame, links: DataFrame, field: str = "matched_entity_ids") -> DataFrame:
    """Every anchor once with its (possibly empty) list: rid, source1_entity_id and the list column."""
    lists = links.groupBy("source1_entity_id").agg(list_of("target_id").alias(field))
    out = anchors.select("rid", F.col("entity_id").alias("source1_entity_id")).join(lists, "source1_entity_id", "left")
    return out.select("rid", "source1_entity_id", F.coalesce(field, F.lit("")).alias(field))


@dataclass(frozen=True)
class Budget:
    """Most bytes that a written list table may have."""

    limit: int

    def size(self, lines: DataFrame, *columns: str) -> int:
        return lines.agg(F.sum(F.octet_length(F.concat_ws("\t", *columns)) + 1)).first()[0] or 0

    def check(self, lines: DataFrame, *columns: str) -> None:
        if (n := self.size(lines, *columns)) > self.limit:
            raise ValueError(f"{n} bytes are over the budget of {self.limit}")


def write_lines(lines: DataFrame, path: str, *columns: str, budget: Budget | None = None) -> None:
    """Tab-separated lines in the order of rid under a header; fails if the path exists."""
    if budget:
        budget.check(lines, *columns)
    head = lines.sparkSession.createDataFrame([(-1, "\t".join(columns))], "rid long, value string")
    lines.select(F.col("rid").cast("long"), F.concat_ws("\t", *columns).alias("value")).unionByName(head).orderBy("rid").select("value").write.mode("error").text(path)


def manifest(tables: dict[str, DataFrame], generation: str) -> dict:
    """Counts and order-free content hashes per table, with an id that ties them together."""
    out = {}
    for name, df in tables.items():
        row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
        out[name] = {"rows": row["n"], "hash": hashlib.sha256(str(row["s"]).encode()).hexdigest(), "generation_id": generation}
    return {"status": "approved", "generation_id": generation, "sources": out}


def gate(expected: dict, tables: dict[str, DataFrame]) -> None:
    """Raises unless the manifest is approved, of one generation, and the tables are those it describes."""
    if expected.get("status") != "approved":
        raise ValueError("the manifest is not approved")
    if {s["generation_id"] for s in expected["sources"].values()} != {expected["generation_id"]}:
        raise ValueError("sources of several generations")
    now = manifest(tables, expected["generation_id"])["sources"]
    if changed := sorted(k for k, v in expected["sources"].items() if now.get(k) != v):
        raise ValueError(f"changed sources: {', '.join(changed)}")


def once(path: str, make, spark: SparkSession) -> DataFrame:
    """Result of ``make()`` written to a path, or what a finished earlier run left there (marked _SUCCESS)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(path: str, values: dict) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(values, out, ensure_ascii=False, indent=1, sort_keys=True)


def bundle(path: str, files: list[str]) -> dict[str, str]:
    """Zips local files and returns the SHA-256 of each as read back from the archive."""
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.basename(f))
    with zipfile.ZipFile(path) as z:
        return {n: hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist()}


def digest(path: str) -> str:
    """SHA-256 of a local file, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def audit_bundle(archive: str, files: list[str], repeated: tuple[str, str] | None = None) -> dict[str, str]:
    """Hashes of the files; raises unless the archive holds the same bytes and a repeated run's two outputs are equal."""
    hashes = {os.path.basename(f): digest(f) for f in files}
    with zipfile.ZipFile(archive) as z:
        for name, want in hashes.items():
            with z.open(name) as f:
                if hashlib.file_digest(f, "sha256").hexdigest() != want:
                    raise ValueError(f"{name} differs in the archive")
    if repeated and digest(repeated[0]) != digest(repeated[1]):
        raise ValueError("a repeated run gave other bytes")
    return hashes


def score_integrity(scores: DataFrame, sibling: DataFrame | None = None, least_corr: float = 0.8) -> dict:
    """Raises unless scores(key, score) are finite, within 0..1, spread out and, if given, correlated with a sibling."""
    joined = scores if sibling is None else scores.join(sibling.select("key", F.col("score").alias("other")), "key", "left")
    corr = F.lit(1.0) if sibling is None else F.corr("score", "other")
    row = joined.agg(F.count("*").alias("n"), F.sum((F.col("score").isNull() | F.isnan("score")).cast("int")).alias("bad"), F.min("score").alias("low"), F.max("score").alias("high"), F.stddev("score").alias("spread"), corr.alias("corr")).first().asDict()
    if row["bad"] or row["low"] < 0 or row["high"] > 1 or row["spread"] <= 0.1 or (row["corr"] or 0) < least_corr:
        raise ValueError(f"scores look wrong: {row}")
    return row
