"""Queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.mojibake import find_garbled
from weftline.llm.near_duplicates import SQL_TOKEN, NearDuplicates
from weftline.llm.packing import fill_report, pack_items
from weftline.llm.mixing import mix_sources, share_report
from weftline.llm.shared_spans import SharedSpans, line_duplicates
from weftline.llm.sql import SQL
from weftline.llm.tokens import with_sizes
from weftline.session import Scratch
from weftline.sources.tables import newest, read_table

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def view_texts(spark: SparkSession, directory: str) -> DataFrame:
    """(id, text) of the newest rows of nodes with sql."""
    rows = newest(read_table(spark, directory, "nodes"), ["id"], "scanned_at", ["sql"])
    return rows.where("id is not null and sql is not null").select("id", F.col("sql").alias("text"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return NearDuplicates(view_texts(spark, directory), (3, 5), SQL_TOKEN, 3, 20).pairs()


def p3_groups(spark: SparkSession, directory: str) -> DataFrame:
    """One row for each view: its class of equal sets and the number of classes linked to it."""
    return NearDuplicates(view_texts(spark, directory), (3, 5), SQL_TOKEN, 3, 20).groups()


def p3_links(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of linked classes, by their representatives."""
    return NearDuplicates(view_texts(spark, directory), (3, 5), SQL_TOKEN, 3, 20).class_links()


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return SharedSpans(view_texts(spark, directory)).shared_chars()


def p4_lines(spark: SparkSession, directory: str) -> DataFrame:
    return line_duplicates(view_texts(spark, directory))


def _sizes(spark: SparkSession, directory: str, *keep: str) -> DataFrame:
    """Token counts of all documents, written once."""
    documents = read_table(spark, directory, "documents")
    return Scratch(spark, "sizes").cut(with_sizes(documents, ["doc_id", *keep]), "sizes")


def p7_pack(spark: SparkSession, directory: str) -> DataFrame:
    capacities = [r.capacity_tokens for r in read_table(spark, directory, "pack_sizes").collect()]
    packed = pack_items(_sizes(spark, directory), capacities)
    names = read_table(spark, directory, "pack_sizes").groupBy(F.col("capacity_tokens").cast("bigint").alias("capacity")).agg(F.min("pack_name").alias("pack_name"))
    return packed.join(names, "capacity").select("doc_id", "part", "n_tokens", "bin", "pack_name", "capacity")


def p7_report(spark: SparkSession, directory: str) -> DataFrame:
    return fill_report(p7_pack(spark, directory))


def p7_checks(spark: SparkSession, directory: str) -> DataFrame:
    """(rule, n): texts packed, and what breaks a rule of packing: nothing."""
    capacities = sorted(r.capacity_tokens for r in read_table(spark, directory, "pack_sizes").collect())
    sizes = _sizes(spark, directory)
    packed = Scratch(spark, "packed").cut(pack_items(sizes, capacities), "packed")
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("parts"), F.min("n_tokens").alias("least"))
    texts = texts.join(sizes.select("doc_id", F.col("n_tokens").alias("size")), "doc_id", "full").where("coalesce(size, 1) > 0")
    bins = packed.groupBy("bin").agg(F.sum("n_tokens").alias("held"), F.min("capacity").alias("capacity"), F.countDistinct("capacity").alias("kinds"))
    need = F.array_min(F.filter(F.lit(capacities), lambda c: c >= F.col("held")))
    rules = (
        (texts, {
            "texts packed": F.count("held"),
            "texts lost or held twice": F.count_if(~F.col("held").eqNullSafe(F.col("size"))),
            "texts cut that fit": F.count_if(F.col("parts") != F.ceil(F.col("size") / max(capacities))),
        }),
        (bins, {
            "containers over capacity": F.count_if(F.col("held") > F.col("capacity")),
            "containers larger than needed": F.count_if((F.col("kinds") > 1) | ~F.col("capacity").eqNullSafe(need)),
        }),
    )
    counts = [
        rows.agg(F.array(*(F.struct(F.lit(rule).alias("rule"), n.alias("n")) for rule, n in told.items())).alias("r")) for rows, told in rules
    ]
    return counts[0].unionByName(counts[1]).select(F.explode("r").alias("r")).select("r.*")


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mix_sources(_sizes(spark, directory, "source"), read_table(spark, directory, "mix_targets"))


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    targets = read_table(spark, directory, "mix_targets")
    return share_report(Scratch(spark, "mixed").cut(p8_mix(spark, directory), "mixed"), targets)


def p8_checks(spark: SparkSession, directory: str) -> DataFrame:
    """(source, documents, wrong): documents of each targeted source, and those used too often or used though empty."""
    mixed, targets = p8_mix(spark, directory), read_table(spark, directory, "mix_targets")
    wrong = (F.col("copies") > F.col("max_repeats")) | (F.col("copies") < 0) | ((F.col("n_tokens") == 0) & (F.col("copies") > 0))
    return mixed.join(F.broadcast(targets), "source").groupBy("source").agg(  # one row per target
        F.countDistinct("doc_id").alias("documents"), (F.count_if(wrong) + F.count("*") - F.countDistinct("doc_id")).alias("wrong")
    )


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_garbled(read_table(spark, directory, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, directory: str) -> DataFrame:
    return find_garbled(read_table(spark, directory, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_groups, p3_links, p4_found, p4_lines, p7_pack, p7_report, p7_checks, p8_mix, p8_shares, p8_checks, p9_found, p9_restored)}
