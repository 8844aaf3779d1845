"""References to records that do not exist.

Keys are dictionary-encoded: a key belongs to the block its hash names and gets a dense number in that
block, so the dictionary is built in parallel and a block is a key range. For every block and arrival
quarter two bitmaps are built, one of the keys referenced and one of the keys that are valid all
through the quarter. A bitmap is kept as its non-empty 64-bit words only. ``referenced AND NOT valid``
leaves the keys that need a look at exact times; these are few, are decoded through the dictionary and
checked against the changes inside the quarter.

At every step data are reduced by key and quarter before they move, so a key that holds a third of all
rows costs one row a quarter. The one join that carries single references goes by key *and* quarter and
leaves skew to the adaptive skew join; it needs no grouping of references at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.keys import day_key, facility_key, grid_key, tag_key
from sievemark.session import checkpointed

ALWAYS_FROM, FOREVER = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def _ts(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _quarter(c: Column) -> Column:
    return (F.year(c) * 4 + F.quarter(c) - 1).cast("int")


def find_orphans(refs: DataFrame, parents: DataFrame, blocks: int = 1024) -> DataFrame:
    """References that no valid row answers at their time.

    ``refs``: ref_table, key, at and any further columns (no clash with the names used here: they are
    carried in one struct). ``parents``: ref_table, key, valid_from, valid_to; a row is valid from
    valid_from (included) to valid_to (excluded).

    Null key: no reference. Null ``at``: judged after all changes. Null valid_from: valid since ever;
    null valid_to: never ends. Repeated rows change nothing; empty inputs give an empty result or, for
    empty parents, every reference as missing.

    Returns the columns of ``refs`` and reason: missing (key unknown), late (all rows of the key came
    later) or deleted (otherwise).
    """
    own = [c for c in refs.columns if c not in ("ref_table", "key", "at")]
    r = refs.where(F.col("key").isNotNull()).select(
        "ref_table", "key", F.coalesce("at", _ts(FOREVER) - F.expr("interval 1 day")).alias("at"), F.col("at").alias("_at0"),
        F.struct(*own).alias("_own") if own else F.lit(None).alias("_own"),
    ).withColumn("q", _quarter(F.col("at")))
    # a row that is never valid still makes its key known
    since, to = F.coalesce("valid_from", _ts(ALWAYS_FROM)), F.coalesce("valid_to", _ts(FOREVER))
    p = parents.where(F.col("key").isNotNull()).select("ref_table", "key", since.alias("valid_from"), F.greatest(since, to).alias("valid_to")).withColumn("q", _quarter(F.col("valid_from")))
    # One row for each key and quarter, of references (n_refs) and of rows that can answer (until).
    asked = r.groupBy("ref_table", "key", "q").agg(F.count(F.lit(1)).alias("n_refs"))
    known = p.groupBy("ref_table", "key", "q").agg(F.min("valid_from").alias("first_from"), F.max("valid_to").alias("until"))
    both = asked.unionByName(known, allowMissingColumns=True).withColumn("block", F.pmod(F.xxhash64("ref_table", "key"), F.lit(blocks)).cast("int"))

    # The dictionary: a dense number for each key of a block.
    entry = F.dense_rank().over(Window.partitionBy("block").orderBy("ref_table", "key")) - 1
    coded = checkpointed(both.withColumn("entry", entry).select("*", F.expr("entry div 64").cast("int").alias("word"), F.expr("entry % 64").cast("int").alias("bit")).drop("entry"))

    # A row loaded in quarter q and valid to quarter e answers every reference of the quarters between. Rows valid
    # to the end of all references are most of them: their bits are carried forward along the quarters, nothing is
    # repeated for each. Only shorter validity is spread over its quarters.
    span = coded.where("n_refs is not null").agg(F.min("q").alias("a"), F.max("q").alias("b")).first()
    lo, hi = (span["a"], span["b"]) if span["a"] is not None else (0, -1)
    end = _quarter(F.col("until")) - 1
    place, bit = ["block", "word", "q"], F.expr("shiftleft(1L, bit)")
    part = lambda df, name: df.select(*place, *[(bit if k == name else F.lit(0).cast("bigint")).alias(k) for k in ("asks", "gives", "holds")])
    lasting = coded.where(F.col("until").isNotNull() & (end >= hi))
    start = F.greatest(F.col("q") + 1, F.lit(lo))
    spread = coded.where(F.col("until").isNotNull() & (end < hi) & (start <= end)).select("block", "word", "bit", F.explode(F.sequence(start, end)).alias("q"))
    bits = part(coded.where("n_refs is not null"), "asks").unionByName(part(lasting, "gives")).unionByName(part(spread, "holds"))
    words = bits.groupBy(*place).agg(*[F.expr(f"bit_or({k})").alias(k) for k in ("asks", "gives", "holds")])
    earlier = Window.partitionBy("block", "word").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    carried = words.withColumn("carried", F.coalesce(F.bit_or("gives").over(earlier), F.lit(0).cast("bigint"))).where("asks != 0")
    left = (
        carried.select(*place, F.expr("asks & ~(holds | carried)").alias("bits"))
        .where("bits != 0")
        .select(*place, F.explode(F.expr("filter(sequence(0, 63), b -> getbit(bits, b) = 1)")).alias("bit"))
    )

    # Decoded: what was known of such a key before the quarter, and whether it changed inside it.
    facts = (
        left.join(coded.withColumnRenamed("q", "kq"), ["block", "word", "bit"])
        .groupBy("block", "word", "bit", "q")
        .agg(
            F.first("ref_table").alias("ref_table"), F.first("key").alias("key"), F.min("first_from").alias("first_from"),
            F.max(F.when(F.col("kq") < F.col("q"), F.col("until"))).alias("carried"), F.coalesce(F.bool_or((F.col("kq") == F.col("q")) & F.col("until").isNotNull()), F.lit(False)).alias("changed"),
        )
        .drop("block", "word", "bit")
    )
    facts = checkpointed(facts)
    changes = (
        p.join(facts.where("changed").select("ref_table", "key", "q"), ["ref_table", "key", "q"], "left_semi")
        .groupBy("ref_table", "key", "q", "valid_from").agg(F.max("valid_to").alias("valid_to"))
        .groupBy("ref_table", "key", "q").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("changes"))
    )
    facts = facts.join(changes, ["ref_table", "key", "q"], "left")
    until = F.expr("greatest(carried, array_max(transform(filter(changes, c -> c.valid_from <= at), c -> c.valid_to)))")
    orphan = (
        r.join(facts, ["ref_table", "key", "q"])
        .withColumn("_until", until)
        .where("_until is null or _until <= at")
        .withColumn("reason", F.when(F.col("first_from").isNull(), "missing").when(F.col("first_from") > F.col("at"), "late").otherwise("deleted"))
    )
    return orphan.select("ref_table", "key", F.col("_at0").alias("at"), *([F.col("_own")[c].alias(c) for c in own]), "reason")


def corpus_references(corpus: DataFrame) -> DataFrame:
    """One row for each reference a narrative makes: facility, tag, citation and grid letter."""
    ccn, tag, day = facility_key(F.col("ccn")), tag_key(F.col("f_tag")), day_key(F.col("survey_date"))
    pair = lambda name, key: F.struct(F.lit(name).alias("ref_table"), key.alias("key"))
    citation = F.when(ccn.isNotNull() & day.isNotNull() & tag.isNotNull(), F.concat_ws("|", ccn, day, tag))
    pairs = F.array(pair("provider_information", ccn), pair("tag_taxonomy", tag), pair("health_deficiencies", citation), pair("severity_grid", grid_key(F.col("scope_severity"))))
    return corpus.select("doc_id", "year", "quarter", F.col("loaded_at").alias("at"), F.explode(pairs).alias("p")).select("doc_id", "year", "quarter", "at", "p.ref_table", "p.key")


def referenced_rows(providers: DataFrame, tags: DataFrame, citations: DataFrame, grid: DataFrame) -> DataFrame:
    """The rows that can answer, with their time of validity; grid letters are always valid."""

    def of(df: DataFrame, name: str, key: Column) -> DataFrame:
        always = "loaded_at" not in df.columns
        none = F.lit(None).cast("timestamp_ntz")
        return df.select(F.lit(name).alias("ref_table"), key.alias("key"), (none if always else F.col("loaded_at")).alias("valid_from"), (none if always else F.col("deleted_at")).alias("valid_to"))

    ccn = facility_key(F.col("cms_certification_number_ccn"))
    citation = F.concat(ccn, F.lit("|"), day_key(F.col("survey_date")), F.lit("|"), tag_key(F.col("deficiency_tag_number")))
    return (
        of(providers, "provider_information", ccn)
        .unionByName(of(tags, "tag_taxonomy", tag_key(F.col("f_tag"))))
        .unionByName(of(citations, "health_deficiencies", citation))
        .unionByName(of(grid, "severity_grid", grid_key(F.col("scope_severity"))))
    )


def corpus_orphans(spark: SparkSession, tables: dict[str, DataFrame], blocks: int = 1024) -> DataFrame:
    """Orphan references of the corpus: doc_id, year, quarter, ref_table, key, at, reason."""
    parents = referenced_rows(*(tables[t] for t in ("provider_information", "tag_taxonomy", "health_deficiencies", "severity_grid")))
    return find_orphans(corpus_references(tables["corpus"]), parents, blocks)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by referenced table, year, quarter and reason; unknown periods form a row of their own."""
    return orphans.groupBy("ref_table", "year", "quarter", "reason").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_keys"))
