"""References to records that do not exist (yet, or any more)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.skew import HOT_SHARE, key_filter, skew_join
from quarry.session import cut

#: References of a key from which it may be hot.
BUSY = 1000


def chunk_key(c: Column) -> Column:
    """Chunk ids are one if they differ only in case, surrounding blanks or zeros after the last `_c`."""
    bare = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.regexp_replace(F.lower(bare), r"(?s)^(.*_c)0*(.+)$", "$1$2")


def children(rows: DataFrame, row_id: str, at: str, scalars: dict[str, Column] | None = None, arrays: dict[str, Column] | None = None) -> DataFrame:
    """References in long form: row_id, ref_field, ref_key (as written), key (canonical), at.

    `scalars` and `arrays` map a reference column to the canonical form of a key column named ref_key. Null values,
    null arrays and null elements are no references; empty strings are.
    """
    canon = {**(scalars or {}), **(arrays or {})}
    def tag(f: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(f).alias("ref_field"), x.alias("ref_key")))

    refs = [tag(f, F.array(F.col(f))) for f in scalars or {}] + [tag(f, F.coalesce(F.col(f), F.array())) for f in arrays or {}]
    long = rows.select(F.col(row_id).alias("row_id"), F.col(at).alias("at"), F.explode(F.concat(*refs)).alias("r")).select("row_id", "at", "r.*").filter("ref_key is not null")
    key = F.lit(None).cast("string")
    for f, c in canon.items():
        key = F.when(F.col("ref_field") == f, c).otherwise(key)
    return long.withColumn("key", key)


def parents(table: DataFrame, ref_field: str, key: Column, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Parent keys in long form. `since`: when the record came (null: always there); `until`: when it was deleted."""
    never = F.lit(None).cast("timestamp_ntz")
    live = F.lit(until is None)
    return table.select(
        F.lit(ref_field).alias("ref_field"), key.alias("key"), live.alias("is_parent"), (live & F.lit(since is None)).alias("always"), (never if since is None else since.cast("timestamp_ntz")).alias("since"), (never if until is None else until.cast("timestamp_ntz")).alias("until")
    ).filter("key is not null")


def suspects(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Tagged parent and child keys, in long form, grouped by table and key; the groups that lack a parent for some child.

    One row per (ref_field, key) with is_parent, known (by table or tombstone), since, until and n, the number of
    references; and `lacking`, false for keys with more than BUSY references that lack nothing, which are kept as well so that
    hot keys can be told. A key's references are counted on the map side, so a hot key moves a few rows only.
    """
    kids = refs.select("ref_field", "key", F.lit(1).alias("n"), "at", F.lit(False).alias("is_parent"), F.lit(False).alias("always"), F.lit(False).alias("dead"), F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"))
    old = known.select("ref_field", "key", F.lit(0).alias("n"), F.lit(None).cast("timestamp_ntz").alias("at"), "is_parent", F.col("always") | (F.col("is_parent") & F.col("since").isNull()), (~F.col("is_parent")).alias("dead"), "since", "until").toDF(*kids.columns)
    groups = kids.unionByName(old).groupBy("ref_field", "key").agg(
        F.sum("n").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("is_parent").alias("is_parent"), F.max("always").alias("always"), F.max("dead").alias("dead"), F.min("since").alias("since"), F.min("until").alias("until")
    )
    lacking = ~F.col("is_parent") & ~F.col("dead")
    gone = F.col("until") <= F.col("last_at")
    early = F.col("is_parent") & ~F.col("always") & (F.col("since") > F.col("first_at"))
    groups = groups.withColumn("lacking", lacking | F.coalesce(gone, F.lit(False)) | F.coalesce(early, F.lit(False)))
    return groups.filter((F.col("n") > 0) & (F.col("lacking") | (F.col("n") > BUSY)))


def orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Every reference without a live target at its time: row_id, at, ref_field, ref_key, ref_state, distinct.

    ref_state is `deleted` (deleted not after `at`), else `late` (the target's earliest `since` is after `at`), else
    `missing` (neither a parent nor a deletion known). A key known only by a later deletion is no orphan. Where `at`
    is null only `missing` can be told. Repeated rows come out once; an empty table of references gives no rows, an
        empty parent table makes its references missing. References whose key lacks nothing are dropped before the shuffle, by
    a filter of bits. Of a hot key (a third of all references, say) the grouping moves partial counts; if it lacks nothing its
    references are dropped by name, else its one row is broadcast. The HOT_SHARE busiest keys of each kind count as hot:
    any key with that share of all references is among them.
    """
    keys, found = ["ref_field", "key"], cut(suspects(refs, known))
    bad = found.filter("lacking")
    busy = [x.filter(F.col("n") > BUSY).orderBy(F.desc("n"), *keys).limit(HOT_SHARE).select(*keys) for x in (bad, found.filter("not lacking"))]
    some = key_filter(refs, bad.select(*keys), keys).join(F.broadcast(busy[1]), keys, "left_anti")
    rows = skew_join(some, bad.select(*keys, "is_parent", "always", "dead", "since", "until"), keys, busy[0])
    state = (
        F.when(F.col("until") <= F.col("at"), "deleted")
        .when(F.col("is_parent") & ~F.col("always") & (F.col("since") > F.col("at")), "late")
        .when(~F.col("is_parent") & ~F.col("dead"), "missing")
    )
    return rows.withColumn("ref_state", state).filter("ref_state is not null").select("row_id", "at", "ref_field", "ref_key", "ref_state").distinct()


def orphan_counts(found: DataFrame, tables: dict[str, str]) -> DataFrame:
    """Orphans per parent table and calendar month of `at` (null where unknown): parent_table, period, ref_state, n_refs, n_rows."""
    name = F.lit(None).cast("string")
    for f, t in tables.items():
        name = F.when(F.col("ref_field") == f, F.lit(t)).otherwise(name)
    return (
        found.groupBy(name.alias("parent_table"), F.date_format("at", "yyyy-MM").alias("period"), "ref_state", "row_id")
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy("parent_table", "period", "ref_state")
        .agg(F.sum("k").alias("n_refs"), F.count(F.lit(1)).alias("n_rows"))
    )


def retrieval_orphans(retrievals: DataFrame, questions: DataFrame, eval_items: DataFrame, chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """orphans() over the retrieval log: q_id against questions and held-out items, chunk ids against chunks and tombstones."""
    refs = children(retrievals, "ret_id", "logged_at", {"q_id": F.col("ref_key")}, {"retrieved_chunk_ids": chunk_key(F.col("ref_key"))})
    known = (
        parents(questions, "q_id", F.col("q_id"), since=F.col("created_at"))
        .unionByName(parents(eval_items, "q_id", F.col("q_id")))
        .unionByName(parents(chunks, "retrieved_chunk_ids", chunk_key(F.col("chunk_id")), since=F.col("cached_at")))
        .unionByName(parents(tombstones, "retrieved_chunk_ids", chunk_key(F.col("chunk_id")), until=F.col("deleted_at")))
    )
    return orphans(refs, known)
