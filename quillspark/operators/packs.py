"""Partition of a corpus into fragments and collections, its id ledger, and plans to install and remove them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """source -> fragment: the first rule (nth, fragment, authors, traditions) that holds the author, else the tradition, else core."""
    by_author = rules.select("nth", "fragment", F.explode("authors").alias("author")).groupBy("author").agg(F.min_by("fragment", "nth").alias("by_author"))
    by_tradition = rules.select("nth", "fragment", F.explode("traditions").alias("tradition")).groupBy("tradition").agg(F.min_by("fragment", "nth").alias("by_tradition"))
    joined = sources.join(by_author, "author", "left").join(by_tradition, "tradition", "left")
    return joined.select("source", F.coalesce("by_author", "by_tradition", F.lit("core")).alias("fragment"))


def fragment_stats(units: DataFrame, fragments: DataFrame) -> DataFrame:
    """Works, units and characters of each fragment, by way of sums over works."""
    works = units.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.length("content").cast("long")).alias("chars"))
    return works.join(fragments, "source").groupBy("fragment").agg(F.count("*").alias("sources"), F.sum("units").cast("long").alias("units"), F.sum("chars").cast("long").alias("chars"))


def tag_totals(tags: DataFrame, fragments: DataFrame) -> DataFrame:
    """fragment, slug and number of units: catalogues merge by adding these up."""
    return tags.groupBy("source", "slug").agg(F.count("*").alias("n")).join(fragments, "source").groupBy("fragment", "slug").agg(F.sum("n").cast("long").alias("n"))


def digest(*columns) -> Column:
    """Digest of a group's rows: the sum of 60 bits of each row's SHA-256. Rows that know their place need no order,
    so sums of tasks add up, and no work's texts or digests are gathered in one place."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *columns), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.left(F.sha2(F.sum(bits).cast("string"), 256), F.lit(16))


def ledger(units: DataFrame) -> DataFrame:
    """Lowest and highest id, number of units and text digest of each work."""
    return units.groupBy("source").agg(F.min("unit_id").alias("min"), F.max("unit_id").alias("max"), F.count("*").alias("count"), digest("sequence", "unit_id", "content").alias("hash"))


def id_faults(before: DataFrame, now: DataFrame) -> DataFrame:
    """Works whose ids a reader may hold and which no longer mean the same: moved, rewritten or occupied."""
    mark = before.agg(F.max("max").alias("mark"))
    old = before.select("source", *(F.col(c).alias(f"old_{c}") for c in ("min", "max", "count", "hash")))
    rows = now.join(old, "source", "left").crossJoin(F.broadcast(mark))
    settled = F.col("min") <= F.col("mark")
    same_ids = (F.col("min") == F.col("old_min")) & (F.col("max") == F.col("old_max")) & (F.col("count") == F.col("old_count"))
    same_text = F.col("hash") == F.col("old_hash")
    fault = F.when(F.col("old_min").isNull(), F.when(settled, "occupied")).when(same_ids & same_text, None).when(same_text, F.when(settled, "moved")).when(same_ids, "rewritten").when(settled, "occupied")
    return rows.select("source", fault.alias("fault")).where("fault IS NOT NULL")


def install_plan(wanted: DataFrame, held: DataFrame, id_space: int) -> DataFrame:
    """fragment and action. wanted: fragment, sha256, id_space, model; held: fragment, sha256 (null: unknown), model."""
    h = held.select("fragment", F.col("sha256").alias("have"), F.col("model").alias("have_model"), F.lit(True).alias("there"))
    rows = wanted.join(h, "fragment", "left")
    action = F.when(F.col("id_space") != id_space, "refuse").when(F.col("there").isNull(), "install").when(~F.col("have_model").eqNullSafe(F.col("model")), "refuse").when(F.col("have").eqNullSafe(F.col("sha256")), "keep").otherwise("replace")
    return rows.select("fragment", action.alias("action"))


def uninstall_plan(members: DataFrame, collection: Column) -> DataFrame:
    """Fragments of a collection that no other installed collection needs."""
    own = members.where(collection).select("fragment").distinct()
    return own.join(members.where(~collection).select("fragment").distinct(), "fragment", "left_anti")


def bytes_to_install(members: DataFrame, fragments: DataFrame, held: DataFrame) -> DataFrame:
    """For each collection the bytes of its fragments that are not there yet."""
    missing = members.distinct().join(held.select("fragment"), "fragment", "left_anti").join(fragments, "fragment")
    return members.select("collection").distinct().join(missing.groupBy("collection").agg(F.sum("bytes").alias("b")), "collection", "left").select("collection", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


def savings(members: DataFrame, fragments: DataFrame) -> DataFrame:
    """What collections that share fragments take, against collections that stand alone."""
    all_ = members.join(fragments, "fragment")
    alone = all_.agg(F.sum("bytes").cast("long").alias("standalone"))
    shared = all_.select("fragment", "bytes").distinct().agg(F.sum("bytes").cast("long").alias("published"))
    return alone.crossJoin(shared)


def available(members: DataFrame, held: DataFrame) -> DataFrame:
    """Whether all fragments of each collection are there."""
    there = held.select("fragment", F.lit(1).alias("one"))
    return members.join(there, "fragment", "left").groupBy("collection").agg(F.bool_and(F.col("one").isNotNull()).alias("available"))


def covers_subject(tags: DataFrame, members: DataFrame, held: DataFrame, share: float = 0.5) -> DataFrame:
    """For each tag of which at least `share` is in absent fragments: the unavailable collection that has most of it, the first by name."""
    absent = F.when(F.col("one").isNull(), F.col("n")).otherwise(0)
    there = held.select("fragment", F.lit(1).alias("one"))
    missing = tags.join(there, "fragment", "left").groupBy("slug").agg((F.sum(absent) / F.sum("n")).alias("missing")).where(F.col("missing") >= share)
    able = available(members, held).where("NOT available").select("collection")
    has = members.join(able, "collection").join(tags, "fragment").groupBy("collection", "slug").agg(F.sum("n").cast("long").alias("n"))
    order = Window.partitionBy("slug").orderBy(F.col("n").desc(), "collection")
    return has.join(missing, "slug").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("slug", "collection", "n", "missing")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """source and what a new edition does to it: unchanged, changed, shrunk (refused) or absent (inserted)."""
    def side(df, name):
        return df.groupBy("source").agg(F.count("*").alias(f"{name}_n"), digest("sequence", "content").alias(f"{name}_d"))

    both = side(new, "new").join(side(old, "old"), "source", "left")
    state = F.when(F.col("old_n").isNull(), "absent").when(F.col("new_d") == F.col("old_d"), "unchanged").when(F.col("new_n") < F.col("old_n"), "shrunk").otherwise("changed")
    return both.select("source", state.alias("state"))


def supersede(held: DataFrame, loaded: DataFrame, replaced: DataFrame) -> DataFrame:
    """held without works that loaded ones replace, and the loaded ones. replaced: title."""
    gone = replaced.select("title").union(loaded.select("title")).distinct()
    return held.join(gone, "title", "left_anti").unionByName(loaded)


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A source_url from the map of titles for rows that have none."""
    return rows.join(labels.withColumnRenamed("source_url", "known"), "title", "left").withColumn("source_url", F.when(F.coalesce("source_url", F.lit("")) == "", F.coalesce("known", "source_url")).otherwise(F.col("source_url"))).drop("known")


def doomed_cascade(doomed: DataFrame, units: DataFrame, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """What stays of units, chunks and vectors without the doomed works."""
    stay = units.join(doomed, "source", "left_anti")
    kept = chunks.join(stay.select("unit_id"), "unit_id", "left_semi")
    return {"units": stay, "chunks": kept, "vectors": vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")}


def violations(doomed: DataFrame, sources: DataFrame, must_stay: DataFrame, expected: int) -> DataFrame:
    """Why a prune must not run: a row for each broken condition."""
    n = doomed.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.concat(F.lit("count is "), F.col("n")).alias("why"))
    lost = must_stay.join(doomed, "source", "left_semi").select(F.concat(F.lit("would lose "), F.col("source")).alias("why"))
    gone = must_stay.join(sources, "source", "left_anti").select(F.concat(F.lit("not there: "), F.col("source")).alias("why"))
    return n.unionByName(lost).unionByName(gone)


def exported(fragment: str, fragments: DataFrame, units: DataFrame, chunks: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """The content of one fragment, down the chain of keys; what no fragment has is the core."""
    own = units.join(fragments.where(F.col("fragment") == fragment).select("source"), "source", "left_semi")
    parts = chunks.join(own.select("unit_id"), "unit_id", "left_semi")
    return {"units": own, "chunks": parts, "vectors": vectors.join(parts.select("chunk_id"), "chunk_id", "left_semi")}


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet: all that an incremental run encodes."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def core(keep: DataFrame, sources: DataFrame, units: DataFrame, chunks: DataFrame, vectors: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """The corpus without all works that are not to be kept (keep: source), down the chain of keys: nothing is left that points at a row that went."""
    stay = keep.select("source").distinct()
    own = units.join(stay, "source", "left_semi")
    ids = own.select("unit_id")
    parts = chunks.join(ids, "unit_id", "left_semi")
    return {
        "sources": sources.join(stay, "source", "left_semi"), "units": own, "chunks": parts,
        "vectors": vectors.join(parts.select("chunk_id"), "chunk_id", "left_semi"), "tags": tags.join(ids, "unit_id", "left_semi"),
    }
