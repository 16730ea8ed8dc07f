"""Library views over units: shelves, counts, citations, openings, paging, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import stored


def stats(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("n_units"), F.countDistinct("source").alias("n_sources"), F.countDistinct("tradition").alias("n_traditions"), F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0)).cast("long").alias("n_chars"))


def shelf(units: DataFrame) -> DataFrame:
    """Units and characters of each work."""
    return units.groupBy("source").agg(F.count("*").alias("n_units"), F.sum(F.length("content").cast("long")).alias("n_chars"))


def with_totals(sources: DataFrame, units: DataFrame) -> DataFrame:
    """Every source with its counts, 0 for one without units."""
    return sources.join(shelf(units), "source", "left").select(sources["*"], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_units", "n_chars")))


def citations(units: DataFrame, sources: DataFrame) -> DataFrame:
    """The projection that all retrieval shares; a unit whose source is missing keeps its row."""
    return units.join(sources, "source", "left").select("unit_id", "title", F.coalesce("source_title", F.lit("(none)")).alias("source_title"), F.coalesce("tradition", F.lit("Other")).alias("tradition"), F.coalesce("license", F.lit("")).alias("license"))


def prompt_label(*parts: Column) -> Column:
    """Parts that are there, joined by dashes."""
    return F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != ""), " — ")


def openings(units: DataFrame, n: int = 3) -> DataFrame:
    """The first n units of each work. Spark limits each task's rows to n a work before the shuffle."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("sequence", "unit_id"))
    return units.withColumn("place", place).where(F.col("place") <= n)


def neighbours(units: DataFrame) -> DataFrame:
    """For each unit the one before and the one after it in its work, -1 for none."""
    order = Window.partitionBy("source").orderBy("sequence", "unit_id")
    return units.select("unit_id", F.coalesce(F.lag("unit_id").over(order), F.lit(-1)).alias("previous"), F.coalesce(F.lead("unit_id").over(order), F.lit(-1)).alias("next"))


def containing(units: DataFrame, query: str, *columns: str) -> DataFrame:
    """Units in whose columns the query stands, whatever the case."""
    return units.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def like(units: DataFrame, query: str, limit: int) -> DataFrame:
    """Substring search, for questions that the index has no words for; % and _ are plain characters."""
    return containing(units, query, "content").orderBy("sequence", "unit_id").limit(limit)


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with the same key the first; recency lists, bookmarks and id unions are made of this."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__nth = 1").drop("__nth")


def stems(units: DataFrame, at_least: int = 30, share: float = 0.5) -> DataFrame:
    """For each work how many titles and stems (titles without a closing number) it has, and whether its contents are grouped by stem."""
    stem = F.regexp_replace("title", r"\s+\d+\s*$", "")
    return units.groupBy("source").agg(F.count("*").alias("n_titles"), F.countDistinct(stem).alias("n_stems")).withColumn("grouped", (F.col("n_titles") > at_least) & (F.col("n_stems") <= share * F.col("n_titles")))


def slugs(rows: DataFrame, key: str, label: Column) -> DataFrame:
    """key and slug: in order of the key each row takes its slug, or the first of slug-2, slug-3, ... that no row before it has.

    Rows start with their number among equal slugs. Where two rows want one slug (a third `a` and a
    row called `a-3`), the smaller key has it; the other moves on by one, and with it the rows behind
    it whose numbers follow without a gap. Rounds end when all slugs differ.
    """
    base = rows.select(key, T.slug(label).alias("base"))
    held = stored(base.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy(key))).withColumn("n", F.col("nth")), "slugs")
    name = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    while True:
        named = held.withColumn("slug", name)
        # only slugs that several bases want
        wanted = named.groupBy("slug").agg(F.count("*").alias("rows"), F.min(key).alias("first")).where("rows > 1")
        losers = named.join(wanted, "slug").where(F.col(key) != F.col("first")).groupBy("base").agg(F.min(F.struct("n", (F.col("n") - F.col("nth")).alias("gap"))).alias("from"))
        losers = stored(losers.select("base", F.col("from.n").alias("__n"), F.col("from.gap").alias("__gap")), "slugs-moved")
        if losers.isEmpty():
            return named.select(key, "slug")
        moved = (F.col("n") >= F.col("__n")) & (F.col("n") - F.col("nth") == F.col("__gap"))
        held = stored(held.join(losers, "base", "left").select(key, "base", "nth", F.when(moved, F.col("n") + 1).otherwise(F.col("n")).alias("n")), "slugs")


def numbered(rows: DataFrame, after: int, group: str, order: list[str]) -> DataFrame:
    """New ids behind `after`, contiguous for each group: counts of groups first, then places within them."""
    starts = rows.groupBy(group).count()
    first = F.coalesce(F.sum("count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(group, (first + after).alias("__first"))  # one short row for each group
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.join(starts, group).withColumn("new_id", F.col("__first") + place).drop("__first")


def context(content: Column, budget: int, passages: int) -> Column:
    """A passage cut to its share of a prompt's budget."""
    limit = max(400, min(8000, budget // passages))
    return F.when(F.length(content) > limit, F.concat(F.rtrim(F.left(content, F.lit(limit))), F.lit("… [truncated]"))).otherwise(content)


def thread_title(text: Column) -> Column:
    line = T.squeeze(text)
    return F.when(F.length(line) > 80, F.concat(F.rtrim(F.left(line, F.lit(80))), F.lit("…"))).otherwise(line)


# How parts of a provenance note begin.
NOTE_LABELS = {"translator": "Translated by ", "edition": "Print basis: ", "rights": "Rights: ", "source": "Ingested from ", "corroboration": "Corroborated against "}
SERIES = r"^(?:Ante-Nicene|Nicene and Post-Nicene) Fathers"
OPEN_RIGHTS = "Public-domain translation,"


def parse_notes(notes: Column) -> Column:
    """The parts of a provenance note, which bars separate, as a struct; what has no label is in `extra`.

    Of parts with the same label the last counts. A series' name is an edition as well, and the later
    of the two kinds stays; a public-domain translation is the rights if none stood before it.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), r"\|"), T.squeeze), lambda p: p != "")
    begins = lambda p, label: F.startswith(p, F.lit(label))
    last = lambda found: F.get(F.reverse(found), F.lit(0))
    after = lambda label: last(F.transform(F.filter(parts, lambda p: begins(p, label)), lambda p: F.trim(F.substring(p, len(label) + 1, 1 << 30))))
    fields = {name: after(label) for name, label in NOTE_LABELS.items()}
    basis = NOTE_LABELS["edition"]
    editions = F.filter(parts, lambda p: begins(p, basis) | p.rlike(SERIES))
    fields["edition"] = last(F.transform(editions, lambda p: F.when(begins(p, basis), F.trim(F.substring(p, len(basis) + 1, 1 << 30))).otherwise(F.regexp_replace(p, r"\s+,", ","))))
    rights = F.filter(parts, lambda p: begins(p, NOTE_LABELS["rights"]) | begins(p, OPEN_RIGHTS))
    fields["rights"] = F.coalesce(fields["rights"], F.get(rights, F.lit(0)))
    known = lambda p: p.rlike(SERIES) | begins(p, OPEN_RIGHTS) | F.exists(F.array(*map(F.lit, NOTE_LABELS.values())), lambda label: F.startswith(p, label))
    return F.struct(*(c.alias(name) for name, c in fields.items()), F.filter(parts, lambda p: ~known(p)).alias("extra"))


def listing(works: DataFrame, *by: str) -> DataFrame:
    """Works in order of some columns, those without a value last in each."""
    return works.orderBy(*(F.col(c).asc_nulls_last() for c in by))


def of_dimension(works: DataFrame, column: str, value) -> DataFrame:
    """Works of one tradition or type by their date as text, undated ones first."""
    return works.where(F.col(column) == value).orderBy(F.col("date_composed").asc_nulls_first())


#: What a citation keeps of a passage.
CITATION = "contentId bigint, source string, author string, tradition string, sourceUrl string"


def citation_json(unit_id: Column, source: Column, author: Column, tradition: Column, url: Column) -> Column:
    """A citation as JSON; fields without a value are null in it."""
    return F.to_json(F.struct(unit_id.cast("long").alias("contentId"), source.alias("source"), author.alias("author"), tradition.alias("tradition"), url.alias("sourceUrl")), {"ignoreNullFields": "false"})


def citation_of(json: Column) -> Column:
    """The citation in a JSON text, a struct of nulls for anything else."""
    return F.from_json(json, CITATION)


def last_seen(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Of rows with the same key the one that stands last; max_by combines in each task, so a key that many share is a row a task."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("__row")).select(*key, "__row.*")


def ordinal_titles(rows: DataFrame, group: list[str], title: str, order: list[str]) -> DataFrame:
    """A title that a group has several times gets its number from the second on: `Psalm (2)`."""
    nth = F.row_number().over(Window.partitionBy(*group, title).orderBy(*order))
    return rows.withColumn("__nth", nth).withColumn(title, F.when(F.col("__nth") > 1, F.format_string("%s (%d)", F.col(title), F.col("__nth"))).otherwise(F.col(title))).drop("__nth")


def kind_place(kind: Column, *order: str) -> Column:
    """Where a kind stands in an order of kinds; kinds that are not in it come behind, all alike."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), kind), F.lit(0)) + F.when(kind.isin(*order), 0).otherwise(len(order) + 1)


def shelved(works: DataFrame, pinned: Column, first: Column, *order: str) -> DataFrame:
    """Works for a shelf: pinned ones, then those of the kind that leads, then in the order given, as a column `shelf` and sorted."""
    place = F.when(pinned, 0).when(first, 1).otherwise(2)
    return works.withColumn("shelf", place).orderBy("shelf", *order)


def opened(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Where readers land in a work. requests: request, source, wanted (a unit or null), at (a place from 0 or null), resume (the place last read or null).

    A unit of the work that is wanted comes first, then the place, then where reading stopped, else the
    beginning; places are clamped to the work. Returns request, place, unit_id, previous and next (-1 for
    none). Requests for works without units have no row. Units of works that nobody asks for drop out
    before they are put in order.
    """
    asked = units.join(requests.select("source").distinct(), "source", "left_semi")
    order = Window.partitionBy("source").orderBy("sequence", "unit_id")
    rows = asked.select("source", "unit_id", (F.row_number().over(order) - 1).alias("place"), F.coalesce(F.lag("unit_id").over(order), F.lit(-1)).alias("previous"), F.coalesce(F.lead("unit_id").over(order), F.lit(-1)).alias("next"))
    sizes = asked.groupBy("source").agg(F.count("*").alias("n"))
    known = rows.select("source", F.col("unit_id").alias("wanted"), F.col("place").alias("found"))
    landing = F.coalesce("found", "at", "resume", F.lit(0))
    wished = requests.join(known, ["source", "wanted"], "left").join(sizes, "source").select("request", "source", F.greatest(F.lit(0), F.least(landing, F.col("n") - 1)).cast("int").alias("place"))
    return wished.join(rows, ["source", "place"]).select("request", "place", "unit_id", "previous", "next")
