"""Topic tags: keywords in units, phrases in questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keyword in a unit -> tag.
UNIT_KEYWORDS = {
    "trinity": "trinity", "incarnation": "incarnation", "christology": "christology", "salvation": "salvation", "grace": "grace", "baptism": "baptism",
    "eucharist": "eucharist", "sin": "sin", "justification": "justification", "faith": "faith", "prayer": "prayer", "church": "church",
    "scripture": "scripture", "creation": "creation", "sanctification": "sanctification", "worship": "worship", "sacrament": "sacraments", "angel": "angels",
    "resurrection": "eschatology", "judgment": "last-judgment", "holy spirit": "holy-spirit",
}
# Phrase in a question -> tags.
QUESTION_PHRASES = {
    "angel": ["angels"], "atonement": ["salvation", "christology"], "baptism": ["baptism"], "christology": ["christology"], "church": ["church"],
    "communion": ["eucharist", "sacraments"], "creation": ["creation"], "ecclesiology": ["church"], "eschatology": ["eschatology"], "eucharist": ["eucharist"],
    "faith": ["faith"], "free will": ["grace", "salvation"], "grace": ["grace"], "heaven": ["eschatology"], "hell": ["eschatology", "last-judgment"],
    "holiness": ["sanctification"], "holy spirit": ["holy-spirit"], "incarnation": ["incarnation"], "judgment": ["last-judgment"], "justification": ["justification"],
    "liturgy": ["worship"], "lord's supper": ["eucharist", "sacraments"], "mass": ["eucharist"], "pneumatology": ["holy-spirit"], "prayer": ["prayer"],
    "predestination": ["salvation", "grace"], "resurrection": ["eschatology", "christology"], "sacrament": ["sacraments"], "salvation": ["salvation"],
    "sanctification": ["sanctification"], "scripture": ["scripture"], "second coming": ["eschatology"], "sin": ["sin"], "soteriology": ["salvation"],
    "trinity": ["trinity"], "worship": ["worship"],
}
#: How much of a unit the queries look at whose SQL cuts texts.
SCAN = 4000


def _whole(phrase: str) -> str:
    """A phrase as whole words, plural or not; boundaries are those of ASCII words, where \\b follows Unicode."""
    return r"(?i)(?<![A-Za-z0-9_])" + re.escape(phrase).replace("\\ ", " ") + r"(s|es)?(?![A-Za-z0-9_])"


def unit_tags(units: DataFrame, keywords: dict[str, str] = UNIT_KEYWORDS, scan: int | None = None) -> DataFrame:
    """unit_id and slug, a row for each tag of a unit. The whole text is looked at; scan: only its first characters."""
    text = F.concat_ws(" ", "title", "content" if scan is None else F.left("content", F.lit(scan)))
    flags = F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(_whole(k)), slug) for k, slug in keywords.items()))))
    return units.select("unit_id", "source", "tradition", F.explode(flags).alias("slug"))


def question_tags(text: Column, phrases: dict[str, list[str]] = QUESTION_PHRASES) -> Column:
    """Tags that a question's phrases stand for, each once, in order of the phrases."""
    return F.array_distinct(F.flatten(F.array(*(F.when(text.rlike(_whole(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in phrases.items()))))


def search(tags: DataFrame, slugs: list[str]) -> DataFrame:
    """Units by how many of the tags they have; a tag may be written with blanks or capitals."""
    wanted = [s.lower().replace(" ", "-") for s in slugs]
    return tags.where(F.col("slug").isin(wanted)).groupBy("unit_id").agg(F.count("slug").alias("matches"))
