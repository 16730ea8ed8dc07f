from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import coverage as V


def test_suggestions(spark):
    contents = spark.createDataFrame(
        [("f1", "author", "John Owen"), ("f1", "title", "Of the Mortification of Sin in Believers"), ("f1", "tradition", "Reformed"), ("f2", "title", "The Second London Baptist Confession of Faith"), ("f2", "tradition", "Baptist"), ("f3", "author", "Martin Luther"), ("f3", "tradition", "Lutheran")],
        "fragment string, kind string, value string",
    )
    members = spark.createDataFrame([("owen", "f1"), ("baptist", "f2"), ("luther", "f3")], "collection string, fragment string")
    tags = spark.createDataFrame([("f1", "last-judgment", 5), ("f3", "last-judgment", 1)], "fragment string, slug string, n long")
    asked = spark.createDataFrame([(1, "What did Owen teach?"), (2, "the second london baptist confession"), (3, "what do Baptists hold"), (4, "what did John say of sin"), (5, "Luther on the end")], "qid int, text string")
    wanted = spark.createDataFrame([(5, "last-judgment")], "qid int, slug string")
    held = spark.createDataFrame([("f3",)], "fragment string")
    got = {(r.qid, r.place): (r.collection, r.reason, r.detail) for r in V.suggest(asked, contents, members, held, tags, wanted).collect()}
    assert got == {
        (1, 1): ("owen", "names_author", "John Owen"),
        (2, 1): ("baptist", "names_work", "The Second London Baptist Confession of Faith"),
        (3, 1): ("baptist", "tradition_absent", "Baptist"),
        (5, 1): ("owen", "covers_subject", "last judgment"),
    }


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("y")).first().y
    assert all(one(T.headingish(F.lit(x))) for x in ("OF THE HOLY SCRIPTURE", "Chapter 4 of grace", "G E N E S I S"))
    assert not any(one(T.headingish(F.lit(x))) for x in ("a line of prose.", "The Immutability of God", "", "X" * 91, "Parting is sorrow"))
    assert one(T.unspaced(F.lit("G E N E S I S"))) == "Genesis" and one(T.unspaced(F.lit("A B plain"))) == "A B plain"
    assert one(T.title_and_body(F.lit("THE FIRST SERMON.\n\nThe Immutability of God\n\nText one.\n\nText two."))) == ("THE FIRST SERMON — The Immutability of God", "Text one.\n\nText two.")
    assert one(T.title_and_body(F.lit("Only a heading"))) == ("", "Only a heading") and one(T.title_and_body(F.lit("It ends.\n\nMore."))) == ("", "It ends.\n\nMore.")
    assert one(T.stream_words(F.lit("Men’s after-\nward equivo-\n g\ncation, a I"))) == ["mens", "afterward", "equivocation"]
    assert one(T.part_noun(F.lit("Homilies and Letters"))) == "Letter"
    assert one(T.sizes_from_headers(F.lit("HTTP/1.1 206\r\nContent-Range: bytes 0-99/12345\r\n"))) == 12345
    assert one(T.reference_apparatus(F.lit("http://a.b/c d"))) and not one(T.reference_apparatus(F.lit("")))
