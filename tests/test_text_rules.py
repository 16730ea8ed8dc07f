"""Character references, WordPiece and unique keys against plain versions of the same rules."""

import html
import random
from html.entities import html5

import pytest

from quillspark.functions.entities import unescaped
from quillspark.functions.text import strip_tags
from quillspark.functions.wordpiece import Pieces, encode
from quillspark.sources import snapshots


def test_every_reference_as_the_standard_library_has_it(spark):
    numbers = [0, 1, 9, 13, 31, 65, 127, 128, 129, 150, 159, 160, 0x2014, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12]
    texts = [f"a &{n} b" for n in html5] + [f"&{n}x;&{n}" for n in html5 if not n.endswith(";")]
    texts += [f"x&#{n};y&#x{n:x}z&#X{n:X};" for n in numbers] + ["&", "&&amp;", "&#;", "&#x;", "&nosuch;", "&amp;lt;", "&notit;", "&#0065;", "a & b", "", "&#" + "9" * 40 + ";", "&amp" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    for row in df.withColumn("u", unescaped(df.t)).collect():
        assert row.u == (None if row.t is None else html.unescape(row.t)), row.t


def test_tags_stripped_with_any_reference(spark):
    df = spark.createDataFrame([("<p>a&nbsp;&mdash; b<br>&copy 1885 &#8217;</p>",)], "t string")
    assert df.select(strip_tags(df.t)).first()[0] == "a — b © 1885 ’"


def _plain(text, vocabulary, most):
    """Slices looked up one by one over marks that are taken from the text character by character."""
    bare = dict(zip("áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucnyy"))
    words, own = [], ""
    for c in text.lower():
        n = ord(c)
        if n == 0xFFFD or n < 32 and c not in "\t\n\r":
            continue
        sign = 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or 0x2000 <= n <= 0x206F
        if sign or c in " \t\n\r":
            words += [own] * bool(own) + [c] * sign
            own = ""
        else:
            own += bare.get(c, c)
    ids = []
    for word in words + [own] * bool(own):
        got, at = [], 0
        while at < len(word) <= 100:
            ends = [e for e in range(at + 1, len(word) + 1) if ("##" * bool(at) + word[at:e]) in vocabulary]
            if not ends:
                break
            got.append(vocabulary["##" * bool(at) + word[at : ends[-1]]])
            at = ends[-1]
        ids += got if at == len(word) else [vocabulary["[UNK]"]]
    return [vocabulary["[CLS]"], *ids[: most - 2], vocabulary["[SEP]"]]


def test_wordpiece_on_a_thousand_texts():
    rng = random.Random(3)
    letters = "abcé"
    pieces = {p for _ in range(60) for p in ["".join(rng.choice("abce") for _ in range(rng.randint(1, 4)))]}
    v = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", *sorted(pieces), *sorted("##" + p for p in list(sorted(pieces))[:40]), "5", "##€", "!", "—", "a#"])}
    tries = Pieces(v)
    for _ in range(1000):
        text = "".join(rng.choice([*letters * 4, " ", "\t", "!", "€", "5", "—", "\x01", "�", " ", "É", "#"]) for _ in range(rng.randint(0, 120)))
        assert tries.encode(text, 40) == _plain(text, v, 40)
    assert encode("5€", v) == [1, v["5"], v["##€"], 2]


def test_publish_refuses_keys_that_repeat(spark, tmp_path):
    root, twice = f"file://{tmp_path}", spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")
    for dry in (True, False):
        with pytest.raises(ValueError, match="units: keys"):
            snapshots.publish(spark, root, {"units": twice}, 1, "m", dry_run=dry, keys={"units": ["id"]})
    assert snapshots.current(spark, root) == 0
    assert snapshots.publish(spark, root, {"units": twice}, 1, "m", keys={"units": ["id", "x"]}) == 1
