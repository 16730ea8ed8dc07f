"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

1. Candidates: matches of the patterns below, each with the text just before and after it. Matches
   of the four base kinds that pass their check (parts, Luhn, digits) are personal data whatever
   follows; those that fail it stay candidates, beside names, national phone and identity numbers.
2. Three labelers vote yes, no or nothing on every candidate of every kind, each from something the
   others don't read: the span's structure (regex: checksums, ranges, number plans, what a name begins
   with), lists (gazetteer: top-level domains, networks, issuers, calling codes, area codes, countries,
   names), and cue words around the span (context: the kind's own, another kind's, or such as speak
   of part numbers and versions).
3. Expectation-maximisation over the counts of vote patterns (kinds x 27 at most, whatever the
   input) estimates how reliable each labeler is and how likely each pattern is personal data.
4. These likelihoods train a naive Bayes classifier over the spans' own features; spans that it
   puts at one half or more and that overlap no base span are added to the base spans. Base spans of a
   kind are in order and apart, so a binary search for each kind tells whether a span overlaps one.

Everything is DataFrame expressions in one narrow pass over the texts: a document never leaves its
row, so no key can be hot. The patterns are rewritten with possessive groups and look-behinds that
give the same matches in linear time. Positions are code points, counted by splitting a text at its
matches and adding up lengths.

Defined results: a null or empty text has no spans; rows that repeat a doc_id are rows of their own;
a null doc_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "national_phone", "ssn", "iban", "secret")
LABELERS = ("v_regex", "v_gazetteer", "v_context")
FEATURES = ("shape", "regex", "context", "gazetteer", "length", "digits", "left", "right")
#: Characters of context before and after a span.
BEFORE, AFTER = 40, 20
ROUNDS = 30

# The base patterns match what their definitions match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "name": r"\b(?=\p{{Lu}})(?:{titles}|{given})\.? [\p{{Lu}}][\p{{Ll}}]+(?: [\p{{Lu}}][\p{{Ll}}]+)?",
    "national_phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9][A-Z0-9]{0,2})?\b",
    "secret": r"(?<![A-Za-z0-9_/+=.@-])(?:(?:AKIA|ghp_|gho_|sk-|xoxb-|xoxp-|AIza)[A-Za-z0-9_-]{16,}+|[A-Za-z0-9_/+-]{32,128}+={0,2})(?![A-Za-z0-9_/+=.@-])",
}
#: What a text must hold for a match of a kind, cheaper to look for: only such a text is taken apart.
NEEDED = {
    "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "national_phone": r"[0-9][.-][0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}",
}
# Word lists and number plans.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Herr|Frau|Sr|Sra"
GIVEN = "John|Mary|James|Anna|Peter|Paul|Maria|Jean|Pierre|Marie|Claire|Luc|Hans|Klaus|Anke|Heidi|Jürgen|Carlos|Juan|José|Ana|Lucía|Carmen|Robert|Michael|William|David|Richard|Thomas|Charles|Daniel|Elizabeth|Susan|Sarah|Karen|Nancy|Laura|Emma|Julia|Martin|Andreas|Stefan|Wolfgang|Ursula|Monika|Sabine|François|Philippe|Nicolas|Isabelle|Sophie|Camille|Antonio|Francisco|Manuel|Miguel|Pablo|Isabel|Elena|Rosa".split("|")
SURNAMES = "Smith|Johnson|Williams|Brown|Jones|Miller|Davis|Wilson|Anderson|Taylor|Moore|Jackson|White|Harris|Clark|Lewis|Walker|Hall|Young|King|Wright|Green|Baker|Adams|Nelson|Carter|Müller|Schmidt|Schneider|Fischer|Weber|Meyer|Wagner|Becker|Schulz|Hoffmann|Koch|Bauer|Richter|Klein|Wolf|Neumann|Schwarz|Martin|Bernard|Dubois|Durand|Leroy|Moreau|Simon|Laurent|Lefebvre|Michel|Garcia|García|Martínez|López|Sánchez|Pérez|Gómez|Fernández|Díaz|Moreno|Romero|Torres|Ruiz|Ramos".split("|")
NOT_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Street|Avenue|University".split("|")
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|fr|es|it|uk|us|eu|ch|at|nl|be|pl|se|no|dk|fi|pt|br|mx|ar|cl|co|ca|au|nz|jp|cn|in|kr|ru"
NO_DOMAINS = "example|test|invalid|localhost|local"
LOCAL_NETWORKS = r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
ISSUERS = "^(?:4|5[0-9]|2[2-7]|3[0-9]|6011|6[2-5])"
CALLING_CODES = r"^(?:1|7|20|21[12368]|2[2-6][0-9]|27|29[0189]|3[0-469]|3[578][0-9]|4[013-9]|42[013]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|85[02356]|88[068]|9[0-58]|9[67][0-9]|99[2-68])"
TOLL_FREE = "800|833|844|855|866|877|888|900"
AREAS = "202|203|206|212|213|214|215|216|217|301|303|305|310|312|313|314|315|323|347|404|408|410|412|414|415|416|469|503|504|510|512|514|516|602|604|612|613|614|615|617|619|626|646|650|702|703|704|713|718|773|801|804|808|813|816|818|832|847|858|904|907|914|916|917|919|925|949|954|972"
VOID_NUMBERS = "078-05-1120|219-09-9999|123-45-6789|111-11-1111|999-99-9999"
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|BH|BR|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|KW|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|QA|RO|SA|SE|SI|SK|SM|TR|UA"
KEY_PREFIXES = "^(?:AKIA|ghp_|gho_|sk-|xoxb-|xoxp-|AIza)"
PLACEHOLDERS = "(?i)example|sample|placeholder|your|dummy|test|0{8}|x{8}|12345678"
CUES = {
    "email": r"e-?mail|mail|contact|courriel|correo|write to",
    "ip": r"ip|host|server|address|ssh|ping|login",
    "card": r"card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte",
    "phone": r"tel|phone|call|fax|mobile|whatsapp|cell|téléphone|telefon|teléfono",
    "national_phone": r"tel|phone|call|fax|mobile|whatsapp|cell|téléphone|telefon|teléfono",
    "name": r"name|dear|signed|sincerely|contact|author|von|por|monsieur|madame",
    "ssn": r"ssn|social security|tax id|sin",
    "iban": r"iban|account|bank|konto|cuenta|compte|bic|swift",
    "secret": r"token|secret|password|passwd|pwd|api[ _-]?key|apikey|access[ _-]?key|credentials?|bearer|auth",
}
NOT_CUES = r"(?i)\b(?:version|release|isbn|issn|section|figure|table|chapter|page|order|invoice|item|sku|serial|hash|sha1|sha256|md5|digest|checksum|commit|build)\b"

PATTERNS["name"] = PATTERNS["name"].format(titles=TITLES, given="|".join(GIVEN))


def _column(kind: str, text: Column) -> tuple[Column, Column]:
    """The matches of a kind, and of each piece of text between them: length, end and beginning."""
    pattern = PATTERNS[kind]
    possible = {"email": text.contains("@"), "phone": text.contains("+"), "name": text.rlike(pattern)}.get(kind, text.rlike("[0-9]"))
    if kind in NEEDED:
        possible = possible & text.rlike(NEEDED[kind])
    piece = lambda s: F.struct(F.length(s).cast("long").alias("n"), F.right(s, F.lit(BEFORE)).alias("tail"), F.left(s, F.lit(AFTER)).alias("head"))
    hits = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = F.when(possible, F.transform(F.split(text, pattern, -1), piece))
    return hits.alias(f"hit_{kind}"), pieces.alias(f"piece_{kind}")


def _barrier(df: DataFrame, keep: list[str], columns: list[Column]) -> DataFrame:
    """df with columns that are computed once a row, however often later expressions name them."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def _steps(kind: str) -> Column:
    """How far each match starts behind the start of the one before it."""
    return F.expr(f"transform(hit_{kind}, (h, i) -> piece_{kind}[i].n + if(i > 0, length(hit_{kind}[i - 1]), 0))").alias(f"step_{kind}")


def _blocks(kind: str) -> Column:
    """Sums of 128 steps each, so that a start adds up few numbers even in a text of many matches."""
    s = f"step_{kind}"
    return F.expr(f"if(size({s}) = 0, array(), transform(sequence(0, (size({s}) - 1) div 128), b -> aggregate(slice({s}, b * 128 + 1, 128), 0L, (a, x) -> a + x)))").cast("array<bigint>").alias(f"block_{kind}")


_MOD_97 = "aggregate(sequence(1, length(translate(h, ' ', ''))), 0, (a, k) -> if(substr(_turned, k, 1) between '0' and '9', (a * 10 + ascii(substr(_turned, k, 1)) - 48) % 97, (a * 100 + ascii(substr(_turned, k, 1)) - 55) % 97))"
_MOD_97 = _MOD_97.replace("_turned", "concat(substr(translate(h, ' ', ''), 5), substr(translate(h, ' ', ''), 1, 4))")
_SHAPE = {  # (worth a vote at all, passes its check), over the matched text h
    "email": ("true", "true"),
    "ip": ("true", r"forall(split(h, '[.]'), p -> length(trim(LEADING '0' FROM p)) < 3 or (length(trim(LEADING '0' FROM p)) = 3 and trim(LEADING '0' FROM p) <= '255'))"),
    "card": (
        "length(translate(h, ' -', '')) between 14 and 19",
        "aggregate(sequence(1, length(translate(h, ' -', ''))), 0, (a, k) -> a + (ascii(substr(translate(h, ' -', ''), -k, 1)) - 48) * (2 - k % 2) - if(k % 2 = 0 and ascii(substr(translate(h, ' -', ''), -k, 1)) > 52, 9, 0)) % 10 = 0",
    ),
    "phone": ("true", "length(translate(h, '+ ().-', '')) between 10 and 15"),
    "name": ("true", f"if(h rlike '^(?:{TITLES})[. ]', true, cast(null as boolean))"),
    "national_phone": ("true", "regexp_replace(h, '[^0-9]', '') rlike '^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{6}$'"),
    "ssn": ("true", "substr(h, 1, 3) not in ('000', '666') and substr(h, 1, 1) <> '9' and substr(h, 5, 2) <> '00' and substr(h, 8, 4) <> '0000'"),
    "iban": ("length(translate(h, ' ', '')) between 15 and 34", f"{_MOD_97} = 1"),
    # letters and digits by turns; one case and a usual length is a digest as likely as a key
    "secret": ("h rlike '[0-9]' and h rlike '[A-Za-z]'", "case when h rlike '^[A-Za-z]+[0-9]{0,4}$' or h rlike '(.)\\\\1{7}' or h rlike '/.*/' then false when h rlike '[a-z]' and h rlike '[A-Z]' then true end"),
}


def _spans(kind: str) -> Column:
    """Candidates of a kind: where they are, what stands around them, and whether their check passes."""
    worth, passes = _SHAPE[kind]
    start = f"aggregate(slice(block_{kind}, 1, i div 128), 0L, (a, x) -> a + x) + aggregate(slice(step_{kind}, i div 128 * 128 + 1, i % 128 + 1), 0L, (a, x) -> a + x)"
    made = f"if({worth}, named_struct('kind', '{kind}', 'start', {start}, 'size', length(h), 'text', h, 'before', piece_{kind}[i].tail, 'after', piece_{kind}[i + 1].head, 'passes', {passes}), null)"
    return F.expr(f"filter(transform(hit_{kind}, (h, i) -> {made}), s -> s is not null)")


def _voted(s: Column) -> Column:
    """A candidate with the votes of the labelers and the features of the classifier."""
    yes, no, around = F.lit(1), F.lit(0), F.concat_ws(" ", s["before"], s["after"])
    of = lambda kind: s["kind"] == kind
    text, any_of = s["text"], lambda words: r"\b(?:" + "|".join(words) + r")\b"
    number = F.regexp_replace(text, "[^0-9]", "")
    listed = (
        F.when(of("email"), F.when(text.rlike(rf"(?i)[.](?:{NO_DOMAINS})$|@(?:{NO_DOMAINS})[.]"), no).when(text.rlike(rf"(?i)[.](?:{DOMAINS})$"), yes))
        .when(of("ip"), F.when(text.rlike(LOCAL_NETWORKS), no).otherwise(yes))
        .when(of("card"), F.when(number.rlike(ISSUERS), yes).otherwise(no))
        .when(of("phone"), F.when(number.rlike(CALLING_CODES), yes).otherwise(no))
        .when(of("name"), F.when(text.rlike(any_of(NOT_NAMES)), no).when(F.regexp_replace(text, r"^\S+ ", "").rlike(any_of([*GIVEN, *SURNAMES])), yes))
        .when(of("national_phone"), F.when(number.rlike(f"^(?:{TOLL_FREE})"), no).when(number.rlike(f"^(?:{AREAS})"), yes))
        .when(of("ssn"), F.when(text.isin(*VOID_NUMBERS.split("|")), no).when(text < "773", yes).otherwise(no))
        .when(of("iban"), F.when(text.rlike(f"^(?:{IBAN_COUNTRIES})"), yes).otherwise(no))
        .when(of("secret"), F.when(text.rlike(PLACEHOLDERS), no).when(text.rlike(KEY_PREFIXES), yes))
    )
    own = F.lit(None).cast("boolean")
    for kind, cues in CUES.items():
        own = F.when(of(kind), around.rlike(rf"(?i)\b(?:{cues})\b")).otherwise(own)
    others = around.rlike(r"(?i)\b(?:" + "|".join(dict.fromkeys("|".join(CUES.values()).split("|"))) + r")\b")
    votes = {
        "v_regex": F.when(s["passes"], yes).when(~s["passes"], no),
        "v_gazetteer": listed,
        "v_context": F.when(own, yes).when(around.rlike(NOT_CUES) | others, no),
    }
    digits = F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
    side = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "blank").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\p{L}"), "letter").otherwise("other")
    said = lambda v: F.coalesce(v.cast("string"), F.lit("-"))
    values = [s["kind"], said(votes["v_regex"]), said(votes["v_context"]), said(votes["v_gazetteer"]), F.least(F.lit(10), F.floor(s["size"] / 4)).cast("string"), F.round(10 * digits / s["size"]).cast("int").cast("string"), side(F.right(s["before"], F.lit(1))), side(F.left(s["after"], F.lit(1)))]
    return F.struct(
        s["kind"].alias("kind"),
        s["start"].alias("start"),
        (s["start"] + s["size"]).alias("end"),
        s["text"].alias("text"),
        (s["kind"].isin(*BASE) & F.coalesce(s["passes"], F.lit(False))).alias("base"),
        *(v.alias(k) for k, v in votes.items()),
        F.array(F.concat(F.lit("shape="), s["kind"]), *(F.concat(s["kind"], F.lit(f" {name}="), v) for name, v in zip(FEATURES[1:], values[1:]))).alias("features"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array `candidates` of every row."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    names = lambda *prefixes: [f"{p}_{k}" for p in prefixes for k in KINDS]
    df = _barrier(df, ["doc_id"], [c for k in KINDS for c in _column(k, F.col("text"))])
    df = _barrier(df, ["doc_id", *names("hit", "piece")], [_steps(k) for k in KINDS])
    df = _barrier(df, ["doc_id", *names("hit", "piece", "step")], [_blocks(k) for k in KINDS])
    df = _barrier(df, ["doc_id"], [F.flatten(F.array(*(_spans(k) for k in KINDS))).alias("found")])
    return df.select("doc_id", F.transform("found", _voted).alias("candidates"))


def reliabilities(patterns: list[tuple[str, tuple, int]], rounds: int = ROUNDS) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """EM over (kind, votes, count): how likely a kind is personal data; for each labeler P(yes | personal) and P(yes | not).

    Two classes, labelers independent within a class, votes of None ignored; each estimate starts
    from, and is smoothed by, the belief that a labeler errs once in five times.
    """
    prior = {kind: 0.5 for kind, _, _ in patterns}
    rates = [(0.8, 0.2)] * len(LABELERS)
    for _ in range(rounds):
        share = {kind: [1.0, 2.0] for kind in prior}
        sums = [[[1.6, 2.0], [0.4, 2.0]] for _ in LABELERS]
        for kind, votes, n in patterns:
            p = posterior(prior[kind], rates, votes)
            share[kind][0] += n * p
            share[kind][1] += n
            for k, v in enumerate(votes):
                if v is not None:
                    for c, weight in enumerate((n * p, n * (1 - p))):
                        sums[k][c][0] += weight * v
                        sums[k][c][1] += weight
        prior = {kind: a / b for kind, (a, b) in share.items()}
        rates = [tuple(a / b for a, b in s) for s in sums]
    return prior, rates


def posterior(prior: float, rates: list[tuple[float, float]], votes: tuple) -> float:
    odds = math.log(prior) - math.log(1 - prior)
    for (yes, no), v in zip(rates, votes):
        if v is not None:
            odds += math.log(yes if v else 1 - yes) - math.log(no if v else 1 - no)
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))


def classifier(found: DataFrame, rounds: int = ROUNDS) -> tuple[float, dict[str, float]]:
    """Bias and weights of features: log odds, from aggregates whose size does not follow the input."""
    spans = found.select(F.explode("candidates").alias("s"))
    counts = spans.groupBy("s.kind", *(f"s.{v}" for v in LABELERS)).count().collect()
    patterns = [(r[0], tuple(r[1:-1]), r[-1]) for r in counts]
    if not patterns:
        return 0.0, {}
    prior, rates = reliabilities(patterns, rounds)
    key = F.concat_ws("|", F.col("s.kind"), *(F.coalesce(F.col(f"s.{v}").cast("string"), F.lit("-")) for v in LABELERS))
    likely = {"|".join([kind, *("-" if v is None else str(v) for v in votes)]): posterior(prior[kind], rates, votes) for kind, votes, _ in patterns}
    p = F.element_at(_map(likely), key)
    sums = spans.select(p.alias("p"), F.explode("s.features").alias("feature")).groupBy("feature").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()
    kinds = {r[0].partition("=")[2]: (r[1] + 1.0, r[2] + 1.0) for r in sums if r[0].startswith("shape=")}
    yes, no = (sum(x[k] for x in kinds.values()) for k in (0, 1))
    weights = {}
    for feature, a, b in sums:  # within the kind, but for the kind itself; smoothing pulls a rare one towards no evidence
        of_yes, of_no = (yes, no) if feature.startswith("shape=") else kinds[feature.partition(" ")[0]]
        share = of_yes / (of_yes + of_no)
        weights[feature] = math.log((a + 2 * share) / of_yes) - math.log((b + 2 * (1 - share)) / of_no)
    return math.log(yes) - math.log(no), weights


def _map(values: dict[str, float]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.lit(float(v)) for v in values.values())))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, `base` and `spans` of every row: arrays of kind, start, end and text, by start and kind."""
    found = materialize(candidates(docs), "pii-candidates")
    bias, weights = classifier(found)
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    plain = lambda s: F.struct(s["start"].alias("start"), order(s).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))
    table_ = _map(weights or {"": 0.0})
    score = lambda s: F.aggregate(s["features"], F.lit(bias), lambda a, f: a + F.coalesce(F.try_element_at(table_, f), F.lit(0.0)))
    ranges = lambda kind: F.transform(F.filter("candidates", lambda b: b["base"] & (b["kind"] == kind)), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias(f"base_{kind}")
    found = _barrier(found, ["doc_id", "candidates"], [F.filter("candidates", lambda s: s["base"]).alias("plain"), *map(ranges, BASE)])
    free = lambda s: ~reduce(Column.__or__, (_overlaps(s, F.col(f"base_{kind}")) for kind in BASE))
    added = F.filter("candidates", lambda s: F.when(~s["base"] & (score(s) >= 0), free(s)).otherwise(False))
    return found.select("doc_id", F.array_sort(F.transform("plain", plain)).alias("base"), F.array_sort(F.transform(F.concat("plain", added), plain)).alias("spans"))


def _overlaps(s: Column, ranges: Column) -> Column:
    """Whether a span overlaps one of some ranges that are in order and apart, by a binary search for the last that begins before its end."""
    def step(at: Column, bit: Column) -> Column:
        to = at + F.call_function("shiftleft", F.lit(1), bit)
        return F.when((to <= F.size(ranges)) & (ranges[to - 1]["start"] < s["end"]), to).otherwise(at)

    last = F.aggregate(F.sequence(F.lit(24), F.lit(0), F.lit(-1)), F.lit(0), step)
    return F.when(F.size(ranges) > 0, F.coalesce(F.try_element_at(ranges, F.nullif(last, F.lit(0)))["end"] > s["start"], F.lit(False))).otherwise(False)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


#: Positions of matches and the estimates are beyond SQL; tests compare with plain regular expressions.
SQL: dict = {}
