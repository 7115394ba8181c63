"""Personal data by patterns, checksums and context, in DataFrame functions alone.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped: email; ip (four parts, each at
most 255); card (12 to 19 digits that pass Luhn); phone (9 to 15 digits).  The method adds kind iban
(two letters, two check digits, 11 to 30 more in groups or not, right by mod 97): the country's length where
one is fixed, else the longest that is right; every place where one can begin is tried, leftmost first, and
one that fails hides no other.

Positions come from split(): the pieces between matches alternate with the matches, so running sums of
their lengths (in code points) are the offsets.  Each pattern here takes the same matches as its plain form
in the contract, in linear time: runs are possessive, and a match may begin inside a run of its first class
only right after the match before, since from elsewhere in the run it could succeed only where the run's
first character could.

A span's score is its kind's prior, moved up where one of the kind's words stands within 40 characters
before it, up to 1.  Null and empty texts have no spans (counts 0, digest of the empty string, spans and
scores empty); repeated rows are repeated; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Where an IBAN can begin, and whole groups from there on; the longest is 34 characters with a blank after each but the last.
IBAN_START = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}\x20?[A-Z0-9])"
IBAN_GROUPS = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![A-Za-z0-9])(?:\x20[A-Z0-9]++(?![A-Za-z0-9]))*+"
IBAN_MOST = 68
#: Fixed lengths of countries' IBANs.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: What a text must hold for a pattern to be tried.
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.9}
NEARBY = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|master|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto",
}
REACH, RUN = 40, 256


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    n = F.length(digits)

    def value(d, i):
        d = d.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    values = F.transform(F.split(digits, ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an IBAN's check digits hold: moved to the end, letters from 10 up, the remainder is 1."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 30), F.substring(plain, 1, 4))

    def step(a, c):
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        digits = _only_digits(text)
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_only_digits(text)).between(9, 15)
    return F.lit(True)


def _score(kind: str, before: Column) -> Column:
    near = F.right(before, F.lit(REACH)).rlike(f"(?i){NEARBY[kind]}")
    return F.when(near, F.least(F.lit(1.0), F.lit(PRIOR[kind] + 0.3))).otherwise(F.lit(PRIOR[kind]))


def _ends(lengths: Column) -> Column:
    """Running sums of an array: at each level k a place adds what lies 2**k before it, so n lengths take log2(n) passes."""
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(lengths))).cast("int"), F.lit(0)))
    level = lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    return F.when(F.size(lengths) > 0, F.aggregate(levels, lengths, level)).otherwise(lengths)


def _spans(kind: str, matches: Column, between: Column) -> Column:
    """array<struct<start, kind, end, score>> of the valid matches; matches and between are columns."""
    rank = KINDS.index(kind)
    before = F.slice(between, F.lit(1), F.size(matches))
    ends = _ends(F.zip_with(before, matches, lambda b, m: F.coalesce(F.length(b) + F.length(m), F.lit(0))))
    start = F.zip_with(ends, matches, lambda e, m: e - F.length(m))
    made = F.transform(
        F.arrays_zip(start.alias("s"), matches.alias("m"), before.alias("b")),
        lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), _score(kind, x["b"]).alias("score"), x["m"].alias("text")),
    )
    return F.transform(F.filter(made, lambda x: _valid(kind, x["text"])), lambda x: x.dropFields("text"))


def _ibans(pieces: Column) -> Column:
    """As _spans, from a text cut before each place where an IBAN can begin; some may overlap.  pieces is a column."""
    rank = KINDS.index("iban")
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    sizes = F.transform(pieces, lambda p: F.coalesce(F.length(p), F.lit(0)))
    start = F.zip_with(_ends(sizes), sizes, lambda e, n: e - n)

    def best(i, at):
        """The span that begins with piece i: (start, kind, end, score), null if none is right."""
        # A piece but the first has 5 characters or more, so 20 of them hold the longest.
        window = F.substring(F.array_join(F.slice(pieces, i, 20), ""), 1, IBAN_MOST)
        groups = F.split(F.regexp_extract(window, IBAN_GROUPS, 0), " ")
        fixed = F.try_element_at(lengths, F.substring(window, 1, 2))
        tried = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
        size = lambda x: F.length(F.regexp_replace(x, " ", ""))
        right = F.filter(tried, lambda x: size(x).between(15, 34) & (size(x) == F.coalesce(fixed, size(x))) & _mod97(x))
        before = F.when(i > 1, F.array_join(F.slice(pieces, F.greatest(i - 8, F.lit(1)), F.least(i - 1, F.lit(8))), "")).otherwise(F.lit(""))
        found = F.struct(at.alias("start"), F.lit(rank).alias("kind"), (at + F.length(right[0])).alias("end"), _score("iban", before).alias("score"))
        return F.when(F.size(right) > 0, found)

    return F.filter(F.transform(F.arrays_zip(F.sequence(F.lit(1), F.size(pieces)).alias("i"), start.alias("s")), lambda x: best(x["i"], x["s"])), lambda x: x.isNotNull())


def _apart(spans: Column) -> Column:
    """The spans (a column), by their start, that begin where the kept one before has ended or later.

    Kept ones are gathered RUN at a time, so that no growing array is copied for each of them.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    step = lambda a, x: F.when(x["start"] >= a["end"], F.struct(x["end"].alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    state = lambda end, kept: F.struct(end.alias("end"), kept.alias("kept"))

    def run(a, k):
        own = F.aggregate(F.slice(spans, k * RUN + 1, F.lit(RUN)), state(a["end"], none), step)
        return F.aggregate(F.array(own), a, lambda a, o: state(o["end"], F.concat(a["kept"], F.array(o["kept"]))))

    runs = F.sequence(F.lit(0), F.floor(F.size(spans) / RUN).cast("int"))
    first = state(F.lit(0), F.array().cast("array<array<struct<start:int,kind:int,end:int,score:double>>>"))
    return F.flatten(F.aggregate(runs, first, run)["kept"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end, score>>) in the order of start, then kind."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    empty = F.array().cast("array<string>")
    for kind in BASE:
        hit = F.coalesce(F.col("text").rlike(HINTS[kind]), F.lit(False))
        docs = docs.withColumn(f"_{kind}", F.when(hit, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(empty))
    for kind in BASE:
        docs = docs.withColumn(f"_{kind}_between", F.when(F.size(f"_{kind}") > 0, F.split("text", PATTERNS[kind])).otherwise(empty))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    found = [F.when(F.size(f"_{k}") > 0, _spans(k, F.col(f"_{k}"), F.col(f"_{k}_between"))).otherwise(none) for k in BASE]
    # Columns of their own, as what is written out within a lambda would be worked out anew for each element.
    docs = docs.withColumn("_pieces", F.when(F.coalesce(F.col("text").rlike(HINTS["iban"]), F.lit(False)), F.split("text", IBAN_START)).otherwise(empty))
    docs = docs.withColumn("_ibans", F.when(F.size("_pieces") > 0, _ibans(F.col("_pieces"))).otherwise(none))
    found.append(F.when(F.size("_ibans") > 0, _apart(F.col("_ibans"))).otherwise(none))
    return docs.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """What op8 returns, with n_iban and scores, from find()'s rows."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.filter(spans, lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        count("iban").alias("n_iban"),
        F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))
