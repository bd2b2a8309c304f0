"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

All of it is column functions. Each pattern is written so that a match attempt
never walks the same characters twice: runs are possessive, and a run is only
tried from its first character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import once, table

CONTEXT = 48        # code points before a span in which context words count
RUN = 256           # matches gathered at once
THRESHOLD = 0.7     # least score of a span that is not a base one


@dataclass(frozen=True)
class Kind:
    """`near`: what any text with a match contains, cheap to test. `context`: words
    that raise the score when they come shortly before. `checksum` says how a span
    is confirmed; a base kind's spans stay whatever their score."""
    name: str
    pattern: str
    near: str
    context: str
    prior: float
    base: bool = True


# The kinds, in their order.
LOCAL = r"[A-Za-z0-9._%+-]"
# Characters of account numbers by country, the first four included.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "DZ IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
# A known country's number ends after its length, whatever follows; another run is taken whole.
ACCOUNT = "|".join([rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}+(?![A-Za-z0-9])" for n, names in LENGTHS.items()]
                   + [r"[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])"])
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]",
         "mail|contact|write to|reach", 0.7),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]",
         "ip|host|server|address|login", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){13,}+", r"[0-9](?:[\x20-]?+[0-9]){13}",
         "card|visa|credit|payment|pan", 0.4),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax", 0.6),
    Kind("iban", rf"(?:\G|(?<![A-Za-z0-9]))(?:{ACCOUNT})", "[A-Z]{2}[0-9]{2}",
         "iban|account|bank|transfer", 0.3, base=False),
    Kind("ssn", r"(?:\G|(?<![0-9-]))[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "ssn|social security|tax id", 0.5, base=False),
)
BASE = [kind.name for kind in KINDS if kind.base]


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def step(total, i):
        digit = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def mod97(found: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and
    letters read as 10 to 35, leaves 1 when divided by 97."""
    plain = F.regexp_replace(found, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, i):
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        letter = code >= 65
        return (rest * F.when(letter, 100).otherwise(10) + code - F.when(letter, 55).otherwise(48)) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def confirmed(kind: Kind, found: Column) -> Column:
    """Null where nothing can confirm a span of this kind, false where it fails."""
    if kind.name == "card":
        return F.length(digits(found)).between(14, 19) & luhn(digits(found))
    if kind.name == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind.name == "phone":
        return F.length(digits(found)).between(10, 15)
    if kind.name == "iban":
        return F.length(F.regexp_replace(found, " ", "")).between(15, 34) & mod97(found)
    return F.lit(None).cast("boolean")


PAIR = "array<struct<gap:int,length:int,sure:boolean,near:boolean>>"
SPAN = "array<struct<start:int,rank:int,end:int,score:double>>"


def proposed(kind: Kind, text: Column) -> Column:
    """Matches of one kind by their length and that of the gap before, confirmed or
    not, near a context word or not.

    Matches and gaps come from one pattern anchored to the end of the match before,
    so positions are running sums of lengths.
    """
    whole = F.lit(rf"\G(?s:(.*?))({kind.pattern})")
    pairs = F.zip_with(F.regexp_extract_all(text, whole, 1), F.regexp_extract_all(text, whole, 2), lambda gap, found: F.struct(
        F.length(gap).alias("gap"), F.length(found).alias("length"), confirmed(kind, found).alias("sure"),
        F.lower(F.right(gap, F.lit(CONTEXT))).rlike(rf"\b(?:{kind.context})").alias("near")))
    return F.when(text.rlike(kind.near), pairs).otherwise(F.array().cast(PAIR))


def spans(kind: Kind, pairs: Column) -> Column:
    """Start, end and score of what is kept of `pairs`, an array worked out before.

    Runs of RUN matches are gathered apart and then joined, so that a text with very
    many does not copy all so far for each.
    """
    empty = F.array().cast(SPAN)

    def place(state, pair):
        start = state["at"] + pair["gap"]
        end = start + pair["length"]
        score = (F.lit(kind.prior) + F.when(pair["sure"], 0.4).otherwise(0.0) + F.when(pair["near"], 0.2).otherwise(0.0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"),
                        F.least(score, F.lit(1.0)).alias("score"))
        keep = F.coalesce(pair["sure"], F.lit(True))
        if not kind.base:
            keep = keep & (score >= THRESHOLD)
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def gather(state, run):
        start = F.struct(state["at"].alias("at"), empty.alias("out"))
        more = F.aggregate(F.slice(pairs, run * RUN + 1, F.lit(RUN)), start, place)
        return F.struct(more["at"].alias("at"), F.concat(state["out"], more["out"]).alias("out"))

    runs = F.sequence(F.lit(0), F.call_function("div", F.size(pairs), F.lit(RUN)).cast("int"))
    return F.aggregate(runs, F.struct(F.lit(0).alias("at"), empty.alias("out")), gather, lambda state: state["out"])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id and `found`, an array of
    (start, rank, end, score) by start and then kind; `rank` counts in KINDS.

    Positions are code points of the whole text, ends exclusive. Within a kind spans
    are the leftmost ones and do not overlap; kinds may overlap each other. Null text
    counts as empty and has none. Other columns are not read, equal rows give equal
    rows, and a text may hold any number of spans.
    """
    text = F.coalesce("text", F.lit(""))
    pairs = F.struct(*(proposed(kind, text).alias(kind.name) for kind in KINDS))
    matched = once(pairs, "_pairs", "doc_id", source=docs.select("doc_id", "text"))
    found = F.array_sort(F.concat(*(spans(kind, F.col(f"_pairs.{kind.name}")) for kind in KINDS)))
    return once(found, "found", "doc_id", source=matched)


def written_spans(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, all spans as text and a digest of the base ones."""
    def count(i):
        return F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long").alias(f"n_{KINDS[i].name}")

    counts = [count(i) for i in range(len(KINDS))]
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *counts[:len(BASE)], F.sha2(written_spans(base), 256).alias("base_sha256"),
                        written_spans(F.col("found")).alias("spans"), *counts[len(BASE):],
                        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def op1_pii(spark, sf_dir):
    return digest(personal_data(table(spark, sf_dir, "documents")))


QUERIES = {"op1_pii": op1_pii}
ORACLE = {}
