"""Personal data by patterns, checksums and context words, in DataFrame expressions only.

A pattern proposes spans; a validator (digit counts, octet range, Luhn, mod-97) confirms
them; words within CONTEXT_CHARS before a span raise its score. The four base kinds are kept
whatever their score; the added kinds (``iban``, and ``local_phone``: a number without
country prefix) are kept from SCORE_MIN on, which a local number reaches by context only.

Patterns are written so that Java's matcher takes linear time on any text: runs are
possessive, and a match can't begin inside a run that has been tried from its start
(``\\G`` allows it just behind the previous match).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTEXT_CHARS = 30
SCORE_MIN = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")
#: Matches of a text that are gone through together, at least.
BLOCK_LEAST = 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    terms = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int"))))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(13, 19), _luhn(m)).otherwise(False)


def _octets(m: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 4) & (F.concat(F.lit("0"), F.substring(bare(p), 1, 3)).cast("int") <= 255))


def _mod97(m: Column) -> Column:
    packed = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(packed, 5, 99), F.substring(packed, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _count_between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this has no match (a cheap test before the pattern).
    needs: str
    valid: Callable[[Column], Column]
    score: float
    context: str


#: Characters of an IBAN by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HN=28, HR=21, HU=28, IE=22, IL=23, IQ=23,
    IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18, NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27,
    SO=23, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30,
)


def _iban() -> str:
    """Each country's code, two digits and as many more characters as its numbers have, single spaces between them."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    each = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{each})(?![A-Za-z0-9])"


def _run(of: str) -> str:
    return rf"(?:(?<!{of})|\G){of}++"


KINDS = (
    Kind("email", _run("[A-Za-z0-9._%+-]") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: m.isNotNull(), 0.6, r"mail|contact|write|courriel|correo|kontakt"),
    Kind("ip", _run("[0-9]") + r"(?:\.[0-9]++){3}", ".", _octets, 0.6, r"\bip\b|host|server|address|adresse|direcci"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++", "", _card, 0.8, r"card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _count_between(9, 15), 0.6, r"phone|tel|call|mobile|fon|llama"),
    Kind("iban", _iban(), "", _mod97, 0.8, r"iban|bank|konto|cuenta|compte"),
    Kind("local_phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z.-])", "", _count_between(8, 12), 0.3, r"\b(?:tele)?phone|\btel\b|\bcall\b|\bmobile\b|telefon|tel[eé]fono|t[eé]l[eé]phone"),
)
NONE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), in which value is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_blocks(items: Column, first: Column, carry: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """What ``fold`` makes of each block of consecutive items, one array after the other.

    A fold that lists what it finds copies the list at every item, so long arrays are cut into
    blocks of about the root of their length: fold(block, state before it) returns an array,
    carry(state, block) is the state behind it.
    """

    def states(blocks: Column) -> Column:
        begin = F.struct(first.alias("now"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(blocks, begin, lambda a, x: F.struct(carry(a["now"], x).alias("now"), F.array_append(a["out"], a["now"]).alias("out")), lambda a: a["out"])

    def cut(c: Column) -> Column:
        each = F.greatest(F.lit(BLOCK_LEAST), F.ceil(F.sqrt(F.size(c)))).cast("int")
        blocks = _let(each, lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(c), F.lit(1)) - 1) / b).cast("int")), lambda k: F.slice(c, k * b + 1, b)))
        return _let(blocks, lambda x: F.flatten(F.zip_with(x, states(x), fold)))

    return _let(items, cut)


def _spans(kind: Kind, text: str) -> Column:
    """array<struct<kind, start, end, score>> in text order; offsets are code points."""
    needs = F.col(text).contains(kind.needs) if kind.needs else F.lit(True)
    found = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"))
    last = lambda s: F.right(s, F.lit(CONTEXT_CHARS))

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["gap"])
        near = last(F.concat(a["tail"], x["gap"]))
        return _let(F.struct(start.alias("start"), (a["pos"] + x["size"]).alias("end"), near.alias("near"), (F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), 0.2).otherwise(0.0)).alias("score")), lambda v: after(a, x, v))

    def after(a: Column, x: Column, v: Column) -> Column:
        span = F.struct(F.lit(kind.name).alias("kind"), v["start"].alias("start"), v["end"].alias("end"), v["score"].alias("score"))
        keep = x["ok"] & (F.lit(True) if kind.name in BASE_KINDS else v["score"] >= SCORE_MIN)
        return F.struct(v["end"].alias("pos"), last(F.concat(v["near"], F.coalesce(x["m"], F.lit("")))).alias("tail"), F.when(keep, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    def block(x: Column, at: Column) -> Column:
        tail = F.substring(F.col(text), F.greatest(at - CONTEXT_CHARS, F.lit(0)).cast("int") + 1, F.least(at, F.lit(CONTEXT_CHARS)).cast("int"))
        return F.aggregate(x, F.struct(at.alias("pos"), tail.alias("tail"), F.array().cast(NONE).alias("out")), step, lambda a: a["out"])

    size = lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long")
    checked = F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), F.coalesce(kind.valid(x["m"]), F.lit(False)).alias("ok"), size(x).alias("size")))
    ends = lambda at, x: at + F.aggregate(x, F.lit(0).cast("long"), lambda n, m: n + m["size"])
    return F.when(needs & F.col(text).rlike(kind.pattern), _in_blocks(checked, F.lit(0).cast("long"), ends, block)).otherwise(F.array().cast(NONE))


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """(_row, _text, _spans): the rows of docs as structs, so that no column of theirs can clash."""
    out = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # most texts hold neither a digit nor an @: they skip every pattern
    out = out.withColumn("_any", F.col("_text").rlike("[0-9@]"))
    none = F.array().cast(NONE)
    return out.withColumn("_spans", F.when(F.col("_any"), F.concat(*[_spans(k, "_text") for k in KINDS])).otherwise(none)).drop("_any")


def _own(name: str) -> Column:
    return F.col(f"_row.`{name}`")


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "_spans") -> DataFrame:
    """The rows of docs with one more column, array<struct<kind, start, end, score>>.

    Spans are listed by kind in the order of KINDS, then by start. A null or empty text has
    none; texts are searched whole, whatever their length. Rows, repeated ones too, keep all
    their columns; only a column that is itself called ``spans_col`` is replaced. An IBAN is
    found if its country is one of IBAN_LENGTHS. An empty table gives no rows.
    """
    return _found(docs, text_col).select(*[_own(c).alias(c) for c in docs.columns if c != spans_col], F.col("_spans").alias(spans_col))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one.

    A null text stays null, one without spans as it is. A column ``n_chars``, if there is one,
    is set to the new length where spans were replaced. Rows, repeated ones too, and all other
    columns, whatever their names, stay; an empty table gives no rows.
    """
    found = _found(docs, text_col)
    by_place = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    reach = lambda at, x: F.aggregate(x, at, lambda n, s: F.greatest(n, s["end"]))

    def block(x: Column, at: Column) -> Column:
        """What stands for the text from ``at``, where the blocks before end, to the end of this one."""
        part = F.substring(F.col("_text"), at.cast("int") + 1, (reach(at, x) - at).cast("int"))
        return _let(part, lambda t: F.aggregate(x, F.struct(at.alias("pos"), F.array().cast("array<string>").alias("out")), lambda a, s: put(a, s, t, at), lambda a: a["out"]))

    def put(a: Column, s: Column, part: Column, at: Column) -> Column:
        gap = F.substring(part, (a["pos"] - at).cast("int") + 1, F.greatest(s["start"] - a["pos"], F.lit(0)).cast("int"))
        out = F.when(s["start"] < a["pos"], a["out"]).otherwise(F.array_append(a["out"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), out.alias("out"))

    zero = F.lit(0).cast("long")
    rest = F.substring(F.col("_text"), F.array_max(F.transform("_spans", lambda s: s["end"])).cast("int") + 1, F.length("_text"))
    new = F.concat(F.array_join(_in_blocks(by_place, zero, reach, block), ""), rest)
    new = F.when(F.size("_spans") > 0, new).otherwise(_own(text_col))
    out = found.select("_row", "_spans", new.alias("_new"))
    length = F.when(F.size("_spans") > 0, F.length("_new").cast("long"))
    made = lambda c: F.col("_new") if c == text_col else F.coalesce(length, _own(c)) if c == "n_chars" else _own(c)
    return out.select(*[made(c).alias(c) for c in docs.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("_spans")).alias("spans"))
