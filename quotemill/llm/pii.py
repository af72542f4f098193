r"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges and
digit counts for the rest), and context words near a span raise its score.

Patterns are written so that a scan is linear in the text: a run of characters is tried from its start
only (look-behind, possessive repeats), which changes no match. ``split`` gives the pieces between
matches and ``regexp_extract_all`` the matches, so places are running sums of lengths; those sums are a
window over one text's matches, not a fold over arrays, and stay linear for any number of matches.

Cases: NULL text is empty (no spans); rows that agree in doc_id and text count as one text and get the
same answer, each; a failing proposal is dropped and its characters are not tried again; spans of two
kinds may overlap, spans of one kind never; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed. The first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: What a text must show before the full pattern is tried on it.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
}
#: Score of a confirmed span without context, and what a context word within reach adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.8}
NEARBY, RAISE = 48, 0.2
CONTEXT = {
    "email": r"e-?mail|contact|write|address|@",
    "ip": r"\bip\b|server|host|address|login",
    "card": r"card|visa|master|amex|credit|debit|pay|cvv|expir",
    "phone": r"phone|call|tel\b|mobile|fax|contact|whatsapp",
    "iban": r"iban|account|bank|transfer|konto|swift|bic",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a valid check digit."""
    def step(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and digits) leaves 1 when read as a number modulo 97."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _confirmed(kind: Column, found: Column) -> Column:
    digits = _digits(found)
    n = F.length(digits)
    octets = F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3)
    in_range = F.forall(F.split(found, r"\."), lambda p: F.coalesce(
        F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).cast("int") <= 255)
    return (F.when(kind == "ip", F.when(octets, in_range).otherwise(False))
            .when(kind == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(9, 15))
            .when(kind == "iban", mod97(found))
            .otherwise(True))


def _proposals(kind: str, text: Column) -> Column:
    """Array of (kind, i, gap, found, around): gap is the text length since the match before."""
    pattern = PATTERNS[kind]
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    near = lambda i: F.concat(F.right(F.get(between, i), F.lit(NEARBY)), F.lit(" "),
                              F.left(F.get(between, i + 1), F.lit(NEARBY)))
    rows = F.transform(found, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(between, i)).cast("long").alias("gap"),
        x.alias("found"), near(i).alias("around")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:bigint,found:string,around:string>>")
    return F.when(HINTS[kind](text), rows).otherwise(none)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Confirmed spans: _row (hash of the text; beside doc_id it names the row), doc_id, kind, start, end, value, score.

    Places are code points, end exclusive.
    """
    rows = docs.select(F.xxhash64(text).alias("_row"), F.col(doc_id).alias("doc_id"),
                       F.col(text).alias("_text"))
    hit = reduce(lambda a, b: a | b, (HINTS[k](F.col("_text")) for k in KINDS))
    proposed = (rows.where(hit)
                .select("_row", "doc_id", F.inline(F.concat(*[_proposals(k, F.col("_text")) for k in KINDS])))
                .dropDuplicates(["_row", "doc_id", "kind", "i"]))
    order = Window.partitionBy("_row", "doc_id", "kind").orderBy("i")
    size = F.length("found").cast("long")
    start = (F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
             + F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = proposed.withColumn("start", start).where(_confirmed(F.col("kind"), F.col("found")))
    chosen = lambda values: reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(values[k])), KINDS[1:],
                                   F.when(F.col("kind") == KINDS[0], F.lit(values[KINDS[0]])))
    close = reduce(lambda a, b: a | b, ((F.col("kind") == k) & F.lower("around").rlike(CONTEXT[k]) for k in KINDS))
    return placed.select("_row", "doc_id", "kind", "start", (F.col("start") + size).alias("end"),
                         F.col("found").alias("value"),
                         F.round(chosen(SCORES) + F.when(close, F.lit(RAISE)).otherwise(F.lit(0.0)), 3).alias("score"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, all spans, highest score."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_row = (find_pii(docs).withColumn("rank", rank).groupBy("_row", F.col("doc_id").alias("_id"))
               .agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "kind"))).alias("all"),
                    *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
                    F.max("score").alias("top_score")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_row"))
    base = F.filter("all", lambda s: s["rank"] <= len(BASE))
    joined = rows.join(per_row, (rows["_row"] == per_row["_row"]) & rows["doc_id"].eqNullSafe(per_row["_id"]), "left")
    return joined.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(listed(base), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"), "top_score")
