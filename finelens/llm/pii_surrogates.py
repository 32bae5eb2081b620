"""Keyed, type-consistent surrogates for personal data (native).

Detection is one regular expression over the whole text.  The distinct
mentions of the corpus are parsed into entities (type, canonical form); every
entity gets a surrogate from a keyed SHA-256 stream that keeps its format:
digits stay digits, letters stay letters of the same case and script, a card
number keeps its Luhn status, a name its gender and script.  Surrogates of all
entities are then checked against each other and against all real entities of
the type; losers draw again until none is left, so different entities stay
different and no surrogate is a real entity.  Spellings of one entity (phone
layouts, letter case, a surname alone and with a given name) share it.

Only documents with a mention are joined with the surrogates; the joins are
equi-joins on mention or entity, so a mention of a third of all documents is
one row on one side and splittable on the other.

Defined results
---------------
* persons are found behind a listed title or by a listed given name only; an
  IPv6 address gets a surrogate in 2001:db8::/32, its spellings one surrogate;
* null text stays null, empty text empty, both without mentions;
* repeated rows and rows with null ids are rewritten one by one;
* all columns of the input are kept, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.llm.common import let, plain_names, restored, stored

#: Key of the surrogates; a deployment passes its own.
KEY = "finelens-surrogates"

#: Honorifics and given names by gender (Latin and Cyrillic script).
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Signor|господин|Господин|г-н"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Signora|госпожа|Госпожа|г-жа"
NEUTRAL_TITLES = "Dr|Prof|Professor|Doctor|Mx"
MALE_NAMES = "James|John|Robert|Michael|William|David|Thomas|Hans|Klaus|Jürgen|Pierre|Jean|Carlos|José|Juan|Miguel|Иван|Пётр|Сергей|Алексей"
FEMALE_NAMES = "Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Ursula|Sabine|Marie|Sophie|Camille|María|Carmen|Lucía|Анна|Мария|Ольга|Елена"

_L = r"\p{L}"
# starts of a run only, possessive: linear on a text that is one long run
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}"
_HEX = r"[0-9A-Fa-f]{1,4}"
# eight groups, or :: after a first group of three or four digits (1::2 is a slice, ::1 and fe80:: are nobody's);
# a dotted tail is left to IPV4
IPV6 = (
    rf"(?<![\p{{L}}\p{{N}}.])(?<!\b{_HEX}:)(?<!::)"
    rf"(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,6}}::{_HEX}(?::{_HEX}){{0,5}})"
    r"(?![\p{L}\p{N}]|:[0-9A-Fa-f:]|\.\d)"
)
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
PHONE = (
    r"\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .\-]?\d{2,4}){2,3}(?!\d)"
    r"|(?:\(\d{3}\) ?|(?<![\d\-.])\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"
    # with blanks only as US numbers can be: area and exchange start with 2 to 9, no number before
    r"|(?:\([2-9]\d{2}\) ?|(?<![\d\-.])(?<!\d\d )[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}(?!\d)"
)
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}(?!\d)|(?<!\d)\d{4}[ \-]\d{6}[ \-]\d{4,5}(?!\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SECRET_HEAD = r"""(?i:api[_\-]?key|access[_\-]?key|secret|token|passwd|password)["']?\s{0,3}[:=]\s{0,3}["']?"""
SECRET = SECRET_HEAD + r"[A-Za-z0-9_\-+/]{12,}"
SECRET_BARE = r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![\p{L}\p{N}])"
_TITLES = f"(?:{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES})"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
PERSON_TITLED = rf"(?<!{_L}){_TITLES}\.? {_NAME}(?: {_NAME}){{0,2}}"
PERSON_NAMED = rf"(?<!{_L})(?:{MALE_NAMES}|{FEMALE_NAMES}) {_NAME}"

#: Types in the order in which the detector tries them.
PATTERNS = {
    "secret": f"{SECRET}|{SECRET_BARE}",
    "email": EMAIL,
    "iban": IBAN,
    "card": CARD,
    "phone": PHONE,
    "ssn": SSN,
    "ip": f"{IPV6}|{IPV4}",
    "person": f"{PERSON_TITLED}|{PERSON_NAMED}",
}
PII = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention holds; texts without it skip the detector.
HINT = rf"[0-9@]|::|(?i:secret|token|passw|key)|(?<!{_L})(?:{_TITLES}|{MALE_NAMES}|{FEMALE_NAMES})\.? \p{{Lu}}"

_CONSONANTS, _VOWELS = "bdfgklmnprstv", "aeiou"
_CYR_CONSONANTS, _CYR_VOWELS = "бвдгклмнпрст", "аеиоу"


def type_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def stream(seed: Column, n: Column) -> Column:
    """At least ``n`` bytes, as hex, from SHA-256 in counter mode."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda c: F.sha2(F.concat(seed, F.lit("|"), c.cast("string")), 256))
    return F.array_join(blocks, "")


def byte_at(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("int")


def pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), (b % len(alphabet) + 1).cast("int"), F.lit(1))


def scrambled(value: Column, hexes: Column, hex_only: Column) -> Column:
    """Every letter and digit replaced by one of its kind; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        b = byte_at(hexes, i)
        return (
            F.when(hex_only & c.rlike("^[0-9a-f]$"), pick("0123456789abcdef", b))
            .when(hex_only & c.rlike("^[A-F]$"), pick("ABCDEF", b))
            .when(c.rlike("^[0-9]$"), pick("0123456789", b))
            .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike(r"^\p{IsCyrillic}$"), pick("абвгдежзиклмнопрст", b))
            .when(c.rlike(r"^\p{IsGreek}$"), pick("αβγδεζηθικλμνοπρστ", b))
            .when(c.rlike(r"^\p{Lu}$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(c.rlike(r"^\p{L}$"), pick("abcdefghijklmnopqrstuvwxyz", b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn checksum (0 to 9) of a digit string."""

    def weighted(c: Column, i: Column) -> Column:
        return let(
            c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)
        )

    parts = F.transform(F.split(F.reverse(digits), ""), weighted)
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d) % 10


def card_surrogate(digits: Column, hexes: Column) -> Column:
    """Same first digit and length; the last digit restores the Luhn sum of the original."""
    body = F.concat(F.substring(digits, 1, 1), scrambled(F.expr("substring(canon, 2, length(canon) - 2)"), hexes, F.lit(False)))
    return let(
        body, lambda b: F.concat(b, ((luhn_sum(digits) - luhn_sum(F.concat(b, F.lit("0"))) + 10) % 10).cast("string"))
    )


def name_surrogate(hexes: Column, gender: Column, cyrillic: Column, given: Column, attempt: Column) -> Column:
    """A pronounceable name: keyed syllables, more of them at later attempts, and an ending by gender and script."""
    n = 2 + F.when(given, 0).otherwise(1) + F.floor(attempt / 4).cast("int")

    def syllable(i: Column) -> Column:
        c, v = byte_at(hexes, 2 * i), byte_at(hexes, 2 * i + 1)
        return F.when(cyrillic, F.concat(pick(_CYR_CONSONANTS, c), pick(_CYR_VOWELS, v))).otherwise(
            F.concat(pick(_CONSONANTS, c), pick(_VOWELS, v))
        )

    stem = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), syllable), "")
    latin = F.when(~given, F.lit("ner")).when(gender == "f", F.lit("lla")).when(gender == "m", F.lit("rd")).otherwise(F.lit("n"))
    cyr = F.when(~given, F.when(gender == "f", F.lit("нова")).otherwise(F.lit("нов"))).when(gender == "f", F.lit("на")).otherwise(F.lit("р"))
    return F.concat(stem, F.when(cyrillic, cyr).otherwise(latin))


def surrogate(key: str) -> Column:
    """Surrogate of the entity columns kind, canon, gender at the column attempt."""
    canon, kind = F.col("canon"), F.col("kind")
    seed = F.concat_ws("|", F.lit(key), kind, F.col("gender"), F.col("attempt").cast("string"), canon)
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    longer = F.floor(F.col("attempt") / 4).cast("int")

    def by_kind(h: Column) -> Column:
        # short e-mail names are used up by a large corpus: later attempts add letters
        more = F.when(longer < 1, F.lit("")).otherwise(
            F.array_join(
                F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda i: pick("abcdefghijklmnopqrstuvwxyz", byte_at(h, F.length(canon) + i))), ""
            )
        )
        octet = lambda i: (byte_at(h, F.lit(2 * i)) * 256 + byte_at(h, F.lit(2 * i + 1))) % 254 + 1
        return (
            F.when(kind == "email", F.concat(scrambled(F.substring_index(canon, "@", 1), h, F.lit(False)), more, F.lit("@"), F.substring_index(canon, "@", -1)))
            .when(kind == "domain", F.concat(scrambled(F.regexp_replace(canon, r"\.[^.]+$", ""), h, F.lit(False)), more, F.lit(".example")))
            .when(kind == "card", card_surrogate(canon, h))
            .when(
                (kind == "ip") & canon.contains(":"),
                F.concat_ws(":", F.lit("2001:db8"), *[F.concat(*[pick("123456789abcdef", byte_at(h, F.lit(4 * i + k))) for k in range(4)]) for i in range(6)]),
            )
            .when(kind == "ip", F.concat_ws(".", *[octet(i).cast("string") for i in range(4)]))
            .when(kind == "iban", F.concat(F.substring(canon, 1, 2), scrambled(F.expr("substring(canon, 3)"), h, F.lit(False))))
            .when(kind == "secret", scrambled(canon, h, canon.rlike("^[0-9a-fA-F]+$")))
            .when(
                kind == "phone",
                let(
                    scrambled(canon, h, F.lit(False)),
                    # the country code stays, an area code never starts with 0 or 1
                    lambda s: F.when(
                        canon.startswith("+"),
                        F.concat(
                            F.substring_index(canon, "~", 1), F.lit("~"),
                            pick("23456789", byte_at(h, F.lit(40))),
                            F.substring(F.substring_index(s, "~", -1), 2, 32),
                        ),
                    ).otherwise(F.concat(pick("23456789", byte_at(h, F.lit(40))), F.substring(s, 2, 32))),
                ),
            )
            .when(kind == "ssn", scrambled(canon, h, F.lit(False)))
            .when(kind.isin("given", "surname"), name_surrogate(h, F.col("gender"), cyrillic, kind == "given", F.col("attempt")))
        )

    return let(stream(seed, F.greatest(F.length(canon) + longer + 1, F.lit(48))), by_kind)


def ipv6_groups(mention: Column) -> Column:
    """The eight groups of an IPv6 address, lower case, without leading zeros."""
    sides = F.split(F.lower(mention), "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
    head, tail = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(head) - F.size(tail), F.lit(0)))
    return F.array_join(F.transform(F.concat(head, zeros, tail), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def entities_of(mentions: DataFrame) -> DataFrame:
    """(mention, type, part, kind, canon, gender) of the distinct mentions.

    A phone's canonical form is ``+cc~digits`` or its bare digits.
    """
    m = F.col("mention")
    typed = mentions.withColumn("type", type_of(m))
    digits = F.regexp_replace(m, r"[^0-9]", "")
    local_digits = F.regexp_replace(F.regexp_replace(m, r"^\+\d{1,3}(?=[ .\-(])|^\+\d", ""), r"[^0-9]", "")
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])|^\+\d", 0)
    title = F.regexp_extract(m, rf"^({_TITLES})\.? ", 1)
    first = F.regexp_extract(m, r"^(\S+)", 1)
    gender = (
        F.when(title.rlike(f"^(?:{MALE_TITLES})$") | first.rlike(f"^(?:{MALE_NAMES})$"), "m")
        .when(title.rlike(f"^(?:{FEMALE_TITLES})$") | first.rlike(f"^(?:{FEMALE_NAMES})$"), "f")
        .otherwise("n")
    )
    none = F.lit("-")
    part = lambda kind, canon, g=none: F.struct(F.lit(kind).alias("kind"), canon.alias("canon"), g.alias("gender"))
    names = F.split(F.regexp_replace(m, rf"^{_TITLES}\.? ", ""), " ")
    person = F.transform(
        names,
        lambda n, i: F.struct(
            F.when(i < F.size(names) - 1, F.lit("given")).otherwise(F.lit("surname")).alias("kind"),
            F.lower(n).alias("canon"),
            # a surname has one surrogate whoever bears it
            F.when(i < F.size(names) - 1, gender).otherwise(none).alias("gender"),
        ),
    )
    parts = (
        F.when(F.col("type") == "email", F.array(part("email", F.lower(m)), part("domain", F.lower(F.substring_index(m, "@", -1)))))
        .when(F.col("type") == "person", person)
        .when(F.col("type") == "phone", F.array(part("phone", F.when(code != "", F.concat(code, F.lit("~"), local_digits)).otherwise(digits))))
        .when(F.col("type") == "card", F.array(part("card", digits)))
        .when(F.col("type") == "ssn", F.array(part("ssn", digits)))
        .when(F.col("type") == "ip", F.array(part("ip", F.when(m.contains(":"), ipv6_groups(m)).otherwise(m))))
        .when(F.col("type") == "iban", F.array(part("iban", F.regexp_replace(m, " ", ""))))
        .when(F.col("type") == "secret", F.array(part("secret", F.regexp_replace(m, f"^{SECRET_HEAD}", ""))))
    )
    return typed.select("mention", "type", F.posexplode(parts).alias("part", "p")).select(
        "mention", "type", "part", "p.kind", "p.canon", "p.gender"
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, gender, surrogate), surrogates distinct within a kind and never a real entity.

    Of several entities with one surrogate the smallest keeps it; the others,
    and all whose surrogate is a real entity, draw again at the next attempt.
    """
    state = entities.select("kind", "canon", "gender").distinct().withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("canon").alias("surrogate")).distinct().withColumn("is_real", F.lit(True))
    while True:
        drawn = stored(state.withColumn("surrogate", surrogate(key)), "surrogates")
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon", "gender")).alias("first"))
        checked = drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        loses = F.col("is_real").isNotNull() | (F.struct("attempt", "canon", "gender") != F.col("first"))
        checked = checked.withColumn("loses", loses)
        if checked.where("loses").isEmpty():
            return drawn.select("kind", "canon", "gender", "surrogate")
        state = checked.select("kind", "canon", "gender", (F.col("attempt") + F.col("loses").cast("int")).alias("attempt"))


def laid_out(mention: Column, digits: Column) -> Column:
    """``mention`` with its letters and digits replaced in turn by those of ``digits``."""
    step = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.when(
            c.rlike("^[A-Za-z0-9]$"),
            F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k")),
        ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))),
    )
    return step["s"]


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, type, replacement) of the distinct mentions."""
    parsed = stored(entities_of(mentions), "entities")
    named = parsed.join(assign(parsed, key), ["kind", "canon", "gender"])
    whole = named.groupBy("mention", "type").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("parts"))
    m, s = F.col("mention"), F.get("parts", F.lit(0))["surrogate"]
    cased = lambda out: F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(out)).otherwise(out)
    names = F.split(F.regexp_replace(m, rf"^{_TITLES}\.? ", ""), " ")
    title = F.regexp_extract(m, rf"^({_TITLES}\.? )", 1)
    person = F.array_join(
        F.zip_with(
            names, F.transform("parts", lambda p: p["surrogate"]),
            lambda n, x: F.when((F.length(n) > 1) & (n == F.upper(n)), F.upper(x)).otherwise(F.initcap(x)),
        ),
        " ",
    )
    out = (
        F.when(F.col("type") == "email", cased(F.concat(F.substring_index(s, "@", 1), F.lit("@"), F.get("parts", F.lit(1))["surrogate"])))
        .when(F.col("type") == "person", F.concat(title, person))
        .when(F.col("type") == "secret", F.concat(F.regexp_extract(m, f"^({SECRET_HEAD})?", 0), s))
        .when(F.col("type") == "ip", s)
        .otherwise(laid_out(m, F.regexp_replace(s, "[^A-Za-z0-9]", "")))
    )
    return whole.select("mention", "type", out.alias("replacement"))


def replaced(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with rewritten texts and ``__pii``: the (type, start, length) spans in the new text.

    Start and length are in characters.
    """
    hint = F.coalesce(F.col(text_col).rlike(HINT), F.lit(False))
    none = F.array().cast("array<struct<type:string,start:int,length:int>>")
    found = F.when(hint, F.regexp_extract_all(F.col(text_col), F.lit(PII), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("__m", found)
    hits = stored(marked.where(F.size("__m") > 0).withColumn("__uid", F.monotonically_increasing_id()), "pii-documents")
    rest = marked.where(F.size("__m") == 0).withColumn("__pii", none).drop("__m")

    spots = hits.select("__uid", F.posexplode("__m").alias("__pos", "mention"))
    table = replacements(spots.select("mention").distinct(), key)
    filled = spots.join(table, "mention").groupBy("__uid").agg(
        F.array_sort(F.collect_list(F.struct("__pos", "type", "replacement"))).alias("__r")
    )
    both = hits.join(filled, "__uid")
    pieces = F.split(F.col(text_col), PII, -1)

    def rebuilt(p: Column) -> Column:
        reps = F.transform("__r", lambda x: x["replacement"])
        return F.array_join(F.flatten(F.zip_with(p, F.concat(reps, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")

    def spans(p: Column) -> Column:
        folded = F.aggregate(
            "__r",
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, x: let(
                a["at"] + F.length(F.get(p, x["__pos"])),
                lambda start: F.struct(
                    (start + F.length(x["replacement"])).alias("at"),
                    F.concat(a["out"], F.array(F.struct(x["type"].alias("type"), start.alias("start"), F.length(x["replacement"]).alias("length")))).alias("out"),
                ),
            ),
        )
        return folded["out"]

    done = both.withColumn("__p", pieces).withColumn("__pii", spans(F.col("__p"))).withColumn(text_col, rebuilt(F.col("__p")))
    names = [*[F.col(f"`{c}`") for c in docs.columns], F.col("__pii")]
    return rest.select(*names).unionByName(done.select(*names))


def anonymised(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in its texts; ``chars_col``, where present, follows the new text."""
    plain, names = plain_names(docs)
    text = names[text_col]
    out = replaced(plain, text, key)
    if chars_col in names:
        out = out.withColumn(names[chars_col], F.length(text).cast(docs.schema[chars_col].dataType))
    return restored(out, names)
