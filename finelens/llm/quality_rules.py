"""Line-first quality rules (native): clean by line, then judge what is left.

Every line is tested on its own against punctuation, navigation and
boilerplate rules; failing lines are removed; a document that loses more than
``MAX_LOSS`` of its word characters is rejected.  Before that stand base rules
on the whole text (few words, repeated five-word windows).

All of it is one projection: no shuffle, no Python, nothing leaves the row.

Defined results
---------------
* null or blank text: no words, all counts 0, base_failed, not kept, cleaned
  text empty;
* a very long line is judged by its end mark and symbols alone: phrases fail short lines only;
* blank lines are dropped from the cleaned text and count as no loss;
* repeated rows and null ids are judged one by one like any other;
* further columns of the input are kept by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finelens.llm.common import WS, let, plain_names, restored, words_of

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: Share of a document's word characters that may go with failing lines.
MAX_LOSS = 0.5
#: A line of fewer words without an end mark is a menu entry or a heading.
MIN_LINE_WORDS = 3
#: Share of symbol characters beyond which a line is markup or noise.
MAX_SYMBOL_SHARE = 0.10
SYMBOLS = "#*$%&|<>"

#: Lines of more words are prose: a phrase in them is no navigation, no boilerplate.
MAX_NAVIGATION_WORDS = 6
MAX_BOILERPLATE_WORDS = 20
#: Fixed phrases (lower case) that mark navigation and boilerplate lines, in English, German, French and Spanish.
NAVIGATION = (
    r"^(home|menu|search|login|log in|sign in|sign up|register|next|previous|prev|back|share|"
    r"read more|skip to content|back to top|site map|sitemap|"
    r"startseite|anmelden|registrieren|accueil|connexion|inicio|iniciar sesión)([\s|>/:.-]|$)"
)
BOILERPLATE = (
    r"all rights reserved|copyright ©|\(c\) \d{4}|©|privacy policy|terms of (use|service)|"
    r"cookie policy|accept cookies|enable javascript|subscribe to our newsletter|"
    r"licensed under|license, version|under the mit license|lorem ipsum|"
    r"alle rechte vorbehalten|datenschutzerklärung|tous droits réservés|politique de confidentialité|"
    r"todos los derechos reservados|política de privacidad"
)
END_MARKS = r"""[.!?…。！？:;"'”’»)\]]$"""


def strip_ws(col: Column) -> Column:
    return F.translate(col, " \t\n\x0b\f\r", "")


def count_of(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(words: Column) -> Column:
    """Number of words inside five-word windows that occur twice or more in the text.

    Windows are 64-bit hashes.  A text without a repeated window (most) ends
    after one distinct count; for the others the hashes are sorted with their
    positions, equal neighbours give the repeated windows, and a fold over
    their sorted positions adds up the words covered.
    """

    def windows(hs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hs) - 5), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(5)])
        )

    def covered(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            hit = F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)),
            )
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        return F.aggregate(
            let(pairs, repeated),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + 5 - F.greatest(p, acc["end"])).alias("n"), (p + 5).alias("end")
            ),
            lambda acc: acc["n"],
        )

    def judged(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered(grams))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(let(hashes, windows), judged)).cast("long")


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails one of the rules."""

    def judged(s: Column) -> Column:
        low = F.lower(s)
        n_words = F.size(F.split(s, f"[{WS}]+"))
        ended = s.rlike(END_MARKS)
        symbols = count_of(s, SYMBOLS)
        return (
            (~ended & (n_words < MIN_LINE_WORDS))
            | (symbols > MAX_SYMBOL_SHARE * F.length(s))
            | (count_of(s, "|»›·") >= 2)
            | ((n_words <= MAX_NAVIGATION_WORDS) & low.rlike(NAVIGATION))
            | ((n_words <= MAX_BOILERPLATE_WORDS) & low.rlike(BOILERPLATE))
        )

    return let(F.regexp_replace(line, f"^[{WS}]+|[{WS}]+$", ""), judged)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus a struct ``__q`` with counts, verdicts and the cleaned text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__t", text).withColumn("__w", words_of(F.col("__t"))).withColumn(
        "__lines",
        F.filter(F.split("__t", "\n"), lambda x: strip_ws(x) != ""),
    )
    rows = rows.withColumn("__good", F.filter("__lines", lambda x: ~line_fails(x)))
    word_chars = F.length(strip_ws(F.col("__t")))
    good_chars = F.length(strip_ws(F.array_join("__good", "\n")))
    rows = rows.withColumn(
        "__q",
        F.struct(
            F.size("__w").cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            count_of(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("__w")).alias("n_repeat_words"),
            good_chars.cast("long").alias("good_chars"),
            (F.size("__lines") - F.size("__good")).cast("long").alias("n_lines_removed"),
            F.array_join("__good", "\n").alias("clean_text"),
        ),
    )
    q = F.col("__q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PCT * q["n_words"])
    kept = ~failed & (q["word_chars"] - q["good_chars"] <= MAX_LOSS * q["word_chars"])
    return rows.withColumn("__q", q.withField("base_failed", failed).withField("kept", kept)).drop(
        "__t", "__w", "__lines", "__good"
    )


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base verdict, final verdict."""
    return features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(
        "doc_id",
        *[
            F.col(f"__q.{c}").alias(c)
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        ],
        F.col("__q.n_lines_removed").alias("n_lines_removed"),
    )


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Documents that pass, their failing lines removed; the columns of ``docs``."""
    plain, names = plain_names(docs)
    text = names[text_col]
    # a filter on the verdict would be pushed down and judge every text again; one on a generator's output is not
    kept = F.filter(F.array("__q"), lambda q: q["kept"])
    rows = features(plain, text).withColumn("__kept", kept).select(*names.values(), F.explode_outer("__kept").alias("__q"))
    rows = rows.where("__q is not null").withColumn(text, F.col("__q.clean_text"))
    if chars_col in names:
        rows = rows.withColumn(names[chars_col], F.length(text).cast("long"))
    return restored(rows, names)
