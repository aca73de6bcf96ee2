"""Language of texts, translation by dictionary, amounts in words, escaping."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionary import WORDS
from .models import CJK, count_cjk
from .prices import blank

#: Fixed value: a product code within a text.
CODE = r"\b[A-Z]{2,5}\d*\b"


def has_chinese(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CJK)


def bilingual_text(zh: Column, en: Column) -> Column:
    return F.when(F.coalesce(en, F.lit("")).isin("") | (en == zh), zh).otherwise(F.concat(zh, F.lit(" / "), en))


def lines_of(text: Column, chinese: bool) -> Column:
    """Lines with Chinese in them, or without, each stripped; empty lines go."""
    keep = (lambda x: (blank(x) != "") & has_chinese(x)) if chinese else (lambda x: (blank(x) != "") & ~has_chinese(x))
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), keep), blank), "\n")


def is_mostly_english(text: Column) -> Column:
    """Less than a fifth of the characters other than spaces are Chinese."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(F.replace(t, F.lit(" ")))
    return F.when(t == "", False).when(n == 0, True).otherwise(count_cjk(t) / n < 0.2)


def payment_by_lang(text: Column, lang: str) -> Column:
    mark = r"(?i)(?:Terms?\s*of\s*payment|Payment\s*Terms?)\s*:"
    parts = F.split(text, mark, 2)
    two = F.size(parts) > 1
    if lang == "chinese":
        return F.when(two, blank(parts[0])).otherwise(text)
    if lang == "english":
        return F.when(two, F.concat(F.lit("Terms of payment: "), blank(F.try_element_at(parts, F.lit(2))))).otherwise(text)
    return text


def split_bilingual(text: Column, lang: str = "zh") -> Column:
    """The first (zh) or last (en) part at the first kind of separator that occurs."""
    t = blank(text)
    out = t
    for sep in reversed(("<br>", "/", "；", ";")):
        out = F.when(t.contains(sep), blank(F.substring_index(t, sep, 1 if lang == "zh" else -1))).otherwise(out)
    return out


def clean_column_name(name: Column, lang: str = "zh") -> Column:
    notes = r"(?i)\((?:CNY|RMB|USD|\$|未含电池|含电池|不含电池|kW|W|V|A|kg|L|mm)\)"
    return blank(F.regexp_replace(F.regexp_replace(split_bilingual(name, lang), notes, ""), r"\s+", " "))


def fix_fullwidth(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) < 2, t).otherwise(F.translate(t, "：（）－＂＇", ":()-\"'"))


def word_table(words: DataFrame, most: int = 20_000) -> dict[str, str]:
    """A dictionary from a table (zh, en) of at most `most` rows, in the order of the words; the smallest translation of a
    word counts."""
    rows = words.where("zh is not null and zh != '' and en is not null").groupBy("zh").agg(F.min("en").alias("en")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary has at most {most} words")
    return {r["zh"]: r["en"] for r in sorted(rows)}


def turned(words: dict[str, str] = WORDS) -> dict[str, str]:
    """The dictionary the other way round; of words with one translation the last counts."""
    return {new: old for old, new in words.items()}


def longest_first(words: dict[str, str]) -> list[tuple[str, str]]:
    """Words in the order of their replacement: longer ones first, equally long ones in the dictionary's order."""
    return sorted(words.items(), key=lambda kv: -len(kv[0]))


class Translator:
    """Replaces words as a loop over all of them would, longest first, each in what the ones before have left.

    An automaton over all words finds those that a text holds in one walk, so a text costs a walk for each word that it
    really holds, however many the dictionary has. Each replacement is followed by a walk over the new text, as what was
    put in may make up words with what stands beside it.
    """

    def __init__(self, words: dict[str, str]):
        import ahocorasick

        self.order = [(old, new) for old, new in longest_first(words) if old and old != new]
        self.automaton = ahocorasick.Automaton()
        for rank, (old, _) in enumerate(self.order):
            self.automaton.add_word(old, rank)
        self.automaton.make_automaton()

    def plain(self, text: str) -> str:
        done = -1
        while self.order:
            rank = min((r for _, r in self.automaton.iter(text) if r > done), default=None)
            if rank is None:
                break
            text, done = text.replace(*self.order[rank]), rank
        return text

    def protected(self, text: str) -> str:
        """As plain(), but codes (2 to 5 capitals, then digits, standing as a word of their own) stay as they are."""
        parts = re.split(f"({CODE})", text)
        return "".join(part if i % 2 else self.plain(part) for i, part in enumerate(parts))


def translated(text: Column, words: dict[str, str] = WORDS, protect: bool = False) -> Column:
    """The text with words replaced, null for null. The automaton is built once a task; a batch's equal texts are translated
    once."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        translator = Translator(words)
        one = translator.protected if protect else translator.plain
        for texts in batches:
            codes, distinct = pd.factorize(texts)
            done = [one(t) for t in distinct]
            yield pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

    return run(text)


def translate_column(df: DataFrame, column: str, out: str, words: dict[str, str] = WORDS, protect: bool = False) -> DataFrame:
    """df with the column translated."""
    return df.withColumn(out, translated(F.col(column), words, protect))


def translate_frame(df: DataFrame, words: dict[str, str] = WORDS) -> DataFrame:
    """Column names and string columns translated."""
    name = Translator(words).plain
    column = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[(translated(column(c), words) if t == "string" else column(c)).alias(name(c)) for c, t in df.dtypes])


ONES = ["", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE", "THIRTEEN", "FOURTEEN", "FIFTEEN", "SIXTEEN", "SEVENTEEN", "EIGHTEEN", "NINETEEN"]
TENS = ["", "", "TWENTY", "THIRTY", "FORTY", "FIFTY", "SIXTY", "SEVENTY", "EIGHTY", "NINETY"]


def amount_in_words(amount: Column, currency: str = "USD") -> Column:
    """Millions, thousands and the rest in words, cents as nn/100."""
    whole = F.floor(F.coalesce(amount, F.lit(0.0)))
    cents = F.round((amount - whole) * 100).cast("int")
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    word = lambda a, n: F.nullif(F.element_at(a, n.cast("int") + 1), F.lit(""))

    def chunk(n: Column) -> Column:
        rest = n % 100
        small = F.when(rest >= 20, F.concat_ws(" ", word(tens, F.floor(rest / 10)), word(ones, rest % 10))).otherwise(word(ones, F.least(rest, F.lit(19))))
        return F.concat_ws(" ", F.when(n >= 100, F.concat(word(ones, F.floor(n / 100)), F.lit(" HUNDRED"))), F.nullif(small, F.lit("")))

    part = lambda n, name: F.when(n > 0, F.concat(chunk(n), F.lit(name)))
    words = F.concat_ws(" ", part(F.floor(whole / 1_000_000), " MILLION"), part(F.floor(whole % 1_000_000 / 1000), " THOUSAND"), part(whole % 1000, ""))
    text = F.concat(words, F.when(cents > 0, F.concat(F.lit(" AND CENTS "), F.lpad(cents.cast("string"), 2, "0"), F.lit("/100"))).otherwise(""), F.lit(f" {currency} ONLY."))
    return F.when(F.coalesce(amount, F.lit(0.0)) == 0, F.lit(f"ZERO {currency}")).otherwise(text)


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sanitized_number(text: Column) -> Column:
    """A number; text that is none becomes 0, null and empty stay."""
    return F.when(text.isNull() | (text == ""), text.try_cast("double")).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))
