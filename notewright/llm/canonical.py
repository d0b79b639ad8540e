"""Problem 4: one consistent form for strings that look alike.

Every value is mapped character-wise first (blanks, invisible characters, widths, look-alike signs and
letters). The mapped values are then grouped in SQL under Spark's accent-sensitive, case-sensitive Unicode
collation, which holds canonically equivalent strings equal however their accents are encoded. Of each class
one member is chosen deterministically (fewest separate marks, shortest, lowest in binary order; the composed
spelling is always a member) and joined back to all values of the class.

Values made only of characters that no step can change are their own form and skip the grouping. Defined
results: null has no form, '' and blanks keep theirs; repeated values fall into one class; the work is row by
row but for one grouping of the values that hold unusual characters. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters of the Vietnamese alphabet with their accents.
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐ"

# Letters of other scripts that look like a letter of the English alphabet.
LOOKALIKE_LETTERS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u",
}

# Latin letters outside both alphabets that look like one of theirs.
LATIN_LETTERS = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g"}

# Signs that look like an ASCII sign.
SIGNS = {
    "‐": "-", "‑": "-", "˗": "-", "﹣": "-", "․": ".", "ꓸ": ".", "∶": ":", "꞉": ":", ";": ";", "ʼ": "'",
    "⁄": "/", "∕": "/", "⁎": "*", "∗": "*", "٪": "%", "ǃ": "!", "∣": "|",
}

#: Blanks other than the ordinary one, and characters that nothing shows (Java regex).
BLANKS = "  " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
INVISIBLE = (
    r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯"
    r"ㅤ︀-️﻿ﾠ\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}]"
)
#: What cannot change, most frequent first: ASCII, precomposed Latin, common signs, Han, emoji. As few ranges
#: as possible, since every character of every value is held against them.
_SETTLED = (
    r"\x09-\x0d\x20-\x7eẠ-ỹà-ïñ-İÀ-ÏÑ-ßĲ-ƈƊ-ɏ"
    r"®-¿‒-‣…≤≥一-鿿\x{1f300}-\x{1faff}"
)
DIRTY = f"[^{_SETTLED}]"

_CHARS = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys(BLANKS, " ") | SIGNS | LATIN_LETTERS
_FROM, _TO = "".join(_CHARS), "".join(_CHARS.values())
_LOOK_FROM, _LOOK_TO = "".join(LOOKALIKE_LETTERS), "".join(LOOKALIKE_LETTERS.values())
_FOREIGN = r"[\p{IsCyrillic}\p{IsGreek}]"
_WORDS = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"


def compose(c: Column, given: Column | None = None) -> Column:
    """Canonical composition (NFC) in the JVM. `given`: a plain column that is null where `c` is; saves
    evaluating `c` twice."""
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when((c if given is None else given).isNotNull(), done)


def decompose(c: Column, given: Column | None = None) -> Column:
    """Canonical decomposition (NFD) in the JVM; `given` as above."""
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when((c if given is None else given).isNotNull(), done)


def is_dirty(c: Column) -> Column:
    return c.rlike(DIRTY)


def lookalike_map(c: Column) -> Column:
    """Blanks, invisible characters, widths and signs everywhere; letters of other scripts only inside words
    that hold a Latin letter, so words wholly in another script and single Greek letters stay."""
    plain = F.translate(F.regexp_replace(c, INVISIBLE, ""), _FROM, _TO)

    def word(w):
        mixed = w.rlike(_FOREIGN) & w.rlike(r"\p{IsLatin}")
        return F.when(mixed, F.translate(w, _LOOK_FROM, _LOOK_TO)).otherwise(w)

    by_word = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(_WORDS), F.lit(0)), word), "")
    return F.when(plain.rlike(_FOREIGN), by_word).otherwise(plain)


def form(c: Column) -> Column:
    """The consistent form of one value as a column: what the class's canonical member spells."""
    return F.when(is_dirty(c), compose(lookalike_map(c), c)).otherwise(c)


def classes(mapped: DataFrame) -> DataFrame:
    """(key, canonical) of the distinct values of `mapped.mapped`, grouped under the Unicode collation."""
    distinct = mapped.select("mapped").distinct()
    members = distinct.select(F.explode(F.array("mapped", compose(F.col("mapped")))).alias("member"), "mapped")
    cost = F.length(F.regexp_replace("member", r"[^\p{M}]", ""))
    return (
        members.select(F.collate("mapped", "UNICODE").alias("key"), F.struct(cost.alias("marks"), F.length("member").alias("len"), F.col("member")).alias("m"))
        .groupBy("key")
        .agg(F.min("m")["member"].alias("canonical"))
    )


def canonical_forms(values: DataFrame, value: str = "value") -> DataFrame:
    """`values` with `form` (string) and `changed` (boolean); columns of those names are replaced."""
    values = values.drop("form", "changed")
    settled = values.where(~F.coalesce(is_dirty(F.col(value)), F.lit(False))).select("*", F.col(value).alias("form"), F.lit(False).alias("changed"))
    return settled.unionByName(changed_forms(values, value, only=False))


def changed_forms(values: DataFrame, value: str = "value", only: bool = True) -> DataFrame:
    """The rows with unusual characters and their form; with `only` just those that the form changes."""
    dirty = values.where(is_dirty(F.col(value))).withColumn("__mapped", lookalike_map(F.col(value)))
    found = classes(dirty.select(F.col("__mapped").alias("mapped"))).withColumnRenamed("key", "__key")
    out = dirty.withColumn("__key", F.collate("__mapped", "UNICODE")).join(found, "__key")
    out = out.select(*values.columns, F.col("canonical").alias("form"), (F.col("canonical") != F.col(value)).alias("changed"))
    return out.where("changed") if only else out


def values_of(unified: DataFrame, out_docs: DataFrame, icd_index: DataFrame) -> DataFrame:
    """(tbl, row_key, item_no, value): the values of the three tables that are not null."""
    u = unified.select(F.lit("unified").alias("tbl"), F.col("rec_id").cast("string").alias("row_key"), F.lit(0).alias("item_no"), F.col("text").alias("value"))
    o = out_docs.select("out_id", F.posexplode("concepts").alias("item_no", "c")).select(F.lit("out_docs").alias("tbl"), F.col("out_id").cast("string").alias("row_key"), "item_no", F.col("c.text").alias("value"))
    i = icd_index.select(F.lit("icd_index").alias("tbl"), F.col("code").alias("row_key"), F.lit(0).alias("item_no"), F.col("vn").alias("value"))
    return u.unionByName(o).unionByName(i).where(F.col("value").isNotNull())
