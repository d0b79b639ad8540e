"""Problem 8: sentences across languages and scripts.

Two passes over the corpus. The first counts, per language, each word with and without a final period, what
follows the period, which capitalised word comes after which word with a period, and how often the word begins
a text unit; log-likelihood ratios over these counts give abbreviations, sentence starters, and collocations of
an initial with the word after it. The kind of word that follows an abbreviation is a class by fixed shares.
No word list is given. A starter ends a sentence after an initial, unless both are a collocation. The second pass finds the candidate ends of each text and classifies every period by
these statistics; scripts with their own end marks, or with none, follow their own rules.

Rules beside the statistics: a blank line ends a unit and a single line break does not; a heading (a line of
its own that ends with a colon) and a list item are units; a quotation is never divided, and ends its
sentence only where a new one follows; in Thai a blank between two Thai letters ends a sentence.

Defined results: null, empty and blank texts have no sentences; repeated texts give the same sentences; a
null or unspecific language uses the statistics of all languages together; very long texts take time in
proportion to their length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

POOLED = "*"
_WIDE = "。！？｡।॥។៕"
_END = ".!?…" + _WIDE
# Quotation marks that open, and what closes them.
_QUOTES = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“", '"': '"'}
_CLOSERS = "\"'”’»)]}」』）"
_EDGE = "\"'“”‘’«»()[]{}「」『』,;:"
_BLANK_LINE = re.compile(r"[^\S\n\r]*(?:\r\n|\n|\r)[^\S\n\r]*(?:\r\n|\n|\r)\s*")
_LINE = re.compile(r"[^\n\r]+")
_ITEM = re.compile(r"\s*(?:[-*•–+‣◦]\s+|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][)]\s+)\S")
_MARK = re.compile(r"[" + re.escape(_END) + r"]+|[" + re.escape("".join(_QUOTES)) + r"]")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[^\S\n\r]+(?=[฀-๿])")
_THAI = re.compile(r"[\u0e00-\u0e7f]")
#: Significant words that may reach the driver and, broadcast, the executors.
MODEL_ROWS = 1_000_000


def language(lang: str | None) -> str:
    """The statistics' language of a `lang` value: its primary subtag, or the pool."""
    code = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return code if len(code) in (2, 3) and code.isalpha() and code != "und" else POOLED


# --- first pass: counts -----------------------------------------------------------------------------------

_COUNTS = ("plain", "dotted", "then_lower", "then_upper", "then_other", "starts", "closes")
_COUNT_DDL = "lang string, word string, after string, " + ", ".join(f"{c} bigint" for c in _COUNTS)


def _kind(token: str) -> int:
    """2 lower case, 3 upper case, 4 other: index into a count row."""
    for ch in token:
        if ch.isalpha():
            return 2 if ch.islower() else 3 if ch.isupper() else 4
        if ch.isdigit():
            return 4
    return 4


_UPPER = re.compile(r"[A-Z]")


def is_caseless(text: str) -> bool:
    """Without capitals, or with little else, case says nothing."""
    return text == text.lower() or len(_UPPER.findall(text)) > 0.45 * len(text)


#: A period between a small and a capital letter: the blank after a sentence is missing.
_GLUED = re.compile(r"(?<=[^\W\d_A-Z])\.(?=[^\W\d_a-z])")


def _pieces(token: str) -> list[str]:
    if "." not in token[1:-1]:
        return [token]
    cuts = [m.start() for m in _GLUED.finditer(token) if token[m.start() - 1].islower() and token[m.end()].isupper()]
    if not cuts or "://" in token:
        return [token]
    return [token[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), len(token)], strict=True)]


def _pair(piece: str, following: str) -> tuple[str, str] | None:
    """(word before a period, capitalised word after it); words that are no initials are one, ''."""
    m = _WORD_AT.match(following.lstrip(_EDGE))
    if m is None or not m.group()[0].isupper():
        return None
    word = _word(piece)
    return (word if len(word) == 1 and word.isupper() else ""), m.group()


def count_text(text: str, tokens_seen: Counter, into: dict[str, list[int]], pairs: Counter) -> None:
    """Add one text: its raw tokens to `tokens_seen`, what follows periods and what begins units to `into`, the
    words on both sides of periods to `pairs`."""
    for block in _BLANK_LINE.split(text):
        tokens = block.split()
        if not tokens or is_caseless(block):
            continue
        tokens_seen.update(tokens)
        into[_word(tokens[0])][5] += 1
        last = len(tokens) - 1
        for i, raw in enumerate(tokens):
            if "." in raw:
                pieces = _pieces(raw)
                for k, piece in enumerate(pieces):
                    if piece[-1] == "." and piece[-2:-1] not in (".", ""):
                        row = into[_word(piece)]
                        following = pieces[k + 1] if k + 1 < len(pieces) else tokens[i + 1] if i < last else None
                        if following is None:
                            row[6] += 1
                        else:
                            kind = _kind(following)
                            row[kind] += 1
                            if kind == 3 and (pair := _pair(piece, following)):
                                pairs[pair] += 1
            elif raw[-1] in "!?" and i < last:
                into[_word(tokens[i + 1])][5] += 1


def _word(piece: str) -> str:
    """The word of a token without quotes, commas and end marks."""
    return piece.strip(_EDGE).rstrip(".!?…")


def finish(tokens_seen: Counter, into: dict[str, list[int]]) -> None:
    """Turn the raw tokens into uses with and without a period."""
    for raw, n in tokens_seen.items():
        for piece in _pieces(raw):
            token = piece.strip(_EDGE)
            word = token.rstrip(".!?…")
            if word:
                into[word][1 if token[len(word) :] == "." else 0] += n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0] * 7))
        seen: dict[str, Counter] = defaultdict(Counter)
        pairs: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            code = language(lang)
            count_text(text, seen[code], found[code], pairs[code])
        for code, tokens in seen.items():
            finish(tokens, found[code])
        rows = [(code, w, "", *c) for code, words in found.items() for w, c in words.items() if w and w[0].isalpha()]
        # of a pair only its number counts: the word's capitals after the period
        rows += [(code, w, after, 0, 0, 0, n, 0, 0, 0) for code, counted in pairs.items() for (w, after), n in counted.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names=["lang", "word", "after", *_COUNTS])


def word_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts per (lang, word), `after` blank, and per pair (lang, word, after) over all texts, pre-aggregated per batch before the shuffle. A hot word is
    one row per batch, so no key is heavy. Written once: the statistics read it several times."""
    src = df.where(F.col(text).rlike(r"\S")).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return cut(src.mapInArrow(_count, _COUNT_DDL).groupBy("lang", "word", "after").agg(*(F.sum(c).alias(c) for c in _COUNTS)))


def _llr(k: Column, n: Column, p0: Column) -> Column:
    """Log-likelihood ratio of k of n against the rate p0 where k of n is more, else 0."""
    p = k / n
    up = F.when(k > 0, k * F.log(p / p0)).otherwise(0.0)
    down = F.when(n > k, (n - k) * F.log((1 - p) / (1 - p0))).otherwise(0.0)
    return F.when(p > p0, 2 * (up + down)).otherwise(0.0)


def statistics(counts: DataFrame, least_llr: float = 12.0) -> DataFrame:
    """(lang, word, abbreviation, follows, starter): the significant words only, the pool beside each language.

    A word is an abbreviation if its period is far more frequent than the language's, by LLR, in at least half
    of its uses (nine tenths for long words). `follows` is the collocation class of an abbreviation: 'lower'
    if running text often goes on after it, 'name' if capitals do, else 'number'. A word that seldom goes on
    in lower case but often closes a paragraph ends sentences and is none. A starter is a word whose share at
    the start of units, of all its uses in either case, is far above the language's. Texts whose case says
    nothing are not counted.
    """
    counts = counts.where("after = ''")
    pooled = counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in _COUNTS)).withColumn("lang", F.lit(POOLED))
    every = counts.where(F.col("lang") != POOLED).unionByName(pooled, allowMissingColumns=True)
    total = every.groupBy("lang").agg(F.sum("plain").alias("N0"), F.sum("dotted").alias("N1"), F.sum("starts").alias("NS"))
    n, k, s = F.col("plain") + F.col("dotted"), F.col("dotted"), F.col("starts")

    rate = F.greatest((F.col("N1") + 1) / (F.col("N0") + F.col("N1") + 2), F.lit(1e-4))
    start_rate = F.greatest((F.col("NS") + 1) / (F.col("N0") + F.col("N1") + 2), F.lit(1e-4))
    inner = F.col("word").rlike(r"\p{L}\.\p{L}")
    tight = F.when(F.length("word") <= 4, 0.5).otherwise(0.9)
    dotted = F.when(inner, k * 2 >= n).otherwise((F.length("word") <= 8) & (k >= n * tight) & (_llr(k.cast("double"), n.cast("double"), rate) >= least_llr))
    after = F.col("then_lower") + F.col("then_upper") + F.col("then_other")
    follows = (
        F.when(F.col("then_lower") * 20 >= after, "lower").when(F.col("then_upper") * 2 >= after, "name").otherwise("number")
    )
    abbreviation = dotted & ((follows == "lower") | (F.col("closes") * 33 < k))
    used = F.sum(n).over(W.partitionBy("lang", F.lower("word")))
    every = every.withColumn("used", used)
    starter = F.col("word").rlike(r"^\p{Lu}") & (s * 4 >= F.col("used")) & (_llr(s.cast("double"), n.cast("double"), start_rate) >= least_llr)
    scored = every.join(F.broadcast(total), "lang").select("lang", "word", abbreviation.alias("abbreviation"), follows.alias("follows"), starter.alias("starter"))
    return scored.where("abbreviation OR starter")


def collocations(counts: DataFrame, scored: DataFrame, least_llr: float = 7.88) -> DataFrame:
    """(lang, word, after): the starters that come after an initial far more often than after the language's
    other periods, by LLR and twentyfold, and more than once: names that also begin sentences."""
    pairs = counts.where("after <> ''").select("lang", "word", "after", F.col("then_upper").alias("k"))
    pooled = pairs.groupBy("word", "after").agg(F.sum("k").alias("k")).select(F.lit(POOLED).alias("lang"), "word", "after", "k")
    every = pairs.where(F.col("lang") != POOLED).unionByName(pooled)
    of_after = every.groupBy("lang", "after").agg(F.sum("k").alias("n_after"))
    of_word = every.groupBy("lang", "word").agg(F.sum("k").alias("n_word"))
    of_lang = every.groupBy("lang").agg(F.sum("k").alias("n_lang"))
    starters = F.broadcast(scored.where("starter").select("lang", F.col("word").alias("after")))
    rated = every.where("word <> '' AND k > 1").join(starters, ["lang", "after"], "left_semi").join(of_word, ["lang", "word"]).join(of_after, ["lang", "after"]).join(F.broadcast(of_lang), "lang")
    rate = (F.col("n_after") - F.col("k") + 1) / (F.col("n_lang") - F.col("n_word") + 2)
    k, n = F.col("k").cast("double"), F.col("n_word").cast("double")
    return rated.where((k >= 20 * rate * n) & (_llr(k, n, rate) >= least_llr)).select("lang", "word", "after")


class Model:
    """The significant words by language. Its size is bounded by the languages' abbreviations, starters and
    collocations."""

    def __init__(self, rows, pairs=()):
        self.pairs = {(lang, word.lower(), after.lower()) for lang, word, after in pairs}
        self.abbreviations: dict[str, dict[str, str]] = defaultdict(dict)
        self.starters: dict[str, set[str]] = defaultdict(set)
        for lang, word, abbreviation, follows, starter in rows:
            if abbreviation:
                self.abbreviations[lang][word] = follows
            if starter:
                self.starters[lang].add(word)
        self.folded = {k: {w.lower(): f for w, f in v.items()} for k, v in self.abbreviations.items()}
        self.low_starters = {k: {w.lower() for w in v} for k, v in self.starters.items()}

    def abbreviation(self, lang: str, word: str) -> str | None:
        """The collocation class if the word is an abbreviation of the language."""
        known = self.abbreviations.get(lang)
        if known is None:
            lang = POOLED
            known = self.abbreviations.get(lang, {})
        got = known.get(word)
        if got is None and (word.islower() or word.isupper()) and len(word) > 1:
            got = self.folded.get(lang, {}).get(word.lower())
        return got

    def collocated(self, lang: str, word: str, after: str) -> bool:
        return (lang if lang in self.starters else POOLED, word.lower(), after.lower()) in self.pairs

    def starts(self, lang: str, word: str, caseless: bool) -> bool:
        if caseless:
            return word.lower() in self.low_starters.get(lang if lang in self.low_starters else POOLED, ())
        return word in self.starters.get(lang if lang in self.starters else POOLED, ())


# --- second pass: sentences -------------------------------------------------------------------------------

_WORD_AT = re.compile(r"[^\W\d_]+")


def _before(text: str, i: int) -> str:
    """The word that ends before i."""
    k = i
    while k > 0 and i - k < 60 and not text[k - 1].isspace():
        k -= 1
    return _pieces(text[k:i])[-1] if k < i else ""


class Splitter:
    def __init__(self, model: Model):
        self.model = model

    def split(self, text: str, lang: str | None) -> list[tuple[int, int]]:
        """(start, end) of each sentence in order."""
        code = language(lang)
        parts: list[tuple[int, int, bool]] = []  # start, end, whether running text
        at = 0
        for m in _BLANK_LINE.finditer(text):
            if m.start() > at:
                self._block(text, at, m.start(), parts)
            at = m.end()
        if at < len(text):
            self._block(text, at, len(text), parts)
        caseless = is_caseless("".join(text[s:e] for s, e, run in parts if run))
        out: list[tuple[int, int]] = []
        for s, e, run in parts:
            if run:
                self._running(text, s, e, code, caseless, out)
            else:
                self._add(text, s, e, out)
        return out

    def _block(self, text: str, a: int, b: int, parts: list) -> None:
        """A block without blank lines: headings and list items are cut off, the rest is running text."""
        lines = [m.span() for m in _LINE.finditer(text, a, b)]
        if len(lines) == 1 and not _ITEM.match(text, *lines[0]):
            parts.append((a, b, True))
            return
        run = None  # start of the running text so far
        listed = True  # at the block's start, or after a heading or a list item
        for i, (s, e) in enumerate(lines):
            line = text[s:e].strip()
            if not line:
                continue
            item = listed and _ITEM.match(text, s, e) is not None
            heading = listed and line[-1] in ":：" and i + 1 < len(lines) and len(line) <= 120 and not item
            if item and line[-1] not in ".!?" or heading or item and self._item_block(text, lines, i):
                if run is not None:
                    parts.append((run, s, True))
                    run = None
                parts.append((s, e, False))
                listed = True
            else:
                if run is None:
                    run = s
                listed = False
        if run is not None:
            parts.append((run, b, True))

    @staticmethod
    def _item_block(text: str, lines: list, i: int) -> bool:
        """An item that ends like a sentence is still a unit if its neighbours are items too, or it is alone."""
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        return not near or any(_ITEM.match(text, *lines[j]) for j in near)

    @staticmethod
    def _add(text: str, s: int, e: int, out: list) -> None:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))

    def _running(self, text: str, a: int, b: int, code: str, caseless: bool, out: list) -> None:
        start, pos = a, a
        thai = [m.end() for m in _THAI_GAP.finditer(text, a, b)] if _THAI.search(text, a, b) else []
        k = 0
        while (m := _MARK.search(text, pos, b)) is not None:
            i, j = m.span()
            while k < len(thai) and thai[k] <= i:
                self._add(text, start, thai[k], out)
                start = thai[k]
                k += 1
            if text[i] in _QUOTES:
                close = self._close(text, i, b)
                if close < 0:
                    pos = j
                    continue
                while k < len(thai) and thai[k] <= close:
                    k += 1  # a quotation is not divided
                pos = close + 1
                inner = close - 1
                while inner > i and text[inner].isspace():
                    inner -= 1
                if text[inner] in _END and self._after_quote(text, pos, b, code, caseless, text[inner] in _WIDE):
                    self._add(text, start, pos, out)
                    start = pos
                continue
            while j < b and text[j] in _CLOSERS and text[j] not in _QUOTES:
                j += 1
            # a straight quote right after an end closes nothing that was opened here
            pos = j
            if self._ends(text, i, m.end(), j, b, code, caseless):
                self._add(text, start, j, out)
                start = j
        for cut in thai[k:]:
            self._add(text, start, cut, out)
            start = cut
        self._add(text, start, b, out)

    @staticmethod
    def _close(text: str, i: int, b: int) -> int:
        """Where the quotation that opens at i closes, or -1."""
        mark = text[i]
        if mark == '"' and (i and not text[i - 1].isspace() and text[i - 1] not in "(:,“‘—–-" and not _cjk(text[i - 1]) or i + 1 >= b or text[i + 1].isspace()):
            return -1
        return text.find(_QUOTES[mark], i + 1, b)

    def _after_quote(self, text: str, j: int, b: int, code: str, caseless: bool, wide: bool) -> bool:
        q = j
        while q < b and text[q].isspace():
            q += 1
        if q >= b:
            return True
        c = text[q]
        if c in "，、,;；:：。.!?！？…と)）]":
            return False
        if _cjk(c):
            return True
        m = _WORD_AT.search(text, q, min(b, q + 60))
        head = m.group() if m else ""
        if c.isdigit() or not head:
            return q > j
        if caseless:
            return self.model.starts(code, head, True)
        return not head[0].islower()

    def _ends(self, text: str, i: int, j: int, end: int, b: int, code: str, caseless: bool) -> bool:
        """Whether the end marks text[i:j], with closers up to `end`, end a sentence."""
        marks = text[i:j]
        q = end
        while q < b and text[q].isspace():
            q += 1
        if q >= b:
            return True
        gap = q > end
        if any(c in _WIDE for c in marks):
            return text[q] not in "，、,と" or gap
        c = text[q]
        m = _WORD_AT.search(text, q, min(b, q + 60))
        head = m.group() if m and not any(ch.isdigit() for ch in text[q : m.start()]) else ""
        digit = not head and any(ch.isdigit() for ch in text[q : q + 4])
        lower = bool(head) and head[0].islower()
        upper = bool(head) and head[0].isupper()
        before = text[i - 1] if i else " "
        if "!" in marks or "?" in marks:
            if _cjk(before) or _cjk(c):
                return True
            if c in ",;:":
                return False
            return gap and (not lower or caseless) or upper and not gap
        if "…" in marks or len(marks) > 1:  # an ellipsis goes on in lower case
            return (upper or digit or bool(head) and not lower) and (gap or upper) if not caseless else gap and self.model.starts(code, head, True)
        # one period
        if c in ",;:":
            return False
        if not gap:
            # no blank: only between a word's end and a capitalised word
            if not upper or len(head) < 2 or not (before.islower() or before in _CLOSERS or before == "%"):
                return False
            if not (head[1].islower() and before.islower()) and not (before in _CLOSERS or before == "%"):
                return False
            word = _before(text, i)
            if "://" in word or "@" in word or self.model.abbreviation(code, word.strip(_EDGE)):
                return False
            return m.start() == q
        word = _before(text, i).strip(_EDGE)
        follows = self.model.abbreviation(code, word) if word else None
        initial = len(word) == 1 and word.isalpha() and word.isupper()
        if follows is None and not initial:
            if lower and not caseless:
                return False
            return True
        if lower or digit:
            return False
        if initial and head and self.model.starts(code, head, caseless):
            return not self.model.collocated(code, word, head)
        if follows == "lower":
            return not caseless or self.model.starts(code, head, True)
        if follows == "number" and upper:
            return self.model.starts(code, head, caseless)
        return False


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" or "ऀ" <= c <= "ॿ" or "ក" <= c <= "៿" or "　" <= c <= "〿" or "＀" <= c <= "￯"


_OUT = pa.schema([("doc_id", pa.int64()), ("sent_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32())])


def _split(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model.value)
        for b in batches:
            ids, nos, starts, ends = [], [], [], []
            for key, text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for no, (s, e) in enumerate(splitter.split(text, lang)):
                    ids.append(key)
                    nos.append(no)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, nos, starts, ends), _OUT, strict=True)], schema=_OUT)

    return run


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of a corpus. Only significant words reach the driver: abbreviations, starters and collocations,
    counted before; more than MODEL_ROWS of them are an error, since none may be left out."""
    counts = word_counts(df, text, lang)
    scored = cut(statistics(counts))
    pairs = cut(collocations(counts, scored))
    if (n := scored.count() + pairs.count()) > MODEL_ROWS:
        raise ValueError(f"{n} significant words: raise least_llr or MODEL_ROWS")
    return Model(scored.toLocalIterator(), pairs.toLocalIterator())


def split_sentences(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, sent_no, start_at, end_at) of every sentence."""
    src = df.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return src.mapInArrow(_split(df.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, sent_no int, start_at int, end_at int")
