"""Readers and writers of the formats around the pipeline. All stay in the JVM but the JSON repair of problem 2."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tables as T
from ..functions import text as X
from ..operators import tagging as G
from ..session import broadcast_if_small


def read_notes(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(name, number, text): one row per file, the whole file as text; `number` is the figures of the name,
    the order in which notes are numbered. Where no file matches `glob`, all files are read."""
    raw = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    if glob != "*" and not raw.inputFiles():  # no such file: all files
        raw = spark.read.text(folder, wholetext=True)
    raw = raw.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return raw.select("name", X.file_number(F.col("name")).alias("number"), "text")


def read_rrf(spark: SparkSession, path: str, sources: tuple[str, ...] = ("RXNORM",), kinds: tuple[str, ...] = T.TTY_RANK) -> DataFrame:
    """(rxcui, str, key, tty) of a '|'-separated release file without quoting: rows of at least 15 fields, in
    English, of the given sources (all if none is given) and term types, with a name."""
    f = F.split("value", r"\|")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 15)
    keep = (F.col("f")[1] == "ENG") & F.col("f")[12].isin(*kinds)
    if sources:
        keep = keep & F.col("f")[11].isin(*sources)
    out = rows.where(keep).select(F.col("f")[0].alias("rxcui"), F.col("f")[14].alias("str"), X.norm_key(F.col("f")[14]).alias("key"), F.col("f")[12].alias("tty"))
    return out.where("str <> '' AND key <> ''")


def _code_rows(raw: DataFrame) -> DataFrame:
    """(code, en, vn, key_vn, key_en, level) of the rows (code, en, vn) whose code is kept; missing names are ''."""
    code = F.trim("code")
    en, vn = (X.strip(F.coalesce(c, F.lit(""))) for c in ("en", "vn"))
    return raw.where((F.length(code) >= 3) & code.rlike(r"^\p{L}")).select(code.alias("code"), en.alias("en"), vn.alias("vn"), X.norm_key(vn).alias("key_vn"), X.norm_key(en).alias("key_en"), X.code_level(code).alias("level"))


def read_code_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(code, en, vn, key_vn, key_en, level) of a code list exported as CSV with columns code, name_en, name_vn."""
    raw = spark.read.csv(path, header=True)
    return _code_rows(raw.select("code", F.col("name_en").alias("en"), F.col("name_vn").alias("vn")))


def _sheet_rows(content: bytes, columns: tuple[int, ...]) -> Iterator[list[str | None]]:
    """Text cells of some columns of a workbook's first sheet; numbers and empty cells are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        sheet = min((n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if not row.tag.endswith("}row"):
                continue
            cells: dict[int, str] = {}
            for place, c in enumerate(row):
                letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                at = functools.reduce(lambda n, ch: 26 * n + ord(ch) - 64, letters, 0) - 1 if letters else place
                texts = [x.text or "" for x in c.iter() if x.tag.endswith("}t") or x.tag.endswith("}v")]
                if c.get("t") == "s" and texts:
                    cells[at] = shared[int(texts[0])]
                elif c.get("t") in ("inlineStr", "str"):
                    cells[at] = "".join(texts)
            row.clear()
            yield [cells.get(k) for k in columns]


def read_code_workbook(spark: SparkSession, path: str, columns: tuple[int, int, int] = (17, 19, 21)) -> DataFrame:
    """(code, en, vn, key_vn, key_en, level) of the first sheet of .xlsx workbooks; `columns` are the places from 0 of
    the code, the English and the Vietnamese name. Cells that are no text are null. A workbook is one task."""

    def run(batches):
        for b in batches:
            for content in b["content"]:
                rows = list(_sheet_rows(content, columns))
                yield pd.DataFrame(rows, columns=["code", "en", "vn"], dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "code string, en string, vn string")
    return _code_rows(raw.where("code IS NOT NULL"))


def cached(spark: SparkSession, folder: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under folder/version, made and written first if it is not there: e.g. embeddings of a
    knowledge base, whose version names the cache."""
    path = f"{folder}/{version}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, no, token, tag): the first and the last column of each line; blank lines end a sentence,
    lines of one column are skipped. One file is one sequence, as its line order counts."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    w = W.partitionBy("file").orderBy("line")
    lines = lines.withColumn("sent", F.sum(F.when(F.trim("value") == "", 1).otherwise(0)).over(w))
    parts = F.filter(F.split("value", f"[{T.WS}]+"), lambda x: x != "")
    rows = lines.select("file", "sent", "line", parts.alias("p")).where(F.size("p") >= 2)
    return rows.select("file", "sent", F.row_number().over(W.partitionBy("file", "sent").orderBy("line")).alias("no"), F.col("p")[0].alias("token"), F.element_at("p", -1).alias("tag"))


def conll_offsets(tokens: DataFrame, key: list[str]) -> DataFrame:
    """`tokens` (…, no, token) with `start` and `end` on the sentence of surfaces joined by blanks."""
    s = X.surface(F.col("token"))
    before = W.partitionBy(*key).orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(s) + 1).over(before), F.lit(0)).cast("int")
    return tokens.withColumn("start", start).withColumn("end", (F.col("start") + F.length(s)).cast("int"))


def read_span_json(spark: SparkSession, path: str, schema: str, text: str = "text", spans: str = "entities", lines: bool = True) -> DataFrame:
    """(text, spans) of JSON lines or one JSON array, field names as parameters."""
    raw = spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    return raw.select(F.col(text).alias("text"), F.col(spans).alias("spans"))


def read_jsonl(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """JSON lines of one or more files, blank lines skipped; of `columns` those that are present."""
    df = spark.read.json(path)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def document_json(concepts: DataFrame, key: str) -> DataFrame:
    """(key, json): the concepts (key, start, …) of each document as one JSON array in order of start."""
    cols = [c for c in concepts.columns if c not in (key, "start")]
    return concepts.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("start", *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols)))).alias("json"))


def conll_to_unified(tokens: DataFrame, source: str, labels: DataFrame) -> DataFrame:
    """(file, sent, text, source, spans) of tagged tokens (file, sent, no, token, tag): surfaces joined by blanks, spans
    of the tags (an I without its B opens one too) with the labels' meaning for the source (see `meaning`); spans
    without one are dropped. Sentences without spans have an empty list."""
    key = ["file", "sent"]
    per = tokens.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("no", "token", "tag"))).alias("a"))
    return sentences_to_unified(per.select(*key, F.col("a.token").alias("tokens"), F.col("a.tag").alias("tags")), source, labels)


def sentences_to_unified(sentences: DataFrame, source: str, labels: DataFrame) -> DataFrame:
    """The same of sentences (file, sent, tokens, tags) that come as one row each."""
    key = ["file", "sent"]
    s = sentences.select(*key, F.transform("tokens", X.surface).alias("t"), "tags")
    s = s.select(*key, F.array_join("t", " ").alias("text"), F.transform("t", F.length).alias("lens"), "tags")
    asked = (lambda c: c) if source == "i2b2" else F.upper
    # the labels of one source, in one row
    known = labels.where((F.col("source") == source) & F.coalesce("fine", "coarse").isNotNull()).agg(F.collect_list(F.struct("label", "fine", "coarse")).alias("known"))
    meant = lambda r: F.transform(F.filter("known", lambda k: k["label"] == asked(r["label"])), lambda k: F.struct(r["start"].alias("start"), r["end"].alias("end"), k["fine"].alias("fine"), k["coarse"].alias("coarse")))
    spans = G.runs(s, "lens", "tags", *key, "text").join(F.broadcast(known)).select(*key, "text", F.array_sort(F.flatten(F.transform("runs", meant))).alias("s"))
    full = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring("text", x["start"] + 1, x["end"] - x["start"]).alias("text"), x["fine"].alias("fine"), x["coarse"].alias("coarse"), F.array().cast("array<string>").alias("assertions")))
    return spans.select(*key, "text", F.lit(source).alias("source"), full.alias("spans"))


def meaning(df: DataFrame, labels: DataFrame) -> DataFrame:
    """`df` (..., source, label) with `fine` and `coarse`, null for labels that the source's map does not know. Labels
    are compared in upper case, but for source i2b2. `labels` has (source, label, fine, coarse)."""
    asked = F.when(F.col("source") == "i2b2", F.col("label")).otherwise(F.upper("label"))
    known = broadcast_if_small(labels.select("source", F.col("label").alias("__l"), "fine", "coarse"))
    return df.withColumn("__l", asked).join(known, ["source", "__l"], "left").drop("__l")


def label_table(spark: SparkSession) -> DataFrame:
    """(source, label, fine, coarse) of the known corpora."""
    return spark.createDataFrame([*T.LABELS], "source string, label string, fine string, coarse string")


def write_documents(concepts: DataFrame, key: str, folder: str) -> None:
    """One JSON file per document, named by its key, as folder/key=<key>/part-*.txt."""
    document_json(concepts, key).write.partitionBy(key).mode("errorifexists").text(folder)
