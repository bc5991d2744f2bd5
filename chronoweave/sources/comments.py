"""Comment files: <d p="seconds,mode,size,colour,time,pool,user,row">text</d> elements at any depth.

Files are read by Spark, one row each, and parsed as a stream of events, so that what stands before an error is kept. An
element's text is all text inside it, as it is; an element inside another one counts for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

SNIPPET = 240


@dataclass(frozen=True)
class Limits:
    """Fixed values of the import: bytes of a file, elements of one, bytes and fields of p, bytes of a text, depth; and of a
    batch: files, bytes, elements."""

    file_bytes: int = 64 << 20
    items: int = 250_000
    p_bytes: int = 16 << 10
    p_fields: int = 64
    text_bytes: int = 1 << 20
    depth: int = 256
    batch_files: int = 256
    batch_bytes: int = 256 << 20
    batch_items: int = 500_000


class Beyond(Exception):
    """A limit that a file is beyond; its name is the code."""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """asset_id (file name), xml (bytes), n_bytes and sha256, one row a file."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("asset_id"), F.col("content").alias("xml"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def parse(data: str | bytes, limits: Limits | None = None) -> tuple[list[list], tuple[str, str] | None]:
    """Elements [p, text, snippet] in document order, and the error that ended the reading (code, snippet), if one did. With
    limits, a file beyond one has no elements."""
    raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else bytes(data)
    reader = expat.ParserCreate("utf-8" if isinstance(data, str) else None)
    found: list[list] = []
    open_at: list[tuple[list, int, int]] = []  # element, where it began, its depth
    depth = 0

    def start(name: str, attributes: dict) -> None:
        nonlocal depth
        depth += 1
        if limits and depth > limits.depth:
            raise Beyond("tooDeep")
        if name == "d":
            p = attributes.get("p")
            found.append([p, [], "", 0])
            open_at.append((found[-1], reader.CurrentByteIndex, depth))
            if limits and len(found) > limits.items:
                raise Beyond("tooManyItems")
            if limits and p and (len(p.encode()) > limits.p_bytes or p.count(",") >= limits.p_fields):
                raise Beyond("tooManyFields" if p.count(",") >= limits.p_fields else "longFields")

    def text(part: str) -> None:
        for element, *_ in open_at:
            element[1].append(part)
            element[3] += len(part.encode("utf-8", "surrogatepass"))
            if limits and element[3] > limits.text_bytes:
                raise Beyond("longText")

    def end(name: str) -> None:
        nonlocal depth
        if open_at and open_at[-1][2] == depth:
            element, begin, _ = open_at.pop()
            element[2] = raw[begin : begin + 4 * SNIPPET].decode("utf-8", "replace")[:SNIPPET]
        depth -= 1

    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, end, text
    error = None
    try:
        if limits and len(raw) > limits.file_bytes:
            raise Beyond("fileTooLarge")
        reader.Parse(raw, True)
    except Beyond as e:
        return [], (str(e), raw[: 4 * SNIPPET].decode("utf-8", "replace")[:SNIPPET])
    except expat.ExpatError as e:
        error = "parseError", f"line {e.lineno}, column {e.offset}: {expat.ErrorString(e.code)}"[:SNIPPET]
    return [[p, "".join(parts), snippet] for p, parts, snippet, _ in found], error


_PARSED = "original_index long, p string, text string, snippet string, error string"


def parsed(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``files`` (asset_id, xml: text or bytes) as a row for each element, and one with an error code and no original_index for
    each file that has an error. A file that is null or empty has an error and no elements."""
    names = ["original_index", "p", "text", "snippet", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found, error = parse(b.column(1)[i].as_py() or "", limits)
                rows = [(k, *x, None) for k, x in enumerate(found)] + ([(None, None, None, error[1], error[0])] if error else [])
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    cols = [pa.array(c, t) for c, t in zip(zip(*part), (pa.int64(), *[pa.string()] * 4))]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(part), b.schema.field(0).type), *cols], ["asset_id", *names])

    kind = files.schema["asset_id"].dataType.simpleString()
    return files.select("asset_id", "xml").mapInArrow(run, f"asset_id {kind}, {_PARSED}")


def elements(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Every element in document order: asset_id, original_index, p, text, snippet; those before an error, too."""
    return parsed(files, limits).filter("original_index is not null").drop("error")


def elements_of_parts(parts: DataFrame, order: list[str]) -> DataFrame:
    """asset_id, original_index, p, text of every element of files that come in parts (asset_id, xml, and the columns that order
    them): read as they stream by, so that no file is one value. What precedes an error is kept, as in ``elements``."""
    names = ["asset_id", "original_index", "p", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, None
        for b in batches:
            found: list[tuple] = []
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if reader is None or ids[i] != file:
                    if reader:
                        found += [(file, *x) for x in reader.rest()]
                    file, reader = ids[i], PartReader()
                found += [(file, *x) for x in reader.feed("".join(x for x in texts[i:j] if x))]
            yield made(found)
        if reader:
            yield made([(file, *x) for x in reader.rest()])

    def made(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names)

    dealt = parts.select(F.col("asset_id").cast("string").alias("asset_id"), "xml", *order).repartition("asset_id").sortWithinPartitions("asset_id", *order)
    return dealt.select("asset_id", "xml").mapInArrow(run, "asset_id string, original_index long, p string, text string")


class PartReader:
    """Elements (original_index, p, text) of one file's parts, each when it ends; those open at an error or the end at last."""

    def __init__(self) -> None:
        self.reader = expat.ParserCreate("utf-8")
        self.reader.StartElementHandler, self.reader.EndElementHandler, self.reader.CharacterDataHandler = self._start, self._end, self._text
        self.n, self.depth, self.over = 0, 0, False
        self.open: list[tuple[int, str | None, list[str], int]] = []
        self.ended: list[tuple[int, str | None, str]] = []

    def _start(self, name: str, attributes: dict) -> None:
        self.depth += 1
        if name == "d":
            self.open.append((self.n, attributes.get("p"), [], self.depth))
            self.n += 1

    def _text(self, part: str) -> None:
        for element in self.open:
            element[2].append(part)

    def _end(self, name: str) -> None:
        if self.open and self.open[-1][3] == self.depth:
            i, p, text, _ = self.open.pop()
            self.ended.append((i, p, "".join(text)))
        self.depth -= 1

    def feed(self, part: str) -> list[tuple[int, str | None, str]]:
        if not self.over:
            try:
                self.reader.Parse(part.encode("utf-8", "surrogatepass"), False)
            except expat.ExpatError:
                self.over = True
        out, self.ended = self.ended, []
        return out

    def rest(self) -> list[tuple[int, str | None, str]]:
        # An end that is missing is an error of the file, after all its elements.
        return [(i, p, "".join(text)) for i, p, text, _ in self.open]


def file_errors(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """asset_id, code, snippet of files that could not be read to their end: ``parseError``, or the limit they are beyond
    (``fileTooLarge``, ``tooManyItems``, ``longFields``, ``tooManyFields``, ``longText``, ``tooDeep``)."""
    return parsed(files, limits).filter("error is not null").select("asset_id", F.col("error").alias("code"), "snippet")


def batch_errors(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Codes of the limits that the files are beyond together: ``tooManyFiles``, ``tooManyBytes``, ``tooManyItemsInAll``."""
    limits = limits or Limits()
    size = files.agg(F.count("*").alias("f"), F.coalesce(F.sum(F.octet_length("xml")), F.lit(0)).alias("b"))
    n = elements(files, limits).agg(F.count("*").alias("i"))
    odd = F.array_compact(F.array(F.when(F.col("f") > limits.batch_files, "tooManyFiles"), F.when(F.col("b") > limits.batch_bytes, "tooManyBytes"), F.when(F.col("i") > limits.batch_items, "tooManyItemsInAll")))
    return size.crossJoin(n).select(F.explode(odd).alias("code"))  # one row each


def items(found: DataFrame) -> DataFrame:
    """Typed rows; a bad field takes its default, no row is lost."""
    f = F.split(F.coalesce("p", F.lit("")), ",")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return found.select(
        "asset_id",
        F.concat_ws(":", "asset_id", "original_index").alias("item_id"),
        "original_index",
        F.coalesce(X.decimal_seconds_ms(at(0)), F.lit(0)).alias("t_ms"),
        X.nullable_long(at(1)).alias("mode"),
        X.nullable_long(at(2)).alias("font_size"),
        X.nullable_long(at(3)).alias("color"),
        X.nullable_long(at(4)).alias("created"),
        X.nullable_long(at(5)).alias("pool"),
        blank(at(6)).alias("user_hash"),
        blank(at(7)).alias("row_id"),
        "text",
        F.when(F.coalesce("p", F.lit("")) != "", f).otherwise(F.array().cast("array<string>")).alias("raw_fields"),
        F.lit(True).alias("enabled"),
    )


def warnings(found: DataFrame) -> DataFrame:
    """asset_id, original_index, severity, code and snippet of everything odd in ``elements`` or ``parsed``: an element
    without p has ``missingFields``, ``fewFields`` and ``badTime``; a file's error has no original_index."""
    f = F.when(F.coalesce("p", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("p", ","))
    w = lambda cond, code: F.when(cond, F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code")))
    time = X.decimal_seconds_ms(F.try_element_at(f, F.lit(1)))
    odd = [w(F.col("p").isNull(), "missingFields"), w(F.size(f) < 8, "fewFields"), w(time.isNull(), "badTime"), w(F.col("text") == "", "emptyText")]
    if "error" in found.columns:
        odd = [F.when(F.col("error").isNull(), x) for x in odd] + [F.when(F.col("error").isNotNull(), F.struct(F.lit("error").alias("severity"), F.col("error").alias("code")))]
    return found.select("asset_id", "original_index", F.explode(F.array_compact(F.array(*odd))).alias("w"), "snippet").select("asset_id", "original_index", "w.severity", "w.code", "snippet")


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lines(entries: DataFrame, final: str = "final_ms") -> DataFrame:
    """Each entry's element as text. Negative times become 0; fields are padded to eight, further raw ones stay."""
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default))
    own = F.array(X.xml_seconds(F.col(final)), text("mode", "1"), text("font_size", "25"), text("color", "16777215"), text("created", "0"), text("pool", "0"), text("user_hash", ""), text("row_id", ""))
    extra = F.when(F.size("raw_fields") > 8, F.slice("raw_fields", 9, 1_000)).otherwise(F.array().cast("array<string>"))
    p = F.array_join(F.concat(own, extra), ",")
    return entries.withColumn("line", F.concat(F.lit('  <d p="'), _escape(p), F.lit('">'), _escape(F.col("text")), F.lit("</d>")))


def documents(entries: DataFrame, target: str = "target_id", final: str = "final_ms") -> DataFrame:
    """One XML text per target, entries by (final time, original index). A target's file is one value by nature."""
    made = lines(entries, final)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(final), F.col("original_index"), F.col("line")))), lambda x: x["line"]), "\n")
    return made.groupBy(target).agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<i>\n'), body, F.lit("\n</i>\n")).alias("xml"), F.count("*").alias("n_entries"), F.count_if(F.col(final) < 0).alias("n_clamped"))


def parts(entries: DataFrame, head: Column, foot: Column, target: str = "target_id", final: str = "final_ms") -> DataFrame:
    """The texts of ``documents`` as rows (target, xml) ordered by part, at, place: head, a line for each entry, foot."""
    ends = entries.select(target).distinct().select(target, F.inline(F.array(*[F.struct(F.lit(k).alias("part"), x.alias("xml")) for k, x in ((0, head), (2, foot))])))
    ends = ends.select(target, "xml", "part", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("place"))
    made = lines(entries, final).select(target, F.concat("line", F.lit("\n")).alias("xml"), F.lit(1).alias("part"), F.col(final).cast("long").alias("at"), F.col("original_index").cast("long").alias("place"))
    return made.unionByName(ends)


def write_lines(entries: DataFrame, path: str, target: str = "target_id", final: str = "final_ms", partitions: int = 32) -> None:
    """For targets beyond one value: their lines as text files per target, sorted over all of the target's files."""
    made = lines(entries, final).repartitionByRange(partitions, target, final, "original_index").sortWithinPartitions(target, final, "original_index")
    made.select(target, F.col("line").alias("value")).write.partitionBy(target).text(path)


def round_trip(files: DataFrame) -> DataFrame:
    """Per file: elements, and how many times and texts survive writing and reading again."""
    first = items(elements(files))
    again = items(elements(documents(first.withColumn("final_ms", F.col("t_ms")).withColumnRenamed("asset_id", "target_id")).select(F.col("target_id").alias("asset_id"), "xml")))
    order = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("asset_id").orderBy("t_ms", "original_index")))
    a, b = order(first), order(again)
    j = a.alias("a").join(b.alias("b"), ["asset_id", "k"], "full_outer")
    return j.groupBy("asset_id").agg(F.count("a.item_id").alias("n_items"), F.count_if((F.col("a.t_ms") == F.col("b.t_ms")) & (F.col("a.text") == F.col("b.text"))).alias("n_same"))
