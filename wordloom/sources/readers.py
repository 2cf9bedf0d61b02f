"""Sources and sinks: text files, JSON lines, DOCX files, columns by name, JSON and CSV reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCX = "path string, unit int, kind string, text string, problem string"


def text_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path and text of whole files."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def manifest(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The rows of a JSON manifest (a list of objects with id and file), by id, with the text of each file below the folder; null where it lacks."""
    rows = spark.read.option("multiLine", True).json(path)
    files = text_files(spark, folder, "*").select(F.element_at(F.split("path", "/"), -1).alias("file"), "text")
    return rows.join(files, "file", "left").orderBy("id")


def halves(files: DataFrame) -> DataFrame:
    """files with half (train, holdout), by the checksum of the file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("half", F.when(F.crc32(name) % 2 == 0, "train").otherwise("holdout"))


def json_lines(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """text of a JSON-lines corpus; bad lines are left out, or with raw are texts themselves."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", "text string")["text"]
    return lines.select((F.coalesce(parsed, "value") if raw else parsed).alias("text")).where("text IS NOT NULL AND text <> ''")


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """Units (body paragraphs and table cells, in document order) of DOCX files; lock files are skipped.

    A file that can't be read gives one row with the problem, and the job goes on.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content")

    def units(frames: Iterator) -> Iterator:
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def paragraphs(node, kind: str):
            for child in node:
                if child.tag == f"{w}p":
                    parts = ["\t" if t.tag == f"{w}tab" else "\n" if t.tag in (f"{w}br", f"{w}cr") else t.text or "" for t in child.iter() if t.tag in (f"{w}t", f"{w}tab", f"{w}br", f"{w}cr")]
                    yield kind, "".join(parts)
                elif child.tag == f"{w}tbl":
                    yield from (x for cell in child.iter(f"{w}tc") for x in paragraphs(cell, "cell"))
                elif child.tag in (f"{w}sdt", f"{w}sdtContent"):
                    yield from paragraphs(child, kind)

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
                    rows += [(name, i, kind, text, None) for i, (kind, text) in enumerate(paragraphs(body, "paragraph"))]
                except Exception as e:  # one broken file must not end a batch
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "unit", "kind", "text", "problem"])
            out["unit"] = out["unit"].astype("Int32")
            yield out

    return files.mapInPandas(units, DOCX)


def docx_texts(units: DataFrame) -> DataFrame:
    """path and text: the units' texts joined by line ends."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "text"))), lambda u: u["text"]), "\n")
    return units.where("problem IS NULL").groupBy("path").agg(joined.alias("text"))


XLSX = "path string, sheet string, row int, place int, value string, problem string"


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row and place (from 1), value of every cell of XLSX files that holds one; a formula's cell gives its stored value.

    Lock files are skipped; a file that can't be read gives one row with the problem.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).where(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content")

    def cells(frames: Iterator) -> Iterator:
        import io
        import posixpath
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

        def joined(node) -> str:
            return "".join(t.text or "" for t in node.iter(f"{main}t"))

        def sheet_cells(book):
            parse = lambda name: ElementTree.fromstring(book.read(name))
            shared = [joined(x) for x in parse("xl/sharedStrings.xml").iter(f"{main}si")] if "xl/sharedStrings.xml" in book.namelist() else []
            targets = {r.get("Id"): r.get("Target") for r in parse("xl/_rels/workbook.xml.rels")}
            for sheet in parse("xl/workbook.xml").iter(f"{main}sheet"):
                part = posixpath.normpath(posixpath.join("/xl", targets[sheet.get(link)])).lstrip("/")
                row = 0
                for line in parse(part).iter(f"{main}row"):
                    row, place = int(line.get("r", row + 1)), 0
                    for c in line.iter(f"{main}c"):
                        letters = "".join(x for x in c.get("r", "") if x.isalpha())
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        place = at or place + 1
                        held = c.find(f"{main}v")
                        value = joined(c) if c.get("t") == "inlineStr" else None if held is None else shared[int(held.text)] if c.get("t") == "s" else held.text
                        if value is not None:
                            yield sheet.get("name"), row, place, value

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [(name, *x, None) for x in list(sheet_cells(zipfile.ZipFile(io.BytesIO(content))))]
                except Exception as e:  # one broken file must not end a batch
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in XLSX.split(", ")])
            yield out.astype({"row": "Int32", "place": "Int32"})

    return files.mapInPandas(cells, XLSX)


def xlsx_column(cells: DataFrame, wanted: str | int, header_row: int = 1) -> DataFrame:
    """path, sheet, row, text of the column named by place, letter or header (without regard to case and blanks), below the header row.

    A header wins over a letter; a sheet without the column gives no rows, and where several have the header the first counts.
    """
    plain = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    by_place = int(wanted) if str(wanted).isdigit() else None
    if by_place is None and str(wanted).isalpha() and str(wanted).isascii() and len(str(wanted)) <= 3:
        by_place = 0
        for x in str(wanted).upper():
            by_place = by_place * 26 + ord(x) - 64
    named = cells.where((F.col("row") == header_row) & (plain(F.col("value")) == "".join(str(wanted).lower().split())) & F.lit(not str(wanted).isdigit()))
    named = named.groupBy("path", "sheet").agg(F.min("place").alias("at"))
    j = cells.where(F.col("row") > header_row).join(named, ["path", "sheet"], "left")
    return j.where(F.col("place") == F.coalesce("at", F.lit(by_place))).select("path", "sheet", "row", F.col("value").alias("text"))


def column(df: DataFrame, wanted: str | int) -> Column:
    """A column by its 1-based place, its letter, or its header without regard to case and blanks."""
    names = df.columns
    if isinstance(wanted, int) or str(wanted).isdigit():
        return F.col(f"`{names[int(wanted) - 1]}`")
    plain = lambda s: "".join(str(s).lower().split())
    for n in names:
        if plain(n) == plain(wanted):
            return F.col(f"`{n}`")
    if str(wanted).isalpha() and len(str(wanted)) <= 3:
        place = 0
        for c in str(wanted).upper():
            place = place * 26 + ord(c) - 64
        if place <= len(names):
            return F.col(f"`{names[place - 1]}`")
    raise ValueError(f"no column {wanted!r} in {names}")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
