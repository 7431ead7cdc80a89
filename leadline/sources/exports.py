"""Exports of tabs as documents."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.operators.ordered import numbered, quoted
from leadline.sources import union_tabs
from leadline.sources.sheets import letters

#: Rows and letters of a title that a spreadsheet takes.
ROWS, TITLE = 1_048_576, 31
#: Quotes inside a value are doubled; an empty text is quoted, a missing one is nothing.
CSV = {"escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def one_file(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a written folder as one file, in their order: bytes from one stream into another, nothing is held."""
    from leadline.sources.shared import path_of

    fs, p = path_of(spark, folder)
    target = path_of(spark, path)[1]
    out = fs.create(target, True)
    try:
        for part in sorted(str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")):
            source = fs.open(path_of(spark, part)[1])
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            source.close()
    finally:
        out.close()


def csv(tabs: dict[str, DataFrame], path: str) -> None:
    """A single tab as it is, several under one header with the tab's name first: part files in path, all but the first without header, which
    stand for one document in their order."""
    one = next(iter(tabs.values())) if len(tabs) == 1 else union_tabs(tabs)
    text = one.select(F.to_csv(F.struct(*[F.col(quoted(c)) for c in one.columns]), CSV).alias("x"))
    names = one.sparkSession.createDataFrame([tuple(one.columns)], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(one.columns))]))
    header = names.select(F.to_csv(F.struct("*"), CSV).alias("x")).coalesce(1)
    header.union(text).write.mode("overwrite").text(path)


def json_lines(tabs: dict[str, DataFrame]) -> DataFrame:
    """(t, n, x): the lines of one document in order, a list of rows of a single tab, {tab: rows} of several."""
    lines, last = None, len(tabs) - 1
    for i, (name, df) in enumerate(tabs.items()):
        text = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"})
        rows = numbered(df.select(text.alias("x")), "x", name="n")
        rows = rows.select(F.lit(i).alias("t"), "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "x").alias("x"))
        name = name.replace("\\", "\\\\").replace('"', '\\"')
        head, tail = ("[", "]") if not last else (("{" if i == 0 else ",") + f'"{name}":[', "]" + ("}" if i == last else ""))
        ends = df.sparkSession.createDataFrame([(i, 0, head), (i, 1 << 62, tail)], "t int, n long, x string")
        part = rows.unionByName(ends)
        lines = part if lines is None else lines.unionByName(part)
    return lines


def json(tabs: dict[str, DataFrame], path: str) -> None:
    """One document as part files in path, whose order is its own: each is a range of its lines."""
    json_lines(tabs).orderBy("t", "n").select("x").write.mode("overwrite").text(path)


def _sheet(columns: list[str], rows: Iterator) -> Iterator[str]:
    wide, n = letters(len(columns)), 1
    cells = lambda n, values: f'<row r="{n}">' + "".join(f'<c r="{letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_clean(v))}</t></is></c>' for i, v in enumerate(values, 1)) + "</row>"
    yield '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
    yield cells(1, columns)
    for n, row in enumerate(rows, 2):
        if n > ROWS:
            raise ValueError(f"a sheet takes {ROWS} rows")
        yield cells(n, row)
    yield f'</sheetData><autoFilter ref="A1:{wide}{n}"/></worksheet>'


def _clean(value) -> str:
    return re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", "" if value is None else str(value))


def titles(names) -> list[str]:
    """Titles of sheets: 31 letters, without what a title can't hold, each once."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\]", " ", name)[:TITLE] or "Sheet"
        title, k = base, 1
        while title.lower() in [t.lower() for t in out]:
            k += 1
            title = f"{base[: TITLE - len(str(k)) - 1]}~{k}"
        out.append(title)
    return out


def xlsx(tabs: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each tab: frozen header, filters. Rows come to the driver a partition at a time."""
    names = titles(tabs)
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    n = range(1, len(names) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rels}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(n, names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, df in zip(n, tabs.values()):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                for text in _sheet(df.columns, df.toLocalIterator()):
                    f.write(text.encode())


WRITERS = {"csv": csv, "json": json, "xlsx": xlsx}


def export(tabs: dict[str, DataFrame], kind: str, path: str, note: Callable[[dict], None] = lambda state: None) -> dict:
    """Writes the tabs and tells of it: RUNNING, then COMPLETED or FAILED with the first 1,000 letters of what went wrong."""
    state = {"status": "RUNNING", "kind": kind, "path": path, "error": None}
    note(dict(state))
    try:
        WRITERS[kind](tabs, path)
        state["status"] = "COMPLETED"
    except Exception as e:  # noqa: BLE001  (whatever goes wrong is the export's state)
        state |= {"status": "FAILED", "error": f"{type(e).__name__}: {e}"[:1000]}
    note(dict(state))
    return state
