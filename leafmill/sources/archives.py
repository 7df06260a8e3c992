"""Sinks: page groups as ZIP archives and paragraphs as DOCX files, one row for each file."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def _written(members: list[tuple[str, bytes]], method: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, method)
    return out.getvalue()


def zipped(members: DataFrame, key: str) -> DataFrame:
    """members (key, ord, name, data) -> (key, archive): stored ZIP files, members in order. A plan holds 100 members at most."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        return pd.DataFrame({key: [group[key].iloc[0]], "archive": [_written([(n, bytes(d)) for n, d in zip(group["name"], group["data"], strict=True)], zipfile.ZIP_STORED)]})

    return members.select(key, "ord", "name", "data").groupBy(key).applyInPandas(pack, f"{key} {dict(members.dtypes)[key]}, archive binary")


def exportable(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Documents with characters and without an error among their issues (doc_id, severity)."""
    return docs.where("characters > 0").join(issues.where("severity = 'error'"), "doc_id", "left_anti")


def docx(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (doc_id, page, paragraph, text, role, align, size) -> (doc_id, docx).

    Headings are bold, lists indented; a new page begins with a page break.
    """

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["page", "paragraph"])
        body, last = [], None
        for p in group.itertuples(index=False):
            align = f'<w:jc w:val="{p.align}"/>' if p.align != "left" else ""
            indent = '<w:ind w:left="360" w:hanging="360"/>' if p.role == "list" else ""
            page = "<w:pageBreakBefore/>" if last is not None and p.page != last else ""
            bold = "<w:b/>" if p.role == "heading" else ""
            size = f'<w:sz w:val="{int(p.size * 2 + 0.5)}"/>'
            lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape("".join(c for c in t if c >= " "))}</w:t>' for t in p.text.split("\n"))
            body.append(f"<w:p><w:pPr>{page}{indent}{align}</w:pPr><w:r><w:rPr>{bold}{size}</w:rPr>{lines}</w:r></w:p>")
            last = p.page
        document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document {W_NS}><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'
        members = [("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)]
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "docx": [_written([(n, d.encode()) for n, d in members], zipfile.ZIP_DEFLATED)]})

    kept = paragraphs.select("doc_id", "page", "paragraph", "text", "role", "align", "size")
    return kept.groupBy("doc_id").applyInPandas(write, f"doc_id {dict(paragraphs.dtypes)['doc_id']}, docx binary")
