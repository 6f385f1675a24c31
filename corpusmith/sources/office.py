"""Office files to markdown: packages (a ZIP of XML: docx, xlsx, pptx, odt, ods, odp, epub) and RTF.

A file's bytes stand in one row, so a table of files spreads by file. XML passes as a stream of events and no tree is
built: memory follows the text, not the markup. What kind of package a file is, its members say, not its name.
Headings become `#` lines, list items `- ` lines, tables pipe tables; sheets and slides get a heading of the second level.
Deleted text, comments, notes and fallbacks of drawings are left out; blank paragraphs go. A file that is damaged, encrypted,
declares entities or unpacks to more than MOST_UNPACKED bytes yields no text, but the reason.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.parsers import expat

#: Formats that are read here.
FORMATS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "rtf")
#: The most bytes that the members read of one package may unpack to together, repeated cells included.
MOST_UNPACKED = 1 << 30
#: White space of markdown; columns of a sheet at most.
BLANK, COLUMNS = " \t\r\n\f\v", 16_384
#: Elements that hold no text of the document.
HIDDEN = frozenset({"Fallback", "del", "moveFrom", "tabs", "tabLst", "rPh", "tracked-changes", "annotation", "notes", "note", "forms"})
#: Groups of RTF that hold no text of the document.
ASIDE = frozenset({"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "footnote", "annotation", "fldinst", "listtable", "listoverridetable"})
#: RTF control words that stand for a sign.
SIGNS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "emspace": " ", "enspace": " "}
#: Elements of all formats by what they do to the text.
TABLES, ROWS, CELLS, PARAGRAPHS = {"tbl", "table"}, {"tr", "table-row"}, {"tc", "table-cell", "covered-table-cell"}, {"p", "h"}
#: Signs that blanks of an open document do not run together with; XML can't hold them.
SPACE, TAB, BREAK = "\x00", "\x01", "\x02"


class Damaged(Exception):
    """The file is not what it says, or more than what is read."""


class Package:
    """Members of a ZIP by name, within the bound of what is unpacked."""

    def __init__(self, content: bytes):
        self.zip, self.left = zipfile.ZipFile(io.BytesIO(content)), MOST_UNPACKED
        self.names = set(self.zip.namelist())

    def spend(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise Damaged("unpacks to too much")

    def pieces(self, name: str) -> Iterator[bytes]:
        with self.zip.open(name) as stream:
            while piece := stream.read(1 << 16):
                self.spend(len(piece))
                yield piece

    def events(self, name: str) -> Iterator[tuple[str, str, dict]]:
        """(start, tag, attributes), (text, what it says, {}) and (end, tag, {}), outside of hidden elements. Tags lose their
        namespace; an attribute in one has a colon before its name."""
        found, hidden = [], 0

        def start(tag, attributes):
            nonlocal hidden
            tag = tag.rpartition("}")[2]
            hidden += tag in HIDDEN
            if not hidden:
                found.append(("start", tag, {":" + k.rpartition("}")[2] if "}" in k else k: v for k, v in attributes.items()}))

        def end(tag):
            nonlocal hidden
            tag = tag.rpartition("}")[2]
            if not hidden:
                found.append(("end", tag, {}))
            hidden -= tag in HIDDEN

        def refuse(*_):
            raise Damaged("declares entities")

        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, refuse
        parser.CharacterDataHandler = lambda text: None if hidden else found.append(("text", text, {}))
        for piece in self.pieces(name):
            parser.Parse(piece, False)
            yield from found
            found.clear()
        parser.Parse(b"", True)
        yield from found

    def starts(self, name: str, tag: str) -> list[dict]:
        return [a for event, t, a in self.events(name) if event == "start" and t == tag]

    def linked(self, part: str, ids: list[str | None]) -> list[str | None]:
        """The members that a part's relations of these ids lead to."""
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        found = self.starts(rels, "Relationship") if rels in self.names else []
        to = {a.get("Id"): posixpath.normpath(posixpath.join("/", folder, a.get("Target", ""))).lstrip("/") for a in found}
        return [to[k] if to.get(k) in self.names else None for k in ids]


def pipe_table(rows: list[list[str]]) -> str:
    """A table as wide as its last cell that says something, without blank rows at its end."""
    rows = [[re.sub(r"\s*\n\s*", " ", c.strip(BLANK)).replace("|", "\\|") for c in r] for r in rows]
    while rows and not any(rows[-1]):
        rows.pop()
    width = max((max((k + 1 for k, c in enumerate(r) if c), default=0) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class Writer:
    """Blocks of markdown. Inside a table a block belongs to the last cell; so does a table within a table."""

    def __init__(self):
        self.blocks: list[str] = []
        self.tables: list[list[list[str]]] = []

    def block(self, text: str, head: int = 0, item: bool = False) -> None:
        if not text.strip(BLANK):
            return
        if not self.tables:
            self.blocks.append("#" * min(head, 6) + " " + text.strip(BLANK) if head else "- " + text.strip(BLANK) if item else text)
        elif self.tables[-1] and self.tables[-1][-1]:
            row = self.tables[-1][-1]
            row[-1] = f"{row[-1]}\n{text}" if row[-1] else text

    def end_table(self) -> None:
        if self.tables:
            self.block(pipe_table(self.tables.pop()))

    def text(self) -> str:
        return "\n\n".join(self.blocks)


def flow(package: Package, member: str, out: Writer, runs: bool) -> None:
    """Paragraphs, headings, list items and tables of a member. runs: only text in `t` elements counts and its blanks
    stay; else all text in a paragraph counts and blanks run together."""
    # Text boxes put paragraphs into paragraphs: [pieces, level of the heading, is an item] of each that is open.
    opened, taking, depth, title, sheet = [], not runs, 0, 0, False
    cells, rows = 1, 1
    for event, tag, a in package.events(member):
        if event == "text":
            if opened and taking:
                opened[-1][0].append(tag if runs else re.sub(r"[ \t\r\n]", " ", tag))
        elif event == "start":
            if tag in PARAGRAPHS:
                opened.append([[], int(a.get(":outline-level", 1)) if tag == "h" else title, depth > 0])
            elif tag == "t":
                taking = True
            elif (tag in ("tab", "br", "cr", "line-break") or tag == "s" and not runs) and opened:
                sign = TAB if tag == "tab" else SPACE * min(int(a.get(":c", 1)), 1 << 16) if tag == "s" else BREAK
                opened[-1][0].append(sign)
            elif tag == "pStyle" and opened:
                style = a.get(":val", "").lower().replace(" ", "")
                level = re.fullmatch(r"heading([1-9])", style)
                opened[-1][1] = int(level[1]) if level else int(style == "title")
            elif tag == "numPr" and opened:
                opened[-1][2] = True
            elif tag == "list-item":
                depth += 1
            elif tag == "sp":
                title = 0
            elif tag == "ph":
                title = 2 * (a.get("type") in ("title", "ctrTitle"))
            elif tag == "spreadsheet":
                sheet = True
            elif tag == "page" and ":name" in a:
                out.block(a[":name"], 2)
            elif tag in TABLES:
                if sheet and not out.tables:
                    out.block(a.get(":name", ""), 2)
                out.tables.append([])
            elif tag in ROWS and out.tables:
                rows = int(a.get(":number-rows-repeated", 1))
                out.tables[-1].append([])
            elif tag in CELLS and out.tables and out.tables[-1]:
                cells = int(a.get(":number-columns-repeated", 1))
                out.tables[-1][-1].append("")
        elif tag in PARAGRAPHS and opened:
            pieces, head, item = opened.pop()
            text = "".join(pieces) if runs else re.sub(" +", " ", "".join(pieces)).strip(" ")
            out.block(text.replace(SPACE, " ").replace(TAB, "\t").replace(BREAK, "\n"), head, item)
        elif tag == "t":
            taking = not runs
        elif tag == "list-item":
            depth -= 1
        elif tag in CELLS and out.tables and out.tables[-1] and cells > 1:
            row = out.tables[-1][-1]
            package.spend(len(row[-1]) * cells)
            row += [row[-1]] * (min(cells, COLUMNS) - 1)
            cells = 1
        elif tag in ROWS and out.tables and rows > 1:
            row, rows = out.tables[-1][-1], rows - 1
            if any(row):
                package.spend(sum(map(len, row)) * rows)
                out.tables[-1] += [row] * rows
            rows = 1
        elif tag in TABLES:
            out.end_table()


def slides(package: Package, out: Writer) -> None:
    part = "ppt/presentation.xml"
    for slide in package.linked(part, [a.get(":id") for a in package.starts(part, "sldId")]):
        if slide:
            flow(package, slide, out, runs=True)


def column(reference: str) -> int:
    """The place, from 0, of a cell such as AB12."""
    at = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def sheets(package: Package, out: Writer) -> None:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in package.names:
        taking = False
        for event, tag, _ in package.events("xl/sharedStrings.xml"):
            if event == "text" and taking:
                shared[-1] += tag
            elif event == "start" and tag == "si":
                shared.append("")
            elif event != "text" and tag == "t":
                taking = event == "start"
    part = "xl/workbook.xml"
    named = package.starts(part, "sheet")
    for sheet, member in zip(named, package.linked(part, [a.get(":id") for a in named])):
        if not member:
            continue
        rows, kind, at, value, taking = [], "n", 0, "", False
        for event, tag, a in package.events(member):
            if event == "text":
                value += tag if taking else ""
            elif tag in ("v", "t"):
                taking = event == "start"
            elif event == "start" and tag == "row":
                rows.append([])
            elif event == "start" and tag == "c":
                at, kind, value = column(a["r"]) if "r" in a else len(rows[-1]), a.get("t", "n"), ""
            elif event == "end" and tag == "c" and value:
                if not 0 <= at < COLUMNS:
                    raise Damaged("cell beyond the last column")
                text = shared[int(value)] if kind == "s" else ("FALSE", "TRUE")[value == "1"] if kind == "b" else value
                package.spend(len(text) + at)
                rows[-1] += [""] * (at + 1 - len(rows[-1]))
                rows[-1][at] = text
        body = pipe_table(rows)
        if body:
            out.block(sheet.get("name", ""), 2)
            out.block(body)


def book(package: Package) -> str:
    """The bodies of an EPUB in reading order, as HTML."""
    root = package.starts("META-INF/container.xml", "rootfile")[0]["full-path"]
    places = {a.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(a.get("href", "")))) for a in package.starts(root, "item")}
    bodies = []
    for a in package.starts(root, "itemref"):
        place = places.get(a.get("idref"))
        if place in package.names:
            page = b"".join(package.pieces(place)).decode("utf-8", "replace")
            body = re.search(r"(?is)<body\b[^>]*>(.*)</body\s*>", page)
            # A heading ends its line.
            bodies.append(re.sub(r"(?i)(</h[1-6]\s*>)", r"\1<br/>", body[1] if body else page))
    return "\n\n".join(bodies)


TOKEN = re.compile(rb"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}]+)", re.S)


def rich(content: bytes) -> str:
    """RTF by a stack of groups: (hidden, signs that follow a Unicode sign for readers without Unicode)."""
    if not content.startswith(b"{\\rtf"):
        raise Damaged("no RTF")
    out, pieces, raw, codec = Writer(), [], bytearray(), "cp1252"
    stack, hidden, after, skip, at = [], False, 1, 0, 0
    head, in_table, cells, table = 0, False, [], []

    def flush():
        if raw:
            pieces.append(raw.decode(codec, "replace"))
            raw.clear()

    def taken() -> str:
        flush()
        text = "".join(pieces).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
        pieces.clear()
        return text

    def end_table():
        out.block(pipe_table(table))
        table.clear()

    while token := TOKEN.match(content, at):
        at = token.end()
        name, number, byte, sign, brace, plain = token.groups()
        if brace == b"{":
            stack.append((hidden, after))
            skip = 0
        elif brace:
            if not stack:
                raise Damaged("closes a group that is not open")
            hidden, after = stack.pop()
            skip = 0
            if not stack:
                break
        elif plain is not None or byte is not None:
            said = bytes([int(byte, 16)]) if byte else plain.translate(None, b"\r\n")
            said, skip = said[skip:], max(0, skip - len(said))
            if not hidden:
                raw += said
        elif sign is not None:
            if sign == b"*":
                hidden = True
            elif skip:
                skip -= 1
            elif not hidden:
                if sign in b"\\{}":
                    raw += sign
                elif sign in b"~_":
                    flush()
                    pieces.append("\xa0" if sign == b"~" else "-")
                elif sign in b"\r\n":
                    out.block(taken(), head)
        elif name == b"bin":
            at += max(int(number or 0), 0)
        elif name in (b"uc", b"ansicpg") and number:
            if name == b"uc":
                after = max(int(number), 0)
            else:
                flush()
                codec = f"cp{int(number)}" if int(number) != 65001 else "utf-8"
        elif name.decode() in ASIDE:
            hidden = True
        elif not hidden:
            word = name.decode()
            if word == "u" and number:
                flush()
                pieces.append(chr(int(number) & 0xFFFF))
                skip = after
            elif word in SIGNS:
                flush()
                pieces.append(SIGNS[word])
            elif word == "pard":
                head, in_table = 0, False
            elif word == "intbl":
                in_table = True
            elif word == "outlinelevel" and number:
                head = int(number) + 1 if 0 <= int(number) < 9 else 0
            elif word == "cell":
                cells.append(taken())
            elif word == "row":
                table.append(cells)
                cells = []
            elif word in ("par", "sect", "page"):
                if in_table:
                    flush()
                    pieces.append("\n")
                else:
                    end_table()
                    out.block(taken(), head)
    if stack:
        raise Damaged("ends inside a group")
    end_table()
    out.block(taken(), head)
    return out.text()


def read(content: bytes) -> tuple[str | None, str | None, str | None]:
    """(markdown, HTML, reason): one of the three is there."""
    try:
        if content.startswith(b"{\\rtf"):
            return rich(content), None, None
        package, out = Package(content), Writer()
        if "word/document.xml" in package.names:
            flow(package, "word/document.xml", out, runs=True)
        elif "xl/workbook.xml" in package.names:
            sheets(package, out)
        elif "ppt/presentation.xml" in package.names:
            slides(package, out)
        elif "META-INF/container.xml" in package.names:
            return None, book(package), None
        elif "content.xml" in package.names:
            flow(package, "content.xml", out, runs=False)
        else:
            return None, None, "no package of a known kind"
        return out.text(), None, None
    except (Damaged, zipfile.BadZipFile, zlib.error, expat.ExpatError, LookupError, ValueError, EOFError, RuntimeError, OSError) as e:
        return None, None, f"{type(e).__name__}: {e}"[:200]
