"""Records from semi-structured text: labelled fields, subjects, participants, movements, documents, list rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

# The labels that a detail page carries, and what tells lawyers from parties.
EXPECTED_LABELS = ["Número Processo", "Classe Judicial", "Assunto", "Jurisdição", "Órgão Julgador"]
LAWYER = "(?i)ADVOGAD|DEFENSOR|PROCURADOR"


def name_code(text: Column) -> Column:
    """`name (code)` as (name, code); without a code the whole text is the name."""
    clean = collapse(text)
    code = F.regexp_extract(clean, r"\((\d+)\)$", 1)
    before = F.rtrim(F.left(clean, F.length(clean) - F.length(code) - 2))
    return F.struct(F.when(code != "", before).otherwise(clean).alias("name"), F.when(code != "", code.cast("bigint")).alias("code"))


def subjects(text: Column) -> Column:
    """(level, code, name) of every `name (code` in the text, closed or not; what follows the last names one without code."""
    clean = collapse(text)
    bare = lambda c: F.trim(F.regexp_replace(c, r"^\s*-\s*", ""))
    # a part is a name up to its bracket and the digits after it; its two halves lie on either side of the bracket
    parts = F.regexp_extract_all(clean, F.lit(r"[^()]+\(\d+"), F.lit(0))
    halves = F.transform(parts, lambda p: F.struct(F.substring_index(p, "(", -1).cast("bigint").alias("code"), bare(F.substring_index(p, "(", 1)).alias("name")))
    found = F.filter(halves, lambda x: x["name"] != "")
    tail = bare(F.element_at(F.split(clean, r"[^()]+\(\d+\)?"), -1))
    rest = F.when(tail != "", F.array(F.struct(F.lit(None).cast("bigint").alias("code"), tail.alias("name")))).otherwise(F.array().cast("array<struct<code:bigint,name:string>>"))
    return F.transform(F.concat(found, rest), lambda x, k: F.struct(k.alias("level"), x["code"].alias("code"), x["name"].alias("name")))


def participant(line: Column) -> Column:
    """(name, uf, registration, doc_kind, doc, kind, lawyer) of one line; null if it has another shape.

    The line is read from its end: the kind in brackets, then a number after `CPF:` or `CNPJ:`, then a registration after
    `OAB`, each set off by a dash and each but the kind optional; what is left is the name."""
    clean = collapse(line)
    kind = F.regexp_extract(clean, r"\(([^)]+)\)$", 1)
    body = F.rtrim(F.left(clean, F.length(clean) - F.length(kind) - 2))
    number = r"\s*-\s*(CPF|CNPJ):\s*([0-9./-]+)$"
    named = F.regexp_replace(body, number, "")
    licence = r"\s*-\s*OAB\s+([A-Z][A-Z])([0-9]+)$"
    name = F.trim(F.regexp_replace(named, licence, ""))
    some = lambda c: F.nullif(c, F.lit(""))
    fields = {
        "name": name, "uf": some(F.regexp_extract(named, licence, 1)), "registration": some(F.regexp_extract(named, licence, 2)),
        "doc_kind": some(F.regexp_extract(body, number, 1)), "doc": some(F.regexp_extract(body, number, 2)), "kind": kind, "lawyer": kind.rlike(LAWYER),
    }
    return F.when((kind != "") & (name != ""), F.struct(*[c.alias(k) for k, c in fields.items()]))


def missing_labels(found: Column, expected: list[str] = EXPECTED_LABELS) -> Column:
    return F.array_except(F.array(*map(F.lit, expected)), found)


def enough_labels(found: Column, expected: list[str] = EXPECTED_LABELS) -> Column:
    """Half of the expected labels, rounded up, are there."""
    return F.size(F.array_intersect(F.array(*map(F.lit, expected)), found)) >= -(-len(expected) // 2)


def page_state(html: Column, cap: int) -> Column:
    """changed cap, truncated, empty, or rows; `never searched` if the page has no result count at all."""
    banner = F.regexp_extract(html, r"somente os (\d+) primeiros", 1)
    shape = r'<span class="text-muted">\s*(\d*)\s*resultados encontrados</span>'
    count = F.regexp_extract(html, shape, 1)
    return (
        F.when(~html.rlike(shape), "never searched").when((banner != "") & (banner != str(cap)), "cap changed")
        .when(banner != "", "truncated").when(F.coalesce(count.try_cast("int"), F.lit(0)) >= cap, "truncated").when((count == "") | (count == "0"), "empty").otherwise("rows")
    )


def documents_of(docs: Column) -> Column:
    """One cover, and a receipt for each document with a binary id. docs: (id_doc, id_bin)."""
    cover = F.array(F.struct(F.lit("cover").alias("kind"), F.lit(None).cast("string").alias("id_doc"), F.lit(None).cast("string").alias("id_bin")))
    with_bin = F.filter(docs, lambda d: d["id_bin"].isNotNull())
    return F.concat(cover, F.transform(with_bin, lambda d: F.struct(F.lit("receipt").alias("kind"), d["id_doc"].alias("id_doc"), d["id_bin"].alias("id_bin"))))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def ordinals(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Numbers from 0 within each key, in order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array in the order of the fields; without children, an empty one."""
    grouped = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


class _Detail(HTMLParser):
    """Labelled fields, panel lines, timed lines and document links of a detail page."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.fields: list[tuple[str, str]] = []
        self.bold: list[tuple[str, str]] = []
        self.lines: list[tuple[str, str]] = []
        self.moves: list[str] = []
        self.links: list[list[str]] = []
        self.chunks: list[tuple[str, bool]] = []
        self.heading = ""
        self.label: list | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if tag == "a":
            self.links.append([f"{a.get('onclick') or ''} {a.get('href') or ''}", ""])
            row = next((n for n in reversed(self.stack) if n["tag"] == "tr"), None)
            if row is not None:
                row["links"].append(self.links[-1])
        if tag in self.VOID:
            return
        node = {"tag": tag, "names": names, "from": len(self.chunks), "links": [], "inner": False, "label": None, "value": None}
        for up in self.stack:
            if "propertyView" in names and "propertyView" in up["names"]:
                up["inner"] = True
        self.stack.append(node)

    def handle_data(self, data):
        self.chunks.append((data, bool(self.stack) and self.stack[-1]["tag"] == "script"))
        if self.label is not None and not any(n["tag"] == "b" for n in self.stack):
            self.label[1].append(data)

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at]["tag"] == tag:
                while len(self.stack) > at:
                    self._close(self.stack.pop())
                return

    def _text(self, node, scripts=True):
        return " ".join("".join(x for x, script in self.chunks[node["from"] :] if scripts or not script).split())

    def _close(self, node):
        names, tag = node["names"], node["tag"]
        view = next((n for n in reversed(self.stack) if "propertyView" in n["names"]), None)
        inside = lambda name: any(name in n["names"] for n in self.stack)
        if tag == "label" and view is not None and inside("name") and view["label"] is None:
            view["label"] = self._text(node)
        if "value" in names and view is not None:
            self._end_bold()
            if view["value"] is None:
                view["value"] = self._text(node)
        if tag == "b" and view is not None and inside("value"):
            self._end_bold()
            self.label = [self._text(node), []]
        if "propertyView" in names and not node["inner"] and node["label"]:
            self.fields.append((node["label"], node["value"] or ""))
        if "rich-panel-header" in names:
            self.heading = self._text(node)
        if tag == "span" and "text-bold" in names:
            self.lines.append((self.heading, self._text(node)))
        if tag in ("td", "li", "div"):
            # only text that begins with a date can be a movement; others aren't put together, however deep they lie
            first = next((x.lstrip() for x, _ in self.chunks[node["from"] :] if x.strip()), "")
            if first[:1].isdigit():
                self.moves.append(self._text(node))
        if tag == "tr" and node["links"]:
            row = self._text(node, scripts=False)
            for link in node["links"]:
                link[1] = row

    def _end_bold(self):
        if self.label is not None:
            name, value = self.label[0], " ".join("".join(self.label[1]).split())
            if name and value:
                self.bold.append((name, value))
            self.label = None


_CLOCK = re.compile(r"\d\d/\d\d/\d{4}\s+\d\d:\d\d:\d\d")
DETAIL_SCHEMA = "fields array<struct<label:string,value:string>>, participants array<struct<heading:string,line:string>>, movements array<struct<at:string,text:string>>, documents array<struct<id_doc:string,id_bin:string>>, document_rows array<struct<id_doc:string,kind:string,at:string,title:string>>"


def timed(text: str, begin: int = 0) -> tuple[str, str, int] | None:
    """(date and time, what follows the dash after it, where that search ended) of the first such place from `begin` on."""
    for m in _CLOCK.finditer(text, begin):
        rest = text[m.end() :].lstrip()
        if rest[:1] in ("-", "–") and rest[1:].strip():
            return m[0], rest[1:].strip(), m.end()
    return None


def described(row: str) -> tuple[str, str | None, str | None]:
    """(kind, date and time, title) of a document's row: `date time - kind (title)`, the title optional. Kinds and titles
    are up to 120 characters long, a kind without a title up to 80."""
    found = timed(row)
    while found is not None:
        at, rest, end = found
        kind, bracket, more = rest.partition("(")
        title, closed, _ = more.partition(")")
        if bracket and closed and 0 < len(kind.strip()) <= 120 and len(title) <= 120:
            return kind.strip(), at, title.strip() or None
        if len(rest) <= 80:
            return rest, at, None
        found = timed(row, end)
    return "documento", None, None


def link_ids(link: str) -> tuple[str, str] | None:
    """(document id, binary id) of the first quoted part of a link that names both."""
    for part in re.split("[\"']", re.sub(r"\\x2d", "-", link, flags=re.IGNORECASE)):
        ids = dict(re.findall(r"(idBin|idProcessoDoc)=(\d+)", part))
        if len(ids) == 2:
            return ids["idProcessoDoc"], ids["idBin"]
    return None


def detail(html: str | None) -> dict:
    """Fields (the first value of each label), participants' lines by panel, timed lines, and documents."""
    parser = _Detail()
    parser.feed(html or "")
    parser.close()
    fields: dict[str, str] = {}
    for name, value in parser.fields + parser.bold:
        fields.setdefault(name, value)
    moves = dict.fromkeys((m[0], m[1]) for t, m in ((t, timed(t)) for t in parser.moves) if m and t.startswith(m[0]))
    documents: dict[str, tuple] = {}
    for link, row in parser.links:
        ids = link_ids(link)
        if ids:
            documents.setdefault(ids[0], (ids[1], *described(row)))
    return {
        "fields": [{"label": k, "value": v} for k, v in fields.items()], "participants": [{"heading": h, "line": x} for h, x in parser.lines],
        "movements": [{"at": a, "text": t} for a, t in moves],
        "documents": [{"id_doc": k, "id_bin": v[0]} for k, v in sorted(documents.items())],
        "document_rows": [{"id_doc": k, "kind": v[1], "at": v[2], "title": v[3]} for k, v in sorted(documents.items())],
    }


def parse_details(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and the columns of DETAIL_SCHEMA for each page; the only step that needs a parser in Python."""
    struct = pa.struct([
        ("fields", pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))), ("participants", pa.list_(pa.struct([("heading", pa.string()), ("line", pa.string())]))),
        ("movements", pa.list_(pa.struct([("at", pa.string()), ("text", pa.string())]))), ("documents", pa.list_(pa.struct([(c, pa.string()) for c in ("id_doc", "id_bin")]))),
        ("document_rows", pa.list_(pa.struct([(c, pa.string()) for c in ("id_doc", "kind", "at", "title")]))),
    ])

    def run(batches):
        for batch in batches:
            found = pa.array([detail(x) for x in batch.column(1).to_pylist()], struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], names=[key, *(f.name for f in struct)])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {DETAIL_SCHEMA}")
