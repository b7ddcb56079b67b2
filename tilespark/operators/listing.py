"""Result lists and search forms: grid rows by the ids of their cells, form metadata, and the canaries that watch a site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import find_case_number
from ..functions.text import collapse, has_mojibake, unescape

# How the site names its grid, its form and the fields that a search needs.
GRID, FORM = "fPP:processosTable", "fPP"
REQUIRED_FIELDS = [
    "fPP:numProcesso-inputNumeroProcessoDecoration:numProcesso-inputNumeroProcesso",
    "fPP:dnp:nomeParte",
    "fPP:dpDec:documentoParte",
    "fPP:Decoration:numeroOAB",
    "fPP:Decoration:estadoComboOAB",
    "fPP:dataAutuacaoDecoration:dataAutuacaoInicioInputDate",
    "fPP:dataAutuacaoDecoration:dataAutuacaoFimInputDate",
    "javax.faces.ViewState",
]
#: Checks by name: severity and what must hold. New ones are added with `register_check`.
CHECKS: dict[str, tuple[str, str]] = {
    "C-1": ("error", "the page yields a search action"),
    "C-2": ("error", "the captcha is off"),
    "C-3": ("error", "the form has every field that a search needs"),
    "C-4": ("error", "the row cap is the one the partitions were resolved with"),
    "C-5": ("error", "the golden probe gives the rows it gave before"),
    "C-6": ("error", "fewer than ten texts carry a mojibake signature"),
    "C-7": ("error", "no three pages in a row miss their labels"),
    "C-8": ("warn", "probes outside the range are empty"),
    "C-9": ("warn", "no case is in two disjoint leaves"),
    "C-10": ("error", "the answer is no rejection page"),
}


def register_check(name: str, severity: str, holds: str) -> None:
    if name in CHECKS or severity not in ("error", "warn"):
        raise ValueError(f"check {name!r} is there already, or its severity {severity!r} is unknown")
    CHECKS[name] = (severity, holds)


def decoded(text: Column) -> Column:
    """The common character references as characters."""
    pairs = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def plain_text(html: Column) -> Column:
    return decoded(F.regexp_replace(html, r"(?s)<script\b.*?</script>|<[^>]*>", ""))


def _row(cells: Column) -> dict[str, Column]:
    inner = lambda cell: F.regexp_extract(cell, r"(?s)^<td\b[^>]*>(.*)</td>$", 1)
    bold_mark = r'(?s)<b\b[^>]*\bbtn-block\b[^>]*>(.*?)</b>'
    described = F.coalesce(F.get(F.filter(cells, lambda c: c.rlike(bold_mark)), F.lit(0)), F.get(cells, F.lit(1)), F.lit(""))
    lead = F.regexp_extract(inner(described), r"^[^<]*", 0)
    bold = F.split(plain_text(F.regexp_extract(described, bold_mark, 1)), " - ")
    # what stands outside of elements, in order; elements of one kind aren't nested in each other here
    loose = F.filter(F.split(F.regexp_replace(inner(described), r"(?s)<(\w+)\b[^>]*(?<!/)>.*?</\1>|<[^>]*>", "\x01"), "\x01"), lambda x: F.trim(x) != "")
    last = collapse(plain_text(F.element_at(cells, -1)))
    at = F.regexp_extract(last, r"\((\d\d/\d\d/\d{4} \d\d:\d\d:\d\d)\)$", 1)
    onclick = F.regexp_extract(F.array_join(cells, ""), r'onclick="([^"]*ca=[^"]*)"', 1)
    some = lambda c: F.nullif(c, F.lit(""))
    return {
        "number": find_case_number(F.array_join(F.transform(cells, plain_text), "\n")),
        "token": F.regexp_extract(unescape(decoded(onclick)), r"[?&]ca=([0-9a-fA-F]+)", 1),
        "class": collapse(decoded(F.when(lead != "", lead).otherwise(F.substring_index(plain_text(described), "\n", 1)))),
        "sigla": some(F.regexp_extract(F.get(bold, F.lit(0)), r"^\S*", 0)),
        "subject": collapse(F.array_join(F.slice(bold, 2, F.greatest(F.size(bold) - 1, F.lit(0))), " - ")),
        "parties": collapse(decoded(F.coalesce(F.try_element_at(loose, F.lit(-1)), F.lit("")))),
        "movement": F.when(at != "", F.rtrim(F.left(last, F.length(last) - F.length(at) - 2))),
        "moved_at": some(at),
    }


def list_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each record of a result grid: key, id, number, token, class, sigla, subject, parties, movement, moved_at and
    whether a text carries a mojibake signature.

    A record's cells are those whose ids name it, in page order; records without a case number are left out, as are pages
    that are null or hold no grid. An id that comes twice in a page is one record."""
    shape = rf'(?s)<td\b[^>]*\bid="{GRID}:\d+:[^>]*>.*?</td>'
    cells = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(shape), F.lit(0))).alias("pos", "cell"))
    cells = cells.withColumn("id", F.regexp_extract("cell", rf'\bid="{GRID}:(\d+):', 1).cast("bigint"))
    grouped = cells.groupBy(key, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "cell"))), lambda x: x["cell"]).alias("cells"))
    fields = _row(F.col("cells"))
    found = grouped.select(key, "id", *[c.alias(k) for k, c in fields.items()]).where("number is not null")
    texts = [F.coalesce(F.col(k), F.lit("")) for k in ("class", "subject", "parties", "movement")]
    return found.withColumn("mojibake", reduce(lambda a, b: a | b, (has_mojibake(t) for t in texts)))


def form_meta(html: Column) -> Column:
    """(action, action_id, view_state, captcha, fields, problem) of a search page; problem is the first canary that it trips,
    null if none. A null page has the problem of one without a form."""
    html = F.coalesce(html, F.lit(""))
    form = F.regexp_extract(html, rf'(?s)<form id="{FORM}".*?</form>', 0)
    take = lambda shape: F.nullif(F.regexp_extract(html, shape, 1), F.lit(""))
    action = take(rf'<form id="{FORM}"[^>]*action="([^"]+)"')
    action_id = take(rf"(?s)executarPesquisa\s*=\s*function\s*\(\)\s*\{{.{{0,400}}?'parameters'\s*:\s*\{{\s*'({FORM}:j_id\d+)'")
    state = r'name="javax\.faces\.ViewState"[^>]*value="([^"]*)"'
    captcha = ~html.rlike(r"function\s+executarReCaptcha\s*\(\s*\)\s*\{\s*if\s*\(\s*false\s*\)")
    names = F.regexp_extract_all(form, F.lit(r'<(?:input|select|textarea)\b[^>]*?\bname="([^"]+)"'), F.lit(1))
    names = F.array_distinct(F.when(html.rlike(state), F.array_append(names, F.lit("javax.faces.ViewState"))).otherwise(names))
    missing = F.size(F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), names)) > 0
    problem = (
        F.when(html.rlike(r"(?i)Requisi[^<]{0,20}Rejeitada"), "C-10").when(action.isNull(), "C-3").when(action_id.isNull(), "C-1").when(~html.rlike(state), "C-3")
        .when(captcha | html.contains('name="g-recaptcha-response"'), "C-2").when(missing, "C-3")
    )
    return F.struct(action.alias("action"), action_id.alias("action_id"), F.regexp_extract(html, state, 1).alias("view_state"), captcha.alias("captcha"), names.alias("fields"), problem.alias("problem"))


def canaries(observed: DataFrame, cap: int, golden: int) -> DataFrame:
    """(id, severity, ok, evidence) for each check: observed has a row for each thing seen: (seq, kind, value), kind being
    `form` (value: the problem or null), `cap`, `golden`, `mojibake`, `labels` (1 if a page missed its labels, in order of
    seq), `edge` (rows found) or `overlap` (cases in two leaves). What was not seen holds."""
    kind, value = F.col("kind"), F.col("value")
    number = value.try_cast("bigint")
    # a run of three: the same page and the two label pages before it
    labels = F.sort_array(F.collect_list(F.when(kind == "labels", F.struct("seq", number.alias("bad")))))
    three = F.aggregate(labels, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), lambda a, x: F.struct(F.when(x["bad"] == 1, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["most"], F.when(x["bad"] == 1, a["run"] + 1).otherwise(0)).alias("most")))["most"]
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    bad = {
        **{c: count((kind == "form") & (value == c)) for c in ("C-1", "C-2", "C-3", "C-10")},
        "C-4": count((kind == "cap") & (number != cap)), "C-5": count((kind == "golden") & (number != golden)),
        "C-6": F.coalesce(F.sum(F.when(kind == "mojibake", number)), F.lit(0)), "C-7": three.cast("bigint"),
        "C-8": count((kind == "edge") & (number > 0)), "C-9": count((kind == "overlap") & (number > 0)),
    }
    allowed = {"C-6": 9, "C-7": 2}
    rows = [F.struct(F.lit(i).alias("id"), F.lit(CHECKS[i][0]).alias("severity"), (c <= allowed.get(i, 0)).alias("ok"), c.alias("evidence")) for i, c in bad.items()]
    return observed.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
