"""Paper formats: JATS and Atom metadata, JATS and LaTeX bodies, archives, code files, site rules."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.session import ship
from quirelab.sources.tex_macros import expanded

#: Bounds of what an archive may hold: members, bytes unpacked, bytes unpacked for each packed one.
MEMBERS, UNPACKED, RATIO = 2_000, 200 << 20, 200
#: Files of code that are read, and folders that are not.
CODE = ("py", "js", "ts", "java", "c", "cc", "cpp", "h", "go", "rs", "jl", "r", "scala", "sh", "md")
NOT_CODE = r"(^|/)(\.git|node_modules|vendor|third_party|dist|build|__pycache__)/"
SECRET = r"(?i)(^|/)(\.env[^/]*|id_rsa[^/]*|[^/]*\.pem|[^/]*\.key|credentials[^/]*)$"


def jats_metadata(xml: Column) -> dict[str, Column]:
    """Ids, title, authors, journal, year, licence and abstract of a JATS article, in the JVM."""
    at = "/article/front/article-meta"
    some = lambda path: F.nullif(F.trim(F.regexp_replace(F.xpath_string(xml, F.lit(path)), r"\s+", " ")), F.lit(""))
    surnames, given = (F.xpath(xml, F.lit(f"{at}/contrib-group/contrib[@contrib-type='author']/name/{n}/text()")) for n in ("surname", "given-names"))
    return {
        "doi": some(f"{at}/article-id[@pub-id-type='doi']"),
        "pmid": some(f"{at}/article-id[@pub-id-type='pmid']"),
        "pmcid": some(f"{at}/article-id[@pub-id-type='pmc']"),
        "title": some(f"{at}/title-group/article-title"),
        "authors": F.zip_with(given, surnames, lambda g, s: F.concat_ws(" ", g, s)),
        "journal": some("/article/front/journal-meta//journal-title"),
        "year": some(f"{at}/pub-date/year").cast("int"),
        "licence": some(f"{at}/permissions/license/@*[local-name()='href']"),
        "abstract": some(f"{at}/abstract"),
    }


def atom_metadata(xml: Column) -> dict[str, Column]:
    """arXiv id, title, authors and date of an Atom entry without name spaces' prefixes."""
    some = lambda path: F.nullif(F.trim(F.regexp_replace(F.xpath_string(xml, F.lit(path)), r"\s+", " ")), F.lit(""))
    return {
        "arxiv_id": F.nullif(F.regexp_extract(F.xpath_string(xml, F.lit("//*[local-name()='entry']/*[local-name()='id']")), r"abs/([^v]+)(v[0-9]+)?$", 1), F.lit("")),
        "title": some("//*[local-name()='entry']/*[local-name()='title']"),
        "authors": F.xpath(xml, F.lit("//*[local-name()='author']/*[local-name()='name']/text()")),
        "published": F.to_date(F.substring(some("//*[local-name()='entry']/*[local-name()='published']"), 1, 10)),
    }


_JATS_KINDS = {"p": "paragraph", "title": "heading", "list-item": "list", "disp-formula": "equation", "fig": "figure", "table-wrap": "table", "code": "code", "disp-quote": "quote", "fn": "footnote", "ref": "reference_entry"}


def jats_body(data: str | None) -> list[tuple[int, str, str, str]]:
    """(position, section path, kind, text) of an article's body and references. A document type that only names an external
    one, which is never fetched, is fine; declarations of its own and entities are refused."""
    if not data or "<!ENTITY" in data or re.search(r"<!DOCTYPE[^>]*\[", data):
        return []
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return []
    rows: list[tuple[int, str, str, str]] = []

    def text(node: ElementTree.Element) -> str:
        return " ".join("".join(node.itertext()).split())

    def walk(node: ElementTree.Element, path: str) -> None:
        sections = 0
        for child in node:
            tag = child.tag.rpartition("}")[2]
            if tag == "sec":
                sections += 1
                walk(child, f"{path}/s{sections}" if path else f"s{sections}")
            elif tag in _JATS_KINDS:
                if value := text(child):
                    rows.append((len(rows), path, _JATS_KINDS[tag], value))
            else:
                walk(child, path)

    for part in root:
        name = part.tag.rpartition("}")[2]
        if name in ("body", "back"):
            walk(part, "" if name == "body" else "back")
    return rows


_ENV = {"equation": "equation", "align": "equation", "figure": "figure", "table": "table", "itemize": "list", "enumerate": "list", "theorem": "theorem", "lemma": "theorem", "verbatim": "code", "lstlisting": "code", "quote": "quote", "algorithm": "algorithm"}


def latex_body(source: str | None) -> list[tuple[int, str, str, str]]:
    """(position, section path, kind, text) of a LaTeX file: macros expanded within a budget, sections, environments and
    paragraphs; markup that is not known is dropped, its argument kept."""
    if not source:
        return []
    text = expanded(re.sub(r"(?<!\\)%.*", "", source))
    found = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.S)
    text = found[1] if found else text
    rows: list[tuple[int, str, str, str]] = []
    numbers = [0, 0, 0]
    path = ""

    def plain(x: str) -> str:
        x = re.sub(r"\\(?:label|ref|cite[a-z]*|vspace|hspace|includegraphics)(?:\[[^\]]*\])?\{[^}]*\}", " ", x)
        x = re.sub(r"\\(?:begin|end)\{[^}]*\}|\\item\b|\\\\", " ", x)
        x = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ", x)
        return " ".join(x.replace("{", "").replace("}", "").replace("~", " ").split())

    def put(kind: str, x: str) -> None:
        if value := " ".join(x.split()) if kind == "equation" else plain(x):
            rows.append((len(rows), path, kind, value))

    token = re.compile(r"\\(section|subsection|subsubsection)\*?\{((?:[^{}]|\{[^{}]*\})*)\}|\\begin\{(" + "|".join(_ENV) + r")\*?\}(.*?)\\end\{\3\*?\}|\n\s*\n", re.S)
    at = 0
    for m in token.finditer(text):
        put("paragraph", text[at : m.start()])
        at = m.end()
        if m[1]:
            level = m[1].count("sub")
            numbers[level] += 1
            numbers[level + 1 :] = [0] * (2 - level)
            path = "/".join(f"s{n}" for n in numbers[: level + 1])
            put("heading", m[2])
        elif m[3]:
            put(_ENV[m[3]], m[4])
    put("paragraph", text[at:])
    return rows


def main_tex(files: dict[str, str]) -> str | None:
    """The file to begin with: with a document class and the most included files, shallowest, first by name."""
    roots = [n for n, t in files.items() if n.endswith(".tex") and "\\documentclass" in t and "\\begin{document}" in t]
    return min(roots, key=lambda n: (-len(re.findall(r"\\(?:input|include)\b", files[n])), n.count("/"), n), default=None)


def whole_tex(files: dict[str, str]) -> str | None:
    """The main file with the files that it includes in their places, names without .tex too; a file that is missing, or would
    include itself, is left out."""

    def of(name: str, above: tuple[str, ...]) -> str:
        def put(m: re.Match) -> str:
            found = next((n for n in (m[1].strip(), m[1].strip() + ".tex") if n in files and n not in above), None)
            return of(found, (*above, found)) if found else ""

        text = re.sub(r"(?<!\\)%.*", "", files[name])
        return re.sub(r"\\(?:input|include)\s*\{([^}]*)\}", put, text)

    main = main_tex(files)
    return None if main is None else of(main, (main,))


def bodies(rows: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(id, position, section, kind, text) of the blocks of each whole text, which is JATS or LaTeX by `kind`; a null text, or
    one that cannot be parsed, has none. A text is parsed alone, in batches of a task."""
    ship(rows.sparkSession)
    parse = {"jats": jats_body, "latex": latex_body}[kind]

    @F.pandas_udf("array<struct<position: int, section: string, kind: string, text: string>>")
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("position", "section", "kind", "text"), b)) for b in parse(t)])

    return rows.select(F.col(id_col).alias("id"), F.explode(blocks(text_col)).alias("b")).select(F.col("id").alias(id_col), "b.*")


def unpacked(name: str, data: bytes) -> list[tuple[str, bytes, str]]:
    """(path, content, problem) of an archive's files: tar (also gzip, bzip2, xz) or zip. Paths that lead outside are refused, and
    reading ends where a bound is passed; a problem is told in a row without content."""
    out: list[tuple[str, bytes, str]] = []
    total = 0

    def take(path: str, size: int, read) -> bool:
        nonlocal total
        if path.startswith("/") or ".." in path.split("/") or "\\" in path:
            out.append((path, b"", "outside"))
            return True
        if len(out) >= MEMBERS or total + size > UNPACKED or total + size > RATIO * max(1, len(data)):
            out.append((path, b"", "too large"))
            return False
        total += size
        out.append((path, read(), ""))
        return True

    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir() and not take(i.filename, i.file_size, lambda i=i: z.read(i)):
                        break
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for i in t:
                    if i.isfile() and not take(i.name, i.size, lambda i=i: t.extractfile(i).read()):
                        break
    except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError):
        out.append((name, b"", "damaged"))
    return out


def read_archives(files: DataFrame) -> DataFrame:
    """(archive, path, content, problem) of `spark.read.format("binaryFile")` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(name, *x) for x in unpacked(name, data)], columns=["archive", "path", "content", "problem"])

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary, problem string")


def is_code(path: Column, size: Column, largest: int = 1 << 20) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return ending.isin(*CODE) & ~path.rlike(NOT_CODE) & ~path.rlike(SECRET) & (size <= largest) & ~path.rlike(r"(^|/)\.\.(/|$)|^/")


def code_chunks(files: DataFrame, lines: int = 60) -> DataFrame:
    """(path, chunk, first_line, last_line, text): windows of lines, in the JVM."""
    rows = files.withColumn("_l", F.split("text", "\n")).withColumn("_n", F.size("_l"))
    starts = rows.withColumn("first_line", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)), F.lit(lines))))
    last = F.least(F.col("first_line") + lines - 1, F.col("_n"))
    return starts.select("path", F.floor((F.col("first_line") - 1) / lines).cast("int").alias("chunk"), "first_line", last.alias("last_line"), F.array_join(F.slice("_l", F.col("first_line"), F.lit(lines)), "\n").alias("text"))


#: Endings of languages whose symbols are told by indentation and by braces, and what a symbol begins with.
INDENTED, BRACED = ("py", "pyi"), ("js", "jsx", "ts", "tsx", "java", "c", "h", "cc", "cpp", "hpp", "cs", "go", "rs", "swift", "kt", "php")
_PY_NAME = r"^(?:async +)?(?:def|class) +([A-Za-z_][A-Za-z0-9_]*)"
_BRACE_NAME = r"^ *(?:(?:export|default|public|private|protected|static|final|abstract|async|pub|unsafe|inline) +)*(?:function|class|struct|interface|enum|trait|impl|fn|func|namespace) *\*? +([A-Za-z_][A-Za-z0-9_]*)"
_QUOTED = r"""//.*$|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""


def symbol_chunks(files: DataFrame, lines: int = 60) -> DataFrame:
    """(path, first_line, last_line, symbol, text): every line of every file in exactly one chunk. A top-level function or class
    is a chunk of its own, decorators included, what stands between two of them another; only what has more than `lines`
    lines is cut into windows, which keep the symbol's name.

    Symbols of indented languages end before the next line that begins at the margin, those of braced ones where no brace is
    open; strings and line comments open none. Other files are cut into windows. Null texts have no lines, an empty one has
    one; of a path that stands in several rows the rows are taken together, line by line."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rows = files.where("text IS NOT NULL").select("path", ending.alias("e"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n")
    above, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    line, indented, braced = F.col("line"), F.col("e").isin(*INDENTED), F.col("e").isin(*BRACED)
    code = F.regexp_replace(line, _QUOTED, "")
    count = lambda c: F.length(code) - F.length(F.replace(code, F.lit(c), F.lit("")))
    rows = rows.withColumn("depth", F.coalesce(F.sum(count("{") - count("}")).over(above), F.lit(0)))
    margin = F.when(indented, line.rlike(r"^[^\s#)\]}]")).when(braced, (F.col("depth") <= 0) & line.rlike(r"^\s*[^\s{}]")).otherwise(F.col("n") == 0)
    name = F.when(indented, F.regexp_extract("line", _PY_NAME, 1)).when(braced & (F.col("depth") <= 0), F.regexp_extract("line", _BRACE_NAME, 1))
    rows = rows.withColumns({"margin": margin, "name": F.nullif(name, F.lit("")), "decorator": indented & F.startswith(line, F.lit("@"))})
    # What follows a decorator at the margin belongs to it.
    rows = rows.withColumn("begins", F.col("margin") & ~F.coalesce(F.last(F.when(F.col("margin"), F.col("decorator")), ignorenulls=True).over(above), F.lit(False)))
    kind = F.last(F.when(F.col("begins"), F.col("name").isNotNull() | F.col("decorator")), ignorenulls=True)
    rows = rows.withColumns({"symbol": F.coalesce(kind.over(so_far), F.lit(False)), "before": F.coalesce(kind.over(above), F.lit(False))})
    rows = rows.withColumn("run", F.count_if(F.col("begins") & (F.col("symbol") | F.col("before"))).over(so_far))
    run = Window.partitionBy("path", "run")
    rows = rows.withColumns({"part": F.floor((F.col("n") - F.min("n").over(run)) / lines), "named": F.when(F.col("symbol"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("n"))).over(run))})
    chunks = rows.groupBy("path", "run", "part").agg((F.min("n") + 1).alias("first_line"), (F.max("n") + 1).alias("last_line"), F.max("named").alias("symbol"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return chunks.select("path", "first_line", "last_line", "symbol", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def site_adapter(url: Column) -> Column:
    """Which site's rules a URL falls under; the first that fits."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")
    return (
        F.when(host.isin("arxiv.org", "export.arxiv.org"), "arxiv")
        .when(host == "aclanthology.org", "acl")
        .when(host == "openreview.net", "openreview")
        .when(host.isin("pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov"), "pubmed")
        .when(host == "huggingface.co", "huggingface")
    )


def chosen_source(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (paper_id, kind, accepted, reason): the first accepted of LaTeX, HTML and PDF, and the failures of each paper."""
    order = F.array_position(F.array(F.lit("latex"), F.lit("html"), F.lit("pdf")), F.col("kind"))
    best = candidates.where("accepted").groupBy("paper_id").agg(F.min_by("kind", order).alias("kind"))
    failures = candidates.where("NOT accepted").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "reason"))).alias("failures"))
    return best, failures


def matched_papers(given: DataFrame, own: DataFrame) -> DataFrame:
    """(id, own_id): by arXiv id, else DOI, else (site, external id)."""
    out = given
    for k, keys in enumerate((["arxiv_id"], ["doi"], ["site", "external_id"])):
        side = own.where(" AND ".join(f"{c} IS NOT NULL" for c in keys)).groupBy(*keys).agg(F.min("id").alias(f"_m{k}"))
        out = out.join(side, keys, "left")
    return out.select("id", F.coalesce("_m0", "_m1", "_m2").alias("own_id"))


def filled(target: Column, source: Column) -> Column:
    """A map with the source's entries where the target has none."""
    return F.map_concat(F.map_filter(source, lambda k, _: ~F.array_contains(F.map_keys(target), k)), target)
