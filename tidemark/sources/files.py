"""Files in: discovery, text, and extraction by format."""

from __future__ import annotations

import email
import email.policy
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.errors import ExtractorUnavailable
from tidemark.functions.text import extension, facet, parent_path, relative_path, stem
from tidemark.operators.chunking import MAX_TOKENS, OVERLAP, chunk
from tidemark.sources import versions

DEFAULT_FORMATS = ("pdf", "docx", "html", "md", "txt", "jpg", "jpeg", "png", "tiff")
PDF, GENERIC, IMAGE = ("pdf",), ("docx", "doc", "html", "htm", "md", "txt", "rtf", "epub", "msg", "eml"), ("jpg", "jpeg", "png", "tiff", "bmp", "gif")


def expand_path(path: str) -> str:
    """``~`` and ``$VAR``."""
    return os.path.expanduser(os.path.expandvars(path))


def resolve(base: str, path: str) -> str:
    path = expand_path(path)
    return path if os.path.isabs(path) or "://" in path else os.path.join(base, path)


#: Levels of folders that are dealt out anew, one at a time, before a task walks all that is below its own; rows and bytes that a task hands on at once.
ROUNDS, ROWS, BYTES = 2, 10_000, 8 << 20
LISTED, READ = "path string, length long", "path string, length long, content binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI for Arrow, as executors open it, and the path there."""
    return (fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _place(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """The URI of ``root`` and its path there, or none where Arrow doesn't open it or nothing has that very name."""
    hadoop, path = versions._fs(spark, root)
    uri = hadoop.makeQualified(path).toString()
    try:
        system, inner = opened(uri)
        there = system.get_file_info(inner).type != fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return None
    return (uri, inner) if there and uri.endswith(inner) else None


def _below_folders(batches: Iterator[pa.RecordBatch], uri: str, whole: bool) -> Iterator[pa.RecordBatch]:
    """Files (path, length) as they are, and in place of folders, which have no length, what lies in them: one level, or files of all levels."""
    system, _ = opened(uri)
    held: list[tuple[str, int | None]] = []
    for batch in batches:
        for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            folders = [path] if length is None else []
            if length is not None:
                held.append((path, length))
            while folders:
                for x in system.get_file_info(fs.FileSelector(folders.pop())):
                    if x.type == fs.FileType.Directory and whole:
                        folders.append(x.path)
                    elif x.type in (fs.FileType.Directory, fs.FileType.File):
                        held.append((x.path, x.size if x.type == fs.FileType.File else None))
                    if len(held) >= ROWS:
                        yield _rows(held)
                        held = []
    if held:
        yield _rows(held)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"][: len(held[0])])


def _with_content(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    system, inner = opened(uri)
    prefix, held, size = uri[: len(uri) - len(inner)], [], 0
    for batch in batches:
        for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with system.open_input_stream(path.removeprefix(prefix), compression=None) as f:
                held.append((path, length, f.read()))
            size += length
            if size >= BYTES or len(held) >= ROWS:
                yield _rows(held)
                held, size = [], 0
    if held:
        yield _rows(held)


def _files(spark: SparkSession, root: str, kept: Column, content: bool = False) -> DataFrame:
    """path, length and, if asked for, content of the files below ``root`` for which ``kept`` holds, empty ones and those with names like ``.x`` and ``_x`` among them.

    Executors list the folders and read the files, so the driver holds no names. A store that Arrow doesn't open, or a pattern, is left to Spark's reader: its driver lists all files, without those.
    """
    place = _place(spark, root)
    if place is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return found.where(kept).select("path", "length", *(["content"] if content else []))
    uri, inner = place
    tasks = 4 * spark.sparkContext.defaultParallelism
    folder = opened(uri)[0].get_file_info(inner)
    found = spark.createDataFrame([(inner, None if folder.type == fs.FileType.Directory else folder.size)], LISTED)
    for i in range(ROUNDS + 1):
        found = found.mapInArrow(partial(_below_folders, uri=uri, whole=i == ROUNDS), LISTED)
        found = found.repartition(tasks) if i < ROUNDS else found
    found = found.select(F.concat(F.lit(uri[: len(uri) - len(inner)]), "path").alias("path"), "length").where(kept)
    # Dealt out anew: a folder may have most of the files.
    return found.repartition(tasks).mapInArrow(partial(_with_content, uri=uri), READ) if content else found


def _is_text(path: Column) -> Column:
    return F.endswith(path, F.lit(".txt")) & ~F.endswith(path, F.lit("/.txt"))


def list_text_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length of the ``.txt`` files below ``root``, by path. Contents are not read."""
    return _files(spark, root, _is_text(F.col("path"))).orderBy("path")


def read_text_files(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """path, text. Bytes that aren't UTF-8 become U+FFFD; with ``strict``, such files are left out."""
    files = _files(spark, root, _is_text(F.col("path")), content=True)
    if strict:
        return files.where(F.is_valid_utf8("content")).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.select("path", F.make_valid_utf8("content").cast("string").alias("text"))


def _below(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", "")
    return relative_path(plain, re.sub("^[a-z0-9]+:/*(?=/)", "", root))


def process_directory(spark: SparkSession, root: str, limit: int | None = None, doc_id_mode: str = "path", parity: bool = False, max_tokens: int = MAX_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """The text files below ``root`` as chunks; with ``limit``, of the first files by path.

    ``doc_id_mode``: ``path`` (relative, without suffix) or ``stem``. ``parity``: categories as plain relative folders.
    """
    files = read_text_files(spark, root)
    if limit is not None:
        first = list_text_files(spark, root).limit(limit).select("path")
        files = files.join(F.broadcast(first), "path", "left_semi")
    inner = _below(F.col("path"), root)
    doc = stem(inner) if doc_id_mode == "stem" else F.regexp_replace(inner, r"\.[^./]*$", "")
    category = parent_path(inner) if parity else facet(parent_path(inner))
    docs = files.select(doc.alias("doc_id"), "path", category.alias("category"), "text")
    return chunk(docs, path=F.col("path"), category=F.col("category"), max_tokens=max_tokens, overlap=overlap)


def file_documents(spark: SparkSession, root: str, facet_mode: str = "parent") -> DataFrame:
    """One row per readable file, its relative path as id. ``facet_mode`` ``path2``: the first two path parts, the file name among them."""
    files = read_text_files(spark, root, strict=True)
    inner = _below(F.col("path"), root)
    category = F.concat(F.lit("/"), F.array_join(F.slice(F.split(inner, "/"), 1, 2), "/")) if facet_mode == "path2" else facet(parent_path(inner))
    return files.select(inner.alias("id"), inner.alias("doc_id"), F.col("path").alias("doc_path"), category.alias("category"), category.alias("category_text"), F.col("text").alias("content"))


def find_supported(spark: SparkSession, root: str, formats: tuple[str, ...] = DEFAULT_FORMATS) -> DataFrame:
    """path, length, ext of the files with one of ``formats``, by path."""
    return _files(spark, root, extension("path").isin(*formats)).select("path", "length", extension("path").alias("ext")).orderBy("path")


def extractor_class(ext: Column) -> Column:
    return F.when(ext.isin(*PDF), "pdf").when(ext.isin(*GENERIC), "generic").when(ext.isin(*IMAGE), "image")


def ext_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("n")).orderBy("ext")


# Extraction: bytes to elements (type, text).

Element = tuple[str, str]


class _Html(HTMLParser):
    BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "title", "article", "section", "nav", "ul", "ol", "table", "td", "th", "pre", "blockquote"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.held: list[str] = []
        self.kind, self.skip = "NarrativeText", 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.out.append((self.kind, text))
        self.held, self.kind = [], "NarrativeText"

    def handle_starttag(self, tag: str, attrs) -> None:
        self.skip += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.flush()
            self.kind = "Title" if re.fullmatch("h[1-6]|title", tag) else "ListItem" if tag == "li" else "NarrativeText"

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.held.append(data)


def html_elements(data: bytes) -> list[Element]:
    parser = _Html()
    parser.feed(data.decode("utf-8", "replace"))
    parser.close()
    parser.flush()
    return parser.out


def text_elements(data: bytes) -> list[Element]:
    parts = (" ".join(p.split("\n")).strip() for p in re.split(r"\n\s*\n", data.decode("utf-8", "replace")))
    return [("NarrativeText", p) for p in parts if p]


def markdown_elements(data: bytes) -> list[Element]:
    out: list[Element] = []
    for kind, p in text_elements(re.sub(r"(?m)^(#{1,6} .*)$", r"\n\1\n", data.decode("utf-8", "replace")).encode()):
        if m := re.match(r"#{1,6} (.*)", p):
            out.append(("Title", m[1].strip(" #")))
        else:
            plain = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", p)
            out.append((kind, re.sub(r"(\*\*|__|`)(.+?)\1", r"\2", plain)))
    return out


def docx_elements(data: bytes) -> list[Element]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[Element] = []
    for p in root.iter(f"{w}p"):
        if p.find(f".//{w}br[@{w}type='page']") is not None:
            out.append(("PageBreak", ""))
        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
        style = p.find(f"{w}pPr/{w}pStyle")
        if text:
            out.append(("Title" if style is not None and "eading" in style.get(f"{w}val", "") else "NarrativeText", text))
    return out


def epub_elements(data: bytes) -> list[Element]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [e for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm")) for e in html_elements(z.read(n))]


def rtf_elements(data: bytes) -> list[Element]:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), data.decode("latin-1"))
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\par[d]?\b ?", "\n\n", text)
    return text_elements(re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).encode())


def eml_elements(data: bytes) -> list[Element]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    body = message.get_body(preferencelist=("plain", "html"))
    found = [("Title", str(message["subject"]))] if message["subject"] else []
    if body is None:
        return found
    content = body.get_content().encode()
    return found + (html_elements(content) if body.get_content_type() == "text/html" else text_elements(content))


def _pymupdf(data: bytes) -> list[str]:
    import pymupdf

    return [p.get_text() for p in pymupdf.open(stream=data, filetype="pdf")]


def _pdfplumber(data: bytes) -> list[str]:
    import pdfplumber

    return [(p.extract_text() or "") + "\n" for p in pdfplumber.open(io.BytesIO(data)).pages]


def _pypdf(data: bytes) -> list[str]:
    import pypdf

    return [(p.extract_text() or "") + "\n" for p in pypdf.PdfReader(io.BytesIO(data)).pages]


#: Pages of text by library, in the order in which they are tried.
PDF_BACKENDS: dict[str, Callable[[bytes], list[str]]] = {"pymupdf": _pymupdf, "pdfplumber": _pdfplumber, "pypdf2": _pypdf}


def _partitioned(data: bytes, ext: str, strategy: str, languages: tuple[str, ...]) -> list[Element]:
    """By the partitioning library, which knows strategies and languages of its own."""
    try:
        from unstructured.partition.auto import partition
    except ImportError as e:
        raise ExtractorUnavailable("extractor unavailable: no partitioning library") from e
    found = partition(file=io.BytesIO(data), metadata_filename=f"x.{ext}", strategy=strategy, languages=list(languages), include_page_breaks=True)
    return [(type(x).__name__, str(x)) for x in found]


def pdf_elements(data: bytes, backend: str | None = None, strategy: str = "auto", languages: tuple[str, ...] = ("eng",)) -> list[Element]:
    """By the named library, or the first that is installed. Strategies beside ``auto`` and ``fast`` need the partitioning library."""
    if backend == "unstructured" or strategy not in ("auto", "fast"):
        return _partitioned(data, "pdf", strategy, languages)
    if backend is not None and backend not in PDF_BACKENDS:
        raise ExtractorUnavailable(f"extractor unavailable: no back-end {backend!r}")
    pages = None
    for name in [backend] if backend else PDF_BACKENDS:
        try:
            pages = PDF_BACKENDS[name](data)
            break
        except ImportError:
            continue
    if pages is None:
        raise ExtractorUnavailable("extractor unavailable: no PDF library")
    out: list[Element] = []
    for i, page in enumerate(pages):
        out += [("PageBreak", "")] * bool(i) + [("NarrativeText", page)]
    return out


def image_elements(data: bytes, languages: tuple[str, ...] = ("eng",)) -> list[Element]:
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise ExtractorUnavailable("extractor unavailable: no OCR library") from e
    return [("NarrativeText", pytesseract.image_to_string(Image.open(io.BytesIO(data)), lang="+".join(languages)))]


def extractors_for(backend: str | None = None, strategy: str = "auto", languages: tuple[str, ...] = ("eng",)) -> dict[str, Callable[[bytes], list[Element]]]:
    """Extractors with these options; formats without a reader of our own go to the partitioning library."""
    return {
        "pdf": partial(pdf_elements, backend=backend, strategy=strategy, languages=languages), **dict.fromkeys(IMAGE, partial(image_elements, languages=languages)),
        **{ext: partial(_partitioned, ext=ext, strategy=strategy, languages=languages) for ext in ("doc", "msg")},
    }


def _unavailable(data: bytes) -> list[Element]:
    raise ExtractorUnavailable("extractor unavailable: no library for this format")


EXTRACTORS: dict[str, Callable[[bytes], list[Element]]] = {
    "txt": text_elements, "md": markdown_elements, "html": html_elements, "htm": html_elements, "docx": docx_elements, "rtf": rtf_elements,
    "epub": epub_elements, "eml": eml_elements, **extractors_for(),
}


def extract_bytes(data: bytes, ext: str, extractors: dict[str, Callable[[bytes], list[Element]]] | None = None) -> tuple[str, list[Element]]:
    found = (extractors or EXTRACTORS).get(ext, _unavailable)(data)
    joint = "" if ext in PDF else "\n\n"
    return joint.join(t for kind, t in found if kind != "PageBreak"), found


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], list[Element]]] | None = None) -> DataFrame:
    """Rows (path, length, ext, content) as content and metadata; a file that fails keeps its error and no content.

    ``extractors`` replaces or adds formats.
    """
    table = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length, ext, data in zip(pdf["path"], pdf["length"], pdf["ext"], pdf["content"], strict=True):
                meta = {"file_path": path, "file_name": path.rsplit("/", 1)[-1], "file_size": int(length), "num_pages": None, "elements": None, "error": None}
                try:
                    content, found = extract_bytes(bytes(data), ext, table)
                    meta |= {"num_pages": sum(k == "PageBreak" for k, _ in found) + 1, "elements": [{"type": k, "text": t} for k, t in found]}
                except Exception as e:  # noqa: BLE001
                    content, meta["error"] = "", f"{type(e).__name__}: {e}"
                rows.append({"content": content, "metadata": meta})
            yield pd.DataFrame(rows, columns=["content", "metadata"])

    return files.select("path", "length", "ext", "content").mapInPandas(run, schemas.EXTRACT)


def extract_directory(spark: SparkSession, root: str, formats: tuple[str, ...] = DEFAULT_FORMATS, extractors: dict | None = None) -> DataFrame:
    files = _files(spark, root, extension("path").isin(*formats), content=True)
    return extract(files.withColumn("ext", extension("path")), extractors)


def extraction_counts(extracted: DataFrame) -> DataFrame:
    return extracted.agg(F.count_if(F.col("metadata.error").isNull()).alias("processed"), F.count("metadata.error").alias("errors"))


