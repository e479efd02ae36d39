"""What may come in: file types, sizes, hosts, content types; decoding; guards on empty documents; error codes."""

from __future__ import annotations

import ipaddress
import os
import socket
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded
from ..options import IngestOptions

OCTETS = "application/octet-stream"
#: File types and the content types that each may be served as.
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
CONTENT_TYPES = {
    ".pdf": ("application/pdf", OCTETS),
    ".doc": ("application/msword", OCTETS),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", OCTETS),
    ".txt": ("text/plain", OCTETS),
    ".md": ("text/markdown", "text/plain", OCTETS),
    ".xls": ("application/vnd.ms-excel", OCTETS),
    ".xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", OCTETS),
}
SUFFIXES = (*CONTENT_TYPES, *IMAGES)
#: The status that each kind of error is answered with; others are 500.
STATUS = {"file_too_large": 413, "processing_timeout": 504, "ocr_required": 422, "not_found": 404, "unsupported_file_type": 400, "invalid_value": 400, "download_error": 502, "missing_reader": 500, "parse_error": 500}
MEGABYTE = 1 << 20


class DownloadError(RuntimeError):
    pass


def suffix(filename: Column) -> Column:
    """The last extension in lower case; a leading dot alone makes none."""
    name = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def supported(filename: Column) -> Column:
    return suffix(filename).isin(*SUFFIXES)


def is_image(filename: Column) -> Column:
    return suffix(filename).isin(*IMAGES)


def parser_route(filename: Column) -> Column:
    """Which parser a file goes to."""
    s = suffix(filename)
    return (
        F.when(s.isin(*IMAGES), "vision").when(s == ".pdf", "pdf").when(s == ".docx", "docx").when(s == ".doc", "doc")
        .when(s == ".xlsx", "xlsx").when(s == ".xls", "xls").when(s.isin(".txt", ".md"), "text").otherwise("unsupported")
    )


def too_large(n_bytes: Column, options: IngestOptions = IngestOptions()) -> Column:
    """Above the limit; a file of exactly the limit passes."""
    return n_bytes > options.max_upload_mb * MEGABYTE


def rejection(filename: Column, n_bytes: Column, options: IngestOptions = IngestOptions()) -> Column:
    """Null, or the kind of error: type before size."""
    return F.when(~supported(filename), "unsupported_file_type").when(too_large(n_bytes, options), "file_too_large")


def status_code(kind: Column) -> Column:
    return F.when(kind.isNull(), 200).otherwise(F.coalesce(*[F.when(kind == k, v) for k, v in STATUS.items()], F.lit(500)))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_allowed(url: Column, allowed: str) -> Column:
    """A comma list of hosts; each allows itself and its subdomains; an empty list allows all."""
    hosts = [h.strip().lower() for h in allowed.split(",") if h.strip()]
    if not hosts:
        return F.lit(True)
    host = url_host(url)
    match = F.lit(False)
    for h in hosts:
        match = match | (host == h) | host.endswith(f".{h}")
    return F.coalesce(match, F.lit(False))


def url_error(url: Column, allowed: str = "") -> Column:
    """Null, or why a URL is not fetched: its scheme, its host, the allow-list, a private address. What a name resolves to is
    checked when it is fetched."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), url_host(url)
    return F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "scheme").when(F.coalesce(host, F.lit("")) == "", "host").when(~host_allowed(url, allowed), "not_allowed").when(barred_literal(host), "private")


def content_type_ok(filename: Column, content_type: Column) -> Column:
    """Parameters do not count; images may be any image; types that are not listed pass; a missing header does not."""
    kind, s = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), suffix(filename)
    listed = F.lit(None).cast("boolean")
    for name, kinds in CONTENT_TYPES.items():
        listed = F.when(s == name, kind.isin(*kinds)).otherwise(listed)
    listed = F.when(s.isin(*IMAGES), kind.startswith("image/") | (kind == OCTETS)).otherwise(listed)
    return (F.coalesce(content_type, F.lit("")) != "") & F.coalesce(listed, F.lit(True))


#: The IPv4 networks that are private, loopback, link-local, multicast, reserved or unspecified, and what is not
#: in them all the same.
BARRED_NETWORKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")
OPEN_ADDRESSES = ("192.0.0.9", "192.0.0.10")


def barred_literal(host: Column) -> Column:
    """Whether a host is written as an IPv4 address that is not fetched; ``barred_address`` tells it of any address, in a task."""
    parts = F.split(host, r"\.")
    number = sum((F.element_at(parts, k + 1).cast("long") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0))
    networks = [ipaddress.ip_network(n) for n in BARRED_NETWORKS]
    within = reduce(or_, [number.between(int(n[0]), int(n[-1])) for n in networks])
    return F.when(host.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), within & ~host.isin(*OPEN_ADDRESSES)).otherwise(F.coalesce(host == "localhost", F.lit(False)))


def barred_address(address: str) -> bool:
    ip = ipaddress.ip_address(address)
    return any((ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_multicast, ip.is_reserved, ip.is_unspecified))


def resolved(host: str) -> set[str]:
    return {info[4][0] for info in socket.getaddrinfo(host, None, proto=socket.IPPROTO_TCP)}


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def open_url(url: str, seconds: int):
    return urllib.request.build_opener(_NoRedirect).open(url, timeout=seconds)


def guarded_fetch(url: str, accepts: Callable[[str | None], bool], options: IngestOptions = IngestOptions(), resolve: Callable[[str], set[str]] = resolved, opener=open_url) -> bytes:
    """One document: scheme, host, allow-list and addresses checked, no redirects, at most the guarded number of bytes.

    Every failure, also an oversize one, is a DownloadError.
    """
    most = options.max_upload_mb * MEGABYTE * options.download_factor
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise DownloadError("only http and https URLs with a host are fetched")
    host = parts.hostname.lower()
    hosts = [h.strip().lower() for h in options.allowed_hosts.split(",") if h.strip()]
    if hosts and not any(host == h or host.endswith(f".{h}") for h in hosts):
        raise DownloadError("the host is not on the allow-list")
    try:
        if any(barred_address(a) for a in resolve(host)):
            raise DownloadError("the host has a private or special address")
        with opener(url, options.timeout_seconds) as answer:
            if not accepts(answer.headers.get("Content-Type")):
                raise DownloadError("unexpected content type")
            length = answer.headers.get("Content-Length") or ""
            if length.isdigit() and int(length) > most:
                raise DownloadError("the document is too large")
            content = bytearray()
            while part := answer.read(1 << 16):
                content += part
                if len(content) > most:
                    raise DownloadError("the document is too large")
            return bytes(content)
    except DownloadError:
        raise
    except Exception as error:
        raise DownloadError(f"cannot fetch {url}") from error


def binary_files(spark: SparkSession, path: str, options: IngestOptions = IngestOptions()) -> DataFrame:
    """path, filename, length, content of the files that may be parsed; the size filter reaches the file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("length") <= options.max_upload_mb * MEGABYTE)
    return files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).where(supported(F.col("filename"))).select("path", "filename", "length", "content")


def text_documents(files: DataFrame) -> DataFrame:
    """path, filename, text of the text and markdown files."""
    return files.where(suffix(F.col("filename")).isin(".txt", ".md")).select("path", "filename", decoded(F.col("content")).alias("text"))


def needs_ocr(docs: DataFrame, nodes: DataFrame, options: IngestOptions = IngestOptions(), keys: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, needs_ocr: fewer characters than the threshold over all nodes, or no node at all."""
    chars = nodes.groupBy(keys).agg(F.sum(F.length("text")).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return docs.select(keys).join(chars, keys, "left").select(keys, n.alias("n_chars"), (n < options.ocr_below_chars).alias("needs_ocr"))


def with_ocr_fallback(parsed: DataFrame, ocr: DataFrame, wanted: DataFrame, keys: str = "doc_id") -> DataFrame:
    """OCR's nodes where they were wanted and there are any, the parser's otherwise."""
    chosen = ocr.join(wanted.where("needs_ocr"), keys, "left_semi").select(*parsed.columns)
    return parsed.join(chosen.select(keys).distinct(), keys, "left_anti").unionByName(chosen)


def empty_documents(docs: DataFrame, nodes: DataFrame, filename: str = "filename", keys: str = "doc_id") -> DataFrame:
    """doc_id, error of the documents without a node: ocr_required for pages and images, invalid_value for others."""
    scanned = (suffix(F.col(filename)) == ".pdf") | is_image(F.col(filename))
    empty = docs.join(nodes.select(keys).distinct(), keys, "left_anti")
    return empty.select(keys, F.when(scanned, "ocr_required").otherwise("invalid_value").alias("error"))


def served_as(filename: str, content_type: str | None) -> bool:
    """``content_type_ok`` for one answer, inside a task."""
    end = os.path.splitext(filename)[1].lower()
    kind = (content_type or "").split(";")[0].strip().lower()
    if not kind:
        return False
    return kind.startswith("image/") or kind == OCTETS if end in IMAGES else kind in CONTENT_TYPES.get(end, (kind,))


def fetched(urls: DataFrame, options: IngestOptions = IngestOptions(), **guards) -> DataFrame:
    """path, filename, length, content, error of (document_url, filename): URL entry as a plan, each fetched by the task that has it.

    Types that can't be parsed and URLs that may not be fetched are not asked for; an answer of another type is an error.
    """
    kind = F.when(~supported(F.col("filename")), "unsupported_file_type").when(url_error(F.col("document_url"), options.allowed_hosts).isNotNull(), "download_error")
    rows = urls.select("document_url", "filename", kind.alias("refused"))

    def run(batches):
        for batch in batches:
            contents, errors = [], []
            for url, name, refused in zip(*(batch.column(c).to_pylist() for c in ("document_url", "filename", "refused"))):
                content, error = None, refused
                if refused is None:
                    try:
                        content = guarded_fetch(url, lambda kind: served_as(name, kind), options, **guards)  # noqa: B023
                        error = "file_too_large" if len(content) > options.max_upload_mb * MEGABYTE else None
                    except DownloadError:
                        error = "download_error"
                contents.append(None if error else content)
                errors.append(error)
            lengths = [None if c is None else len(c) for c in contents]
            yield pa.RecordBatch.from_arrays(
                [batch.column("document_url"), batch.column("filename"), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())],
                names=["path", "filename", "length", "content", "error"],
            )

    return rows.mapInArrow(run, "path string, filename string, length long, content binary, error string")
