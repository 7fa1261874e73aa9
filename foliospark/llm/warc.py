"""WARC derivatives: response records become linked metadata and plain-text conversion records.

`write_responses` stores pages as WARC/1.1 response records (HTTP header and body, block and payload digests).
`read_record` parses a record's named fields. `derive` reads response records and builds, for each, a metadata record
(application/warc-fields: the source's HTTP status and headers, title, link count) and a conversion record (text/plain:
the page's text). Both refer to the source by WARC-Refers-To and keep its target URI, date and payload digest; their
own identifiers follow from the source's, so a rerun writes the same records.

Scale: narrow maps without a shuffle, a task holds one Arrow batch.

Defined cases: a null page is an empty body, a null URL an empty target; a record that isn't a response, or whose digest does
not fit its block, gives derivatives with `valid` false; HTTP headers that repeat all stay, in their order; no bytes at all give no derivatives; rows that repeat give
repeated records with equal identifiers; all columns are kept, columns named like outputs are replaced; empty tables stay empty.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_long_rows, mapped
from .markup import attributes, shown

#: The crawl date that write_responses puts down; the tables have none.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562
#: Fixed values of HTML: elements whose text is never shown, and those that start a new line.
HIDDEN = ("noscript", "template", "head", "svg", "select")
BREAKING = frozenset(
    "address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul body html".split()
)
TITLE, TITLE_END = re.compile(r"<title(?=[\s>])[^>]*+>", re.I), re.compile(r"</title", re.I)

DERIVED = "struct<record_type:string,record_id:string,refers_to:string,target_uri:string,date:string,content_type:string,block:binary,block_digest:string,source_payload_digest:string,source_headers:map<string,array<string>>,valid:boolean,record:binary>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def write_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def named_fields(head: bytes) -> list[tuple[str, str]]:
    """All named fields in their order, continuation lines joined."""
    found: list[list[str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:
            found[-1][1] += " " + line.strip()
        elif ":" in line:
            found.append([x.strip() for x in line.split(":", 1)])
    return [(name, value) for name, value in found]


def _fields(head: bytes) -> dict[str, str]:
    """The fields of a WARC record, whose names stand once; of one that is repeated all the same the first counts."""
    found: dict[str, str] = {}
    for name, value in named_fields(head):
        found.setdefault(name, value)
    return found


def by_name(headers: list[tuple[str, str]]) -> dict[str, list[str]]:
    """The values of each name in their order; names differ by more than case, and are spelt as they are first."""
    spelt: dict[str, str] = {}
    found: dict[str, list[str]] = {}
    for name, value in headers:
        found.setdefault(spelt.setdefault(name.lower(), name), []).append(value)
    return found


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head.partition(b"\r\n")[2])
    size = fields.get("Content-Length", "")
    return fields, rest[: int(size)] if size.isdigit() else rest


def response(url: str | None, body: str | None) -> bytes:
    payload = (body or "").encode("utf-8", "surrogatepass")
    uri = re.sub(r"[\r\n]", "", url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    payload_digest = digest(payload)
    return write_record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", uri, payload_digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def read_page(page: str) -> tuple[str, int]:
    """The shown text and the number of links. Text: one line for each run between breaking elements, white space as one space, empty
    lines left out."""
    lines, line, links = [], [], 0
    for text, tag, rest in shown(page, HIDDEN):
        line.append(text)
        links += tag == "a" and any(name == "href" for name, _ in attributes(rest))
        if tag.lstrip("/") in BREAKING:
            lines.append("".join(line))
            line = []
    lines.append("".join(line))
    return "\n".join(filter(None, (" ".join(html.unescape(x).split()) for x in lines))), links


def title_of(page: str) -> str:
    """The text of the first title element."""
    opened = TITLE.search(page)
    if not opened:
        return ""
    closed = TITLE_END.search(page, opened.end())
    return " ".join(html.unescape(page[opened.end() : closed.start() if closed else len(page)]).split())


def derivatives(raw: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    if not raw:
        return []
    fields, block = read_record(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    status, _, names = http.partition(b"\r\n")
    headers = named_fields(names)
    content = next((v for k, v in headers if k.lower() == "content-type"), "")
    valid = fields.get("WARC-Type") == "response" and fields.get("WARC-Block-Digest", digest(block)) == digest(block) and fields.get("WARC-Payload-Digest", "") in ("", digest(payload))
    charset = re.search(r"charset=[\"']?([\w.:-]+)", content, re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, date, uri = fields.get("WARC-Record-ID", ""), fields.get("WARC-Date", DATE), fields.get("WARC-Target-URI", "")
    text, links = read_page(page)
    about = [("source-status", status.decode("latin-1")), *((f"source-{k.lower()}", v) for k, v in headers), ("title", title_of(page)), ("links", str(links))]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about).encode()), "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))}
    out = []
    for kind, (form, data) in blocks.items():
        own = {"record_type": kind, "record_id": identifier(kind, source, digest(data)), "refers_to": source, "target_uri": uri, "date": date, "content_type": form, "block": data, "block_digest": digest(data), "source_payload_digest": fields.get("WARC-Payload-Digest"), "valid": valid}
        named = [("WARC-Type", kind), ("WARC-Record-ID", own["record_id"]), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source), ("WARC-Block-Digest", own["block_digest"])]
        if own["source_payload_digest"]:
            named.append(("WARC-Source-Payload-Digest", own["source_payload_digest"]))
        out.append(own | {"source_headers": list(by_name(headers).items()), "record": write_record([*named, ("Content-Type", form)], data)})
    return out


def write_responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", record_col: str = "record") -> DataFrame:
    """pages with record_col: the page as a WARC response record."""
    for_long_rows(pages.sparkSession)
    typed = pages.drop(record_col).withColumn(record_col, F.lit(None).cast("binary"))

    def run(batches):
        for batch in batches:
            records = [response(u, b) for u, b in zip(batch.column(url_col).to_pylist(), batch.column(html_col).to_pylist(), strict=True)]
            k = batch.schema.get_field_index(record_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array(records, pa.binary()))

    return typed.mapInArrow(run, typed.schema)


def derive(records: DataFrame, record_col: str = "record") -> DataFrame:
    """One row a derivative: the columns of records without record_col, and those of DERIVED."""
    built = mapped(records, record_col, "__fs_derived", f"array<{DERIVED}>", lambda raws: [derivatives(r) for r in raws])
    flat = DERIVED[7:-1]
    while "<" in flat:
        flat = re.sub(r"<[^<>]*>", "", flat)
    names = [f.split(":")[0] for f in flat.split(",")]
    return built.drop(record_col).drop(*names).select("*", F.inline("__fs_derived")).drop("__fs_derived")


def summary(pages: DataFrame) -> DataFrame:
    """The op5 result: one row a derivative, blocks and records as digests and sizes."""
    made = derive(write_responses(pages.select("page_id", "url", "html")).drop("html", "url"))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", F.length("block").cast("long").alias("content_length"),
        "block_digest", "source_payload_digest", F.get(F.element_at("source_headers", "Content-Type"), 0).alias("source_content_type"), "valid", F.sha2("record", 256).alias("record_sha256"),
    )
