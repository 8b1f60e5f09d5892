"""WARC derivative builder: linked metadata and plain-text conversion records for responses.

Each response gives two records. The metadata record (``application/warc-fields``) tells title,
language, description, the source's content type and its links; the conversion record holds the
page's text, one block element per line. Both name the response they derive from (WARC-Refers-To, with
its target URI and date), the metadata record names the conversion record, and both keep the source's
payload digest and HTTP headers, the conversion record as header fields ``WARC-Source-HTTP-...``. A
digest that the source brings along is kept as it is; where there is none it is made of the payload's
UTF-8 bytes. Record ids are derived from the source's id and the kind, so a
retried task gives the same records; the id of a fetched page without one is made of its number, address,
date and payload, so captures that differ have ids that differ. A map over rows without any shuffle.

Edge cases: a null or empty payload gives records with an empty text and no links; a null address
is left out of the headers, and links stay as they are; a null id or date likewise leaves out its
header; a head without its end ends at the first text or start tag that cannot stand in one; markup that never ends is read to the end of the page once, so time is linear in the page;
repeated rows give repeated records; an empty table gives none. Columns other than those named
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

#: Elements whose content is no text.
HIDDEN = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select"}
#: Elements that do not end a head.
HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Elements that begin or end a line.
BLOCKS = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul", "body", "html", "title",
}
_OPEN = re.compile(r"""<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>)""")
_ATTRS = re.compile(r"""([A-Za-z:-]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_BLANKS = re.compile(r"[ \t\r\f\v ]+")
_CLOSE = {name: re.compile(f"</{name}", re.IGNORECASE) for name in ("script", "style")}
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src", "frame": "src"}


def digest(data: bytes) -> str:
    """A labelled digest, as WARC headers have it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_page(page: str) -> dict:
    """``text, title, lang, description, links`` of a page; links as (element@attribute, address)."""
    out: dict = {"title": "", "lang": "", "description": "", "links": []}
    parts: list[str] = []
    title: list[str] | None = None
    hidden, at = "", 0
    head, past_head = False, False

    def say(raw: str) -> None:
        nonlocal head, past_head
        if title is not None:
            title.append(raw)
        elif not hidden:
            if head and raw.strip():
                head, past_head = False, True
            parts.append(html.unescape(raw.replace("\n", " ")))

    while m := _OPEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else ">", at)
            at = len(page) if end < 0 else end + (3 if m[1] else 1)
            continue
        closing, name, attrs = bool(m[3] or m[6]), (m[4] or m[7]).lower(), m[5] if m[4] else m[8]
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRS.findall(attrs)} if attrs and not closing else {}
        if link := found.get(LINKS.get(name, "")):
            out["links"].append((f"{name.upper()}@/{LINKS[name]}", link.strip()))
        if name == "html" and not out["lang"]:
            out["lang"] = found.get("lang", "")
        if name == "meta" and found.get("name", "").lower() == "description":
            out["description"] = " ".join(found.get("content", "").split())
        if name == "title":
            if closing:
                if title is not None and not out["title"]:
                    out["title"] = " ".join(html.unescape("".join(title)).split())
                title = None
            elif title is None:
                title = []
            continue
        if name in _CLOSE and not closing:  # what is inside is not markup
            end = _CLOSE[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name == "body" or name == "head" and closing and head:
            hidden, head, past_head = "", False, True
        elif name == "head":
            head = head or not closing and not hidden and not past_head
        elif head and not hidden and not closing and name not in HEAD:
            head, past_head = False, True
        if name in HIDDEN or name == "noframes" and (head or hidden == name):
            if closing and hidden == name:
                hidden = ""
            elif not closing and not hidden and not attrs.endswith("/"):
                hidden = name
        if name in BLOCKS and title is None:
            parts.append("\n")
    say(page[at:])
    lines = (_BLANKS.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return out | {"text": "\n".join(x for x in lines if x)}


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def _headers(kind: str, rid: str, content_type: str, block: bytes, source: dict, extra: list[tuple[str, str]]) -> str:
    rows = [
        ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", source["date"]), ("WARC-Target-URI", source["url"]), ("WARC-Refers-To", source["id"]),
        ("WARC-Refers-To-Target-URI", source["url"]), ("WARC-Refers-To-Date", source["date"]), ("WARC-Block-Digest", digest(block)), *extra,
        ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ]
    return "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in rows if v)


def derive_page(source: dict, payload: str | None) -> list[dict]:
    """The two records of a response ``{id, url, date, http_headers, payload_digest}``; the digest may
    be missing."""
    own = source.get("payload_digest") or digest((payload or "").encode())
    page = read_page(payload or "")
    name = source["id"] or f"{source['url']} {source['date']} {own}"
    ids = {k: record_id(name, k) for k in ("metadata", "conversion")}
    fields = [("title", page["title"]), ("language", page["lang"]), ("description", page["description"])]
    http = re.findall(r"(?m)^([A-Za-z0-9-]+):[ \t]*(.*?)\r?$", source["http_headers"] or "")
    fields += [(f"http-{k.lower()}", v) for k, v in http]
    fields += [("conversion", ids["conversion"]), ("payload-digest", own)]
    for place, link in page["links"]:
        try:
            full = urljoin(source["url"] or "", link)
        except ValueError:
            full = link
        fields.append(("outlink", f"{full} {place}"))
    blocks = {
        "metadata": "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v),
        "conversion": page["text"],
    }
    out = []
    for kind, block in blocks.items():
        extra = [("WARC-Source-Payload-Digest", own)]
        if kind == "metadata":
            extra.append(("WARC-Concurrent-To", ids["conversion"]))
        else:
            extra += [(f"WARC-Source-HTTP-{k}", v) for k, v in http]
        content = "application/warc-fields" if kind == "metadata" else "text/plain; charset=utf-8"
        head = _headers(kind, ids[kind], content, block.encode(), source, extra)
        out.append({"warc_type": kind, "record_id": ids[kind], "refers_to": source["id"], "source_digest": own, "block_digest": digest(block.encode()), "content_length": len(block.encode()), "headers": head, "block": block})
    return out


def responses(
    pages: DataFrame, date: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, http_col: str | None = None, digest_col: str | None = None
) -> DataFrame:
    """Response rows of fetched pages: ``page_id, id, url, date, http_headers, payload_digest, payload``.
    Dates, HTTP headers and digests come from columns where such are named."""
    at = F.lit(date) if date_col is None else F.coalesce(F.col(date_col).cast("string"), F.lit(date))
    name = F.sha2(F.concat_ws(" ", F.col(page_col).cast("string"), F.col(url_col), at, F.sha1(F.col(html_col))), 256)
    part = [F.substring(name, at_, n) for at_, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    uid = F.concat(part[0], F.lit("-"), part[1], F.lit("-5"), part[2], F.lit("-8"), part[3], F.lit("-"), part[4])
    own = F.lit(None).cast("string") if digest_col is None else F.col(digest_col)
    http = F.lit("Content-Type: text/html; charset=utf-8\r\n") if http_col is None else F.col(http_col)
    return pages.select(
        F.col(page_col).cast("long").alias("page_id"), F.concat(F.lit("<urn:uuid:"), uid, F.lit(">")).alias("id"), F.col(url_col).alias("url"), at.alias("date"),
        http.alias("http_headers"), own.alias("payload_digest"), F.col(html_col).alias("payload"),
    )


_FIELDS = "warc_type string, record_id string, refers_to string, source_digest string, block_digest string, content_length long, headers string, block string"


def derivatives(sources: DataFrame) -> DataFrame:
    """Two rows for each response: ``page_id`` and the record's fields, header and block."""
    names = ("id", "url", "date", "http_headers", "payload_digest")

    def run(page_ids, *cols):
        *fields, payloads = cols
        rows = [r | {"page_id": p} for p, x, *f in zip(page_ids, payloads, *fields, strict=True) for r in derive_page(dict(zip(names, f, strict=True)), x)]
        return {n: [r[n] for r in rows] for n in ("page_id", *(f.split()[0] for f in _FIELDS.split(", ")))}

    return map_rows(sources.select("page_id", *names, "payload"), f"page_id long, {_FIELDS}", run, rows=100)


def serialized(records: DataFrame) -> DataFrame:
    """``page_id, record``: each record as it stands in a WARC file."""
    return records.select("page_id", F.concat("headers", F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"), date="2024-01-01T00:00:00Z"))
