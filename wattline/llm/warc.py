"""Derivatives of WARC responses: linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import filled, with_python

# fixed values: elements whose content is no text; elements that end a line
HIDDEN = {"script", "style", "template", "noscript", "iframe", "svg", "title", "textarea"}
BLOCKS = set(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul".split()
)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+>")
# names are possessive and may stand without a value, so no name is read twice
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.IGNORECASE) for name in HIDDEN}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of addresses


def digest(data: bytes) -> str:
    """A labelled digest as archives write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_page(page: str) -> tuple[str, dict[str, str], list[str]]:
    """Visible text (a line for each block), fields (title, language, charset) and link targets, in order.

    One pass; a tag ends at the first > outside quotes, or at the first one if its quotes never close.
    Comments, hidden elements and tags that never end are left out.
    """
    lines, line, links, fields = [], [], [], {}
    at, quotes, size = 0, True, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            line.append(page[at:])
            break
        line.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = size if end < 0 else end + 3
            continue
        name = _NAME.match(page, tag + 1)
        if not name and page[tag + 1 : tag + 2] not in ("!", "?", "/"):
            line.append("<")
            at = tag + 1
            continue
        found = _QUOTED.match(page, tag + 1) if quotes else None
        quotes = quotes and found is not None
        end = found.end() if found else page.find(">", tag) + 1
        if not end:
            break
        at = end
        if not name:
            continue
        kind = name.group(1).lower()
        if kind in BLOCKS:
            lines.append("".join(line))
            line = []
        if page[tag + 1] == "/":
            continue
        if kind in ("a", "html", "meta"):
            values = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(page[name.end() : end - 1])}
            if kind == "a" and values.get("href"):
                links.append(values["href"])
            elif kind == "html" and values.get("lang"):
                fields.setdefault("language", values["lang"])
            elif kind == "meta" and values.get("charset"):
                fields.setdefault("charset", values["charset"])
        elif kind in HIDDEN and page[end - 2 : end - 1] != "/":
            close = _CLOSE[kind].search(page, end)
            if kind == "title":
                inside = " ".join(html.unescape(page[end : close.start() if close else size]).split())
                fields.setdefault("title", inside)
            at = close.start() if close else size
    lines.append("".join(line))
    clean = (" ".join(html.unescape(x).split()) for x in lines)
    return "\n".join(x for x in clean if x), fields, links


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _target(base: str, link: str) -> str:
    try:
        return urljoin(base, link.strip())
    except ValueError:  # no address at all, such as a bracket that never closes
        return link.strip()


_FIELDS = [
    ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
    ("headers", pa.string()), ("block", pa.string()),
]
_RECORD = "array<struct<" + ",".join(f"{n}:{'bigint' if t == pa.int64() else 'string'}" for n, t in _FIELDS) + ">>"


def derivatives(
    source_id: str | None, key: str, url: str, page: str, date: str, source: dict[str, str], payload_digest: str | None
) -> list[dict]:
    """The metadata and the conversion record of one response, as dictionaries of their fields."""
    payload = payload_digest or digest(page.encode("utf-8", "replace"))
    origin = source_id or f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key} {url} {payload}')}>"
    ids = {kind: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{origin} {kind}')}>" for kind in ("metadata", "conversion")}
    text, fields, links = read_page(page)
    fact = [f"{name}: {value}" for name, value in sorted(fields.items()) if value]
    fact += [f"source-{name.lower()}: {_one_line(value)}" for name, value in sorted(source.items())]
    fact += [f"source-payload-digest: {payload}", f"source-length: {len(page.encode('utf-8', 'replace'))}"]
    fact += [f"outlink: {_one_line(_target(url, link))} A/@href" for link in links]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{_one_line(x)}\r\n" for x in fact)), "conversion": ("text/plain", text)}
    out = []
    for kind, (content_type, block) in blocks.items():
        data = block.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        head = {
            "WARC-Type": kind, "WARC-Record-ID": ids[kind], "WARC-Date": date, "WARC-Target-URI": _one_line(url), "WARC-Refers-To": origin,
            "WARC-Concurrent-To": other, "WARC-Block-Digest": digest(data), "Content-Type": content_type, "Content-Length": str(len(data)),
        }
        kept = {n: _one_line(v) for n, v in source.items() if n.lower().startswith("warc-") and n.lower() not in {h.lower() for h in head}}
        headers = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in {**head, **kept}.items() if v)
        out.append({
            "warc_type": kind, "record_id": ids[kind], "refers_to": origin, "concurrent_to": other, "content_type": content_type,
            "content_length": len(data), "block_digest": head["WARC-Block-Digest"], "payload_digest": payload, "headers": headers, "block": block,
        })
    return out


def derive(
    df: DataFrame, url: str = "url", page: str = "html", key: str = "page_id", source_id: Column | None = None, date: Column | None = None,
    source: Column | None = None, payload_digest: Column | None = None,
) -> DataFrame:
    """Two rows for each response: its metadata and its plain-text conversion record.

    Columns of `df` but the page stay; new ones are warc_type, record_id, refers_to (the response),
    concurrent_to (the other derivative), content_type, content_length, block_digest, payload_digest (of the
    response), headers (with the source's WARC headers) and block.  `source_id`, `date` (text as in WARC),
    `source` (a map of the response's headers) and `payload_digest` are kept where given; else identifiers
    are made from key, address and digest, the same in every run, and a record without a known date has no date line.  A null page is
    empty, a null address has no target line, repeated rows give repeated records, long pages are read in one
    linear pass, an empty table gives no rows; columns with the new names are replaced.
    """
    blank = F.lit(None).cast("string")
    inputs = {
        "_id": blank if source_id is None else source_id, "_key": F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "_url": filled(url),
        "_page": filled(page), "_date": F.coalesce(blank if date is None else date, F.lit("")),
        "_source": F.map_entries(F.create_map().cast("map<string,string>") if source is None else F.coalesce(source, F.create_map().cast("map<string,string>"))),
        "_digest": blank if payload_digest is None else payload_digest,
    }

    order = list(inputs)

    def step(batch: pa.RecordBatch) -> list[pa.Array]:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in order]
        made = [
            derivatives(i, k, u, p, d, {e["key"]: e["value"] or "" for e in s}, g) for i, k, u, p, d, s, g in zip(*columns)
        ]
        return [pa.array(made, pa.list_(pa.struct(_FIELDS)))]

    records = with_python(df.drop(*[n for n, _ in _FIELDS]), inputs, f"_records {_RECORD}", step)
    names = [c for c in df.columns if c != page and c not in dict(_FIELDS)]
    one = records.select(*[F.col(f"`{c}`") for c in names], F.explode("_records").alias("_record"))
    return one.select(*[F.col(f"`{c}`") for c in names], *[F.col("_record")[n].alias(n) for n, _ in _FIELDS])
