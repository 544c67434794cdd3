"""Media columns: interleaved document sequences.

`interleave` parses HTML into an ordered array of structs: runs of text, and
references to media with their caption, each with its position. References name
a payload by its SHA-256 digest; `resolve` joins them to a media table, so that
each payload is kept once however many pages show it, while positions and
captions stay with the reference.

The query makes a page of each document: a run of text that names it, a figure whose image is the document's
payload with a caption that gives its size, and a closing run. Its rows are the pages' media items, with
their position, caption and the run of text before them. A payload is the text's UTF-8
bytes, zero bytes up to a positive multiple of 64, stored as an 8-bit greyscale
PNG image of 64 columns. The stored image is read back, and features are
computed from its samples.

Results: a null text is an empty one; its payload is 64 zero bytes. Equal texts
share one payload and its values. An empty table gives no rows. Repeated rows
are returned each. Other columns are ignored. A reference without a payload in
the media table keeps its place with null values; null html has no items.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.llm import shared
from strikeflow.llm import textbytes as tb

WIDTH = 64
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_HIDDEN = frozenset(("script", "style", "template", "noscript", "head"))
_BLOCK = frozenset(("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "figure", "figcaption", "blockquote", "pre", "hr"))


class Sequence(HTMLParser):
    """Items [kind, text, reference, caption] of a page in reading order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif self.hidden:
            pass
        elif tag in ("img", "video", "audio", "embed") and (named.get("src") or named.get("data-src")):
            self.items.append(["media", None, named.get("src") or named.get("data-src"), named.get("alt") or None])
        elif tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in _BLOCK:
            self._break()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            pass
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for item in self.items[self.figures[-1] if self.figures else 0 :]:
                if item[0] == "media":
                    item[3] = said
            self.caption = None
        elif tag == "figure" and self.figures:
            self.figures.pop()
            self._break()
        elif tag in _BLOCK:
            self._break()

    def handle_data(self, data):
        if self.hidden:
            return
        if self.caption is not None:
            self.caption.append(data)
        elif self.items and self.items[-1][0] == "text":
            self.items[-1][1] += data
        elif data.strip():
            self.items.append(["text", data, None, None])

    def _break(self):
        if self.items and self.items[-1][0] == "text":
            self.items[-1][1] += "\n"

    def result(self) -> list[dict]:
        out = []
        for kind, text, src, caption in self.items:
            text = "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x) if text is not None else None
            if kind == "text" and not text:
                continue
            out.append({"position": len(out), "kind": kind, "text": text, "src": src, "digest": src[len(SCHEME) :].lower() if src and src.startswith(SCHEME) else None, "caption": caption})
        return out


ITEM = "struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>"
_ARROW = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "src", "digest", "caption"))]))


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, items): the ordered text and media references of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tb.pieces(batch, "html"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([Sequence(x or "").result() for x in rows.column(1).to_pylist()], _ARROW)], names=[key, "items"])

    own = pages.select(F.col(key), F.col(html).cast("string").alias("html"))
    return own.mapInArrow(run, f"`{key}` {own.schema[0].dataType.simpleString()}, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame, key: str = "page_id", only_media: bool = False) -> DataFrame:
    """One row (key, position, kind, text, src, digest, caption, *media) for each item, payload values by digest; only_media: for media items, with the run of text before as text."""
    items = F.col("items")
    if only_media:
        before = lambda x: F.when(x["position"] > 0, F.get(items, x["position"] - 1)["text"])
        items = F.transform(F.filter(items, lambda x: x["kind"] == "media"), lambda x: x.withField("text", before(x)))
    items = sequences.select(key, F.explode(items).alias("item")).select(key, "item.*")
    return items.join(media, "digest", "left")


def encode_png(payload: bytes) -> bytes:
    """8-bit greyscale rows of WIDTH samples, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples, rows by columns, of an image that encode_png has made."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG image")
    at, packed, size = 8, [], (0, 0)
    while at < len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:]


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def describe(samples: np.ndarray) -> str:
    """Size, mean and standard deviation to 4 places, and a 64-bit average hash: 8 x 8 block means above their mean."""
    mean, dev = samples.mean(), samples.std()
    rows = np.linspace(0, len(samples), 9).astype(int)
    sums = np.vstack([np.zeros((1, 8)), np.cumsum(samples.reshape(len(samples), 8, -1).sum(2, dtype=np.int64), 0)])
    block = (sums[rows[1:]] - sums[rows[:-1]]) / np.maximum(np.diff(rows), 1)[:, None]
    bits = "".join("1" if x else "0" for x in (block > block.mean()).ravel())
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} dev={dev:.4f} hash={int(bits, 2):016x}"


def digest_of(text: str | None) -> tuple[bytes, str]:
    raw = (text or "").encode()
    return raw, hashlib.sha256(raw).hexdigest()


STORE = "digest string, n_bytes long, media binary"
READ = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored media of a partition, one row for each of its distinct texts."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in tb.pieces(batch):
            rows = []
            for text in part.column(0).to_pylist():
                raw, digest = digest_of(text)
                if (key := bytes.fromhex(digest)) not in seen:
                    seen.add(key)
                    rows.append((digest, len(raw), encode_png(payload_of(raw))))
            if rows:
                yield _batch(rows, STORE)


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decodes stored media and describes what was read."""
    for batch in batches:
        rows = []
        for digest, n, media in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            data = media.as_py()
            samples = decode_png(data)
            payload = samples.tobytes()
            rows.append((digest.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(samples)))
        if rows:
            yield _batch(rows, READ)


def page_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page for each document, showing its payload."""
    for batch in batches:
        for part in tb.pieces(batch):
            pages = []
            for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw, digest = digest_of(t)
                pages.append(f'<article><h1>document {d}</h1><figure><img src="{SCHEME}{digest}"><figcaption>{len(raw)} bytes</figcaption></figure><p>end of document {d}</p></article>')
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages, pa.string())], names=["doc_id", "html"])


def store_documents(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the media table of docs (text) to folder and returns it as read from there. A text may be stored once for each partition that holds it."""
    docs.select(F.col("text").cast("string")).mapInArrow(store, STORE).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)
    return docs.sparkSession.read.schema(STORE).parquet(folder)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    media = store_documents(docs, shared.scratch(spark, "media")).mapInArrow(read_back, READ).dropDuplicates(["digest"]).checkpoint()
    # the digest join's sides come straight from a shuffle, so that Spark can split a payload that many documents share
    pages = docs.mapInArrow(page_of, "doc_id long, html string")
    shown = resolve(interleave(pages, "doc_id"), media, "doc_id", only_media=True)
    return shown.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", F.col("text").alias("text_before"))
