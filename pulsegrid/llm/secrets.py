"""Secret scan with a recursive decoding worklist.

Every text is a layer.  A layer is scanned with the base patterns; then each
encoding found in it (percent escapes, Unicode escapes, UTF-16 read as bytes,
base64 runs, and compressed data inside base64, also without a header where it
unfolds to readable text) is unwrapped to a further layer, which joins
the worklist.  The worklist ends at the fixpoint: a layer whose content was
seen before from the same places of this document is not entered again, so
cycles end as well, and a payload that stands twice is entered twice.
Each layer carries, for every character, the range of the *document* that it
came from; what is found in any layer is reported as a range of the document.

Defined results: a null or empty text has no spans; repeated rows are each
scanned; rows with a null id are kept; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, map_arrow, table

KINDS = ("assign", "access", "hex")
#: Name, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # the maximal runs [0-9a-f]+ of enough length
)
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,8}\})+")
ONE_ESCAPE = re.compile(r"\\[uxU]\{?([0-9A-Fa-f]+)\}?")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that go on over line ends.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: No match, and nothing encoded that holds one, is shorter than this ("token=abcdef").
LEAST_CHARS = 12
#: Headers of compressed data, and readable stretches, at any place in decoded bytes.
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00", re.DOTALL)
STRETCH = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){%d,}+" % LEAST_CHARS
)
#: ASCII characters as UTF-16, low byte first and high byte first.
WIDE = tuple(re.compile(form % LEAST_CHARS) for form in (r"(?:[\t\n\r\x20-\x7e]\x00){%d,}+", r"(?:\x00[\t\n\r\x20-\x7e]){%d,}+"))
#: Compressed data unfolds in steps of so many bytes, and is scanned in layers of about so many characters.
STEP_BYTES, LAYER_CHARS = 1 << 20, 1 << 22
#: No pattern of this module matches across such a character, and no decoding removes it.
BETWEEN = re.compile(r"""[^A-Za-z0-9+/_.=:"'%\\{}\x00\x20\t\r\n-]""")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, ordered by start, then by kind as listed."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    return [(kind, start, end) for start, _, kind, end in found]


class Layer:
    """A decoded text and, for each of its characters, the document range [starts, ends)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends

    def key(self) -> bytes:
        """A hash of the content and of the places of the document that it came from."""
        both = hashlib.blake2b(np.asarray(self.starts, np.int64).tobytes(), digest_size=16)
        both.update(np.asarray(self.ends, np.int64).tobytes())
        both.update(self.text.encode("utf-8", "surrogatepass"))
        return both.digest()


def _decoded_utf8(raw: bytes) -> tuple[str, list[int]]:
    """The text of ``raw`` and the byte offset of each character (one more for the end)."""
    text = raw.decode("utf-8", "replace") if b"\x00" not in raw else raw.decode("latin-1")
    offsets, at = [], 0
    lossy = text.encode("utf-8") != raw
    if lossy:
        text = raw.decode("latin-1")
        return text, list(range(len(raw) + 1))
    for ch in text:
        offsets.append(at)
        at += len(ch.encode("utf-8"))
    return text, [*offsets, at]


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match replaced by ``decode(match)``: a list of (text, from, to) within the match."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        parts.append(layer.text[at : m.start()])
        starts.append(layer.starts[at : m.start()])
        ends.append(layer.ends[at : m.start()])
        for ch, a, b in decode(m[0]):
            parts.append(ch)
            starts.append(np.full(len(ch), layer.starts[m.start() + a]))
            ends.append(np.full(len(ch), layer.ends[m.start() + b - 1]))
        at = m.end()
    if not at:
        return None
    parts.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _percent(run: str) -> list[tuple[str, int, int]]:
    text, offsets = _decoded_utf8(unquote_to_bytes(run))
    return [(ch, 3 * offsets[i], 3 * offsets[i + 1]) for i, ch in enumerate(text)]


def _escape(run: str) -> list[tuple[str, int, int]]:
    """Characters of escapes; half of a pair without its other half is one that cannot be read."""
    out, high = [], None
    for m in ONE_ESCAPE.finditer(run):
        code, start = int(m[1], 16), m.start()
        low = 0xDC00 <= code < 0xE000
        if high is not None:
            if low:
                code, start = 0x10000 + ((high[0] - 0xD800) << 10) + (code - 0xDC00), high[1]
            else:
                out.append(("�", high[1], start))
            high = None
        elif low:
            code = 0xFFFD
        if 0xD800 <= code < 0xDC00:
            high = code, start
        else:
            out.append((chr(code) if code < 0x110000 else "�", start, m.end()))
    if high is not None:
        out.append(("�", high[1], len(run)))
    return out


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return zlib.decompressobj(zlib.MAX_WBITS | 32)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _unfolded(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What all members of gzip, zlib, bzip2 or xz data unfold to, up to damage; nothing for anything else."""
    pieces, data = iter(pieces), b""
    while True:
        while len(data) < 6 and (more := next(pieces, None)) is not None:
            data = (data + more).lstrip(b"\x00")  # padding between members
        member = _decompressor(data)
        if member is None:
            return
        try:
            while not member.eof:
                if out := member.decompress(data, STEP_BYTES):
                    yield out
                data = getattr(member, "unconsumed_tail", b"")
                if not member.eof and not out and not data and getattr(member, "needs_input", True):
                    data = next(pieces, None)
                    if data is None:
                        return
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            return
        data = member.unused_data.lstrip(b"\x00")


def _inflated(raw: bytes) -> Iterator[bytes] | None:
    """What compressed data, also compressed more than once, unfolds to; None for anything else."""
    pieces, seen = iter([raw]), set()
    while True:
        pieces, trial = itertools.tee(pieces)
        flat = _unfolded(trial)
        first = next(flat, None)
        if first is None or first in seen:  # data that unfolds to itself ends here
            return pieces if seen else None
        seen.add(first)
        pieces = itertools.chain([first], flat)
        del trial


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for piece in pieces:
        yield decoder.decode(piece)
    yield decoder.decode(b"", True)


def _deflated(raw: bytes) -> Iterator[bytes]:
    """What compressed data without a header unfolds to, up to damage."""
    member = zlib.decompressobj(-zlib.MAX_WBITS)
    try:
        while raw and not member.eof:
            if out := member.decompress(raw, STEP_BYTES):
                yield out
            raw = member.unconsumed_tail
    except zlib.error:
        return


def _inflated_texts(unfolded: Iterator[bytes], least: int) -> Iterator[str]:
    """The unfolded text, cut where no match can lie, binary or not; nothing that is shorter than ``least``."""
    held, size, n = [], 0, 0
    for text in _texts(unfolded):
        n += len(text)
        if size + len(text) >= LAYER_CHARS and (last := BETWEEN.search(text[::-1])):
            cut = len(text) - last.start()
            yield "".join([*held, text[:cut]])
            held, text, size = [], text[cut:], 0
        held.append(text)
        size += len(text)
    if size and n >= least:
        yield "".join(held)


def _printable(text: str) -> int:
    return sum(ch.isprintable() or ch in "\t\n\r" for ch in text)


def _readable(text: str) -> bool:
    return bool(text) and _printable(text) >= 0.9 * len(text)


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 runs of one line and of several: the characters, their places, and the place of the last with padding."""
    for m in BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run)), m.end() - 1
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            at = [i for i, ch in enumerate(m[0]) if ch not in "\r\n\x20\t="]
            if len(at) >= 16:
                yield "".join(m[0][i] for i in at), m.start() + np.array(at), m.end() - 1


def _base64(layer: Layer) -> Iterator[Layer]:
    """What base64 runs hold, at each of the four alignments: a prefix such as a path may have joined the run."""
    for run, at, last in _runs(layer.text):
        run = run.replace("-", "+").replace("_", "/")
        for shift in range(4):
            part = run[shift:]
            if len(part) % 4 == 1:
                part = part[:-1]
            if len(part) >= 16:
                yield from _decoded(layer, base64.b64decode(part + "=" * (-len(part) % 4)), at[shift : shift + len(part)], last, not shift)


def _decoded(layer: Layer, raw: bytes, at: np.ndarray, last: int, aligned: bool) -> Iterator[Layer]:
    """Compressed data in the bytes of a run, and the run as a text or else its readable stretches."""
    packed = False
    for m in PACKED.finditer(raw):
        inside = raw[m.start() :]
        if (unfolded := _inflated(inside)) is not None:
            first = aligned and not m.start()
            packed |= first
            start, end = layer.starts[at[m.start() * 4 // 3]], layer.ends[last]
            for text in _inflated_texts(unfolded, 1 if first else LEAST_CHARS):
                yield Layer(text, np.broadcast_to(start, len(text)), np.broadcast_to(end, len(text)))
    found = None
    if aligned and not packed:
        try:
            if _readable(text := raw.decode("utf-8")):
                found = [(text, 0, raw)]
        except UnicodeDecodeError:
            pass
        if not found and (head := next(_deflated(raw), b"")) and len(head) >= LEAST_CHARS and _readable(head.decode("utf-8", "replace")):
            for text in _inflated_texts(_deflated(raw), LEAST_CHARS):
                yield Layer(text, np.broadcast_to(layer.starts[at[0]], len(text)), np.broadcast_to(layer.ends[last], len(text)))
    if raw.count(b"\x00") >= LEAST_CHARS:
        byte = np.arange(len(raw))
        begin, end = at[byte * 4 // 3], at[np.minimum(-(-(byte + 1) * 4 // 3), len(at)) - 1]
        yield from _wide(Layer(raw.decode("latin-1"), layer.starts[begin], layer.ends[end]))
    for text, skip, part in found or ((m[0].decode("utf-8"), m.start(), m[0]) for m in STRETCH.finditer(raw)):
        offsets = skip + np.asarray(_decoded_utf8(part)[1])
        first = at[offsets[:-1] * 4 // 3]
        end = at[np.minimum(-(-offsets[1:] * 4 // 3), len(at)) - 1]
        yield Layer(text, layer.starts[first], layer.ends[end])


def _wide(layer: Layer) -> Iterator[Layer]:
    """Stretches of UTF-16 of either byte order; where both read the same bytes, the longer, or else the one at an even place."""
    kept: list[tuple[int, int]] = []
    better = lambda x: (x[1] - x[0], x[0] % 2 == 0)
    for x in sorted(m.span() for form in WIDE for m in form.finditer(layer.text)):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
        elif better(x) > better(kept[-1]):
            kept[-1] = x
    for start, end in kept:
        text = layer.text[start:end].replace("\x00", "")
        yield Layer(text, layer.starts[start:end:2], layer.ends[start + 1 : end : 2])


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside ``layer``, one at a time."""
    if "\x00" in layer.text:
        yield from _wide(layer)
    for pattern, decode in ((PERCENT, _percent), (ESCAPE, _escape)):
        if x := _replaced(layer, pattern, decode):
            yield x
    yield from _base64(layer)


def all_spans(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (both ordered), and the number of layers entered."""
    base = base_spans(text)
    if not ("\x00" in text or "%" in text and PERCENT.search(text) or "\\" in text and ESCAPE.search(text) or any(True for _ in _runs(text))):
        return base, base, 1
    n = np.arange(len(text) + 1)
    found, seen, layers = set(base), set(), 0
    work = [iter([Layer(text, n[:-1], n[1:])])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        layers += 1
        if layers > 1:
            found.update((kind, int(layer.starts[a:b].min()), int(layer.ends[a:b].max())) for kind, a, b in base_spans(layer.text))
        work.append(_inner(layer))
    return base, sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])), layers


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, columns named in ``keep``, ``base`` and ``spans``, and ``n_layers``.

    Offsets are code points of the original text, ends exclusive.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = [id_col, *keep]
    source = docs.select(*[F.col(f"`{c}`") for c in named], F.col(f"`{text_col}`").alias(free(named, "text")[0]))

    def scan(batches):
        as_rows = lambda xs: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in xs]
        for batch in batches:
            base, every, layers = [], [], []
            for text in batch.column(len(named)):
                b, e, n = all_spans(text.as_py() or "")
                base.append(as_rows(b))
                every.append(as_rows(e))
                layers.append(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(named))), pa.array(base, spans), pa.array(every, spans), pa.array(layers, pa.int32())],
                names=[*named, "base", "spans", "n_layers"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, scan, f"{kinds}, base {SPANS}, spans {SPANS}, n_layers int")


def _joined(column: str):
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).alias("n_decoded"), "n_layers",
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of every secret replaced by ``[REDACTED]``; rows and columns stay.

    Overlapping spans are replaced as one.  A text without secrets is unchanged.
    """
    others = [c for c in docs.columns if c != "text"]
    source = docs.select(*[F.col(f"`{c}`") for c in others], "text")

    def clean(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(len(others))]
            for i, text in enumerate(texts):
                if text:
                    parts, at = [], 0
                    for _, start, end in all_spans(text)[1]:
                        if start >= at:
                            parts += [text[at:start], "[REDACTED]"]
                        at = max(at, end)
                    texts[i] = "".join([*parts, text[at:]]) if parts else text
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"])

    out = map_arrow(source, clean, source.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
