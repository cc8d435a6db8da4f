"""Secret scans with structural confirmation.

Base kinds, each leftmost and non-overlapping over the whole text: ``assign``
(a key word, a sign, a value of 8 or more), ``access`` (an access key id) and
``hex`` (32 or more hex digits). The method adds kinds that are confirmed by
decoding before they are reported:

* ``jwt``: three base64url parts whose first decodes to a JSON header with an
  ``alg``, and whose second to a JSON object. Every part between dots is tried, so
  ``credential.`` before a token hides nothing;
* ``der``: base64 (bare, or the body of a PEM block) or hex whose bytes are a DER
  private key: a SEQUENCE whose nested lengths all fit, exactly, and which begins
  with a version INTEGER followed by a key's fields. A bare key may be wrapped in
  lines (also with escaped line ends) and stand between other base64 or hex digits:
  its own length says where it ends, and its first line has 16 digits at least;
* ``ssh``: base64 whose bytes are an OpenSSH private key container, read through
  its length-prefixed fields, wrapped or not;
* ``pem``: a PEM private key that its headers declare encrypted, whose body is of
  whole blocks of the stated cipher's initial vector.

Spans are code points, end exclusive, by start, then kind in the order above.

Defined results: a null text is empty (no spans); a text without a candidate has
empty spans and the hash of the empty string; texts of any length are scanned
whole, one at a time; repeated rows give equal rows; an empty table gives no rows;
other columns, whatever their names, are handed through by ``redact``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "der", "ssh", "pem")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")
_HEADER = re.compile(r"^e[w-z0-9_-]|(?<=[_-])eyJ")  # a brace in base64
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
_LINE_END = re.compile(r"\r\n|\r|\n|\\r\\n|\\r|\\n")
_DEK = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*((?:[0-9A-Fa-f]{16}){1,2})\s*$")
# a SEQUENCE, or the magic of SSH, in base64 and in hex
_DER64 = re.compile(r"M[A-P](?=[A-Za-z0-9+/_-]{14})")
_SSH64 = "b3BlbnNzaC1rZXktdjE"
_DER16 = re.compile(r"30(?=[0-9A-Fa-f]{14})")
_RUN64 = re.compile(r"[A-Za-z0-9+/_-]+")
_RUN16 = re.compile(r"[0-9A-Fa-f]+")
_WRAP = re.compile(r"[\x20\t]*(?:\r\n|\r|\n|\\r\\n|\\n)[\x20\t]*")
LEAST_KEY = 30  # bytes


def _bytes_of(text: str) -> bytes | None:
    """Decode base64 in either alphabet, padded or not."""
    s = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first byte and end of the value of the DER element at ``at``; None if
    its length is not in the shortest form or passes ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at:at + k], "big"), at + k
        if n < 0x80 or n < 1 << 8 * (k - 1):
            return None
    return (tag, at, at + n) if at + n <= end else None


def _nested(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the elements that fill at:end exactly, constructed ones checked
    within; None if lengths don't fit."""
    tags = []
    while at < end:
        got = _tlv(data, at, end)
        if got is None or depth > 16:
            return None
        tag, start, stop = got
        if tag & 0x20 and _nested(data, start, stop, depth + 1) is None:
            return None
        tags.append(tag)
        at = stop
    return tags


def is_der_key(data: bytes | None) -> bool:
    """A private key in PKCS#1 (version and 8 INTEGERs), SEC1 (version, OCTET
    STRING, tagged fields), PKCS#8 (version, algorithm, OCTET STRING) or its
    encrypted form (algorithm, OCTET STRING)."""
    top = data and data[0] == 0x30 and _tlv(data, 0, len(data))
    if not top or top[2] != len(data):
        return False
    tags = _nested(data, top[1], top[2])
    if not tags:
        return False
    return (tags[0] == 2 and len(tags) >= 6 and set(tags) == {2} or tags[:2] == [2, 4] and all(t & 0xA0 == 0xA0 for t in tags[2:])
            or tags[:3] == [2, 0x30, 4] or tags == [0x30, 4])


def der_size(head: bytes | None) -> int | None:
    """Bytes of the key whose first bytes are ``head``; None if no key begins so: a
    SEQUENCE, and in it an INTEGER of one byte (the version) or a SEQUENCE."""
    if not head or len(head) < 8 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4 or head[1] == 0x80:
        return None
    size = 2 + k + (int.from_bytes(head[2:2 + k], "big") if k else head[1])
    first = head[2 + k:4 + k]
    return size if size >= LEAST_KEY and (first == b"\2\1" or first[:1] == b"\x30") else None


def ssh_size(data: bytes) -> tuple[int, bool]:
    """(bytes, whole): the size of the OpenSSH container that ``data`` begins with
    (whole), or the bytes that must be read to know more; (0, True) if it is none:
    magic, cipher, kdf, options, key count, a public key whose type is an SSH name
    for each, and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic[:len(data)]):
        return 0, True
    at, keys, field = len(magic), 1, 0
    while field < 4 + keys + 1:
        if at + 4 > len(data):
            return at + 4, False
        n = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if field == 3:  # the number of keys
            keys = n
            if not 1 <= keys <= 16:
                return 0, True
        else:
            if 4 <= field < 4 + keys:
                if at + n > len(data):
                    return at + n, False
                size = int.from_bytes(data[at:at + 4], "big")
                if not re.match(rb"(ssh|ecdsa|sk)-", data[at + 4:at + 4 + size]):
                    return 0, True
            at += n
        field += 1
    return at, at <= len(data)


def is_ssh_key(data: bytes | None) -> bool:
    """A whole OpenSSH private key container, and nothing behind it."""
    return bool(data) and ssh_size(data) == (len(data), True)


def _gather(text: str, at: int, run: re.Pattern, need: int) -> tuple[str, int] | None:
    """The next ``need`` digits of ``run`` from ``at`` on, over line ends, and the
    position behind them; None if there are fewer."""
    parts = []
    while need <= len(text) - at:
        m = run.match(text, at, at + need)
        if m is None:
            return None
        parts.append(m[0])
        need -= len(parts[-1])
        if need == 0:
            return "".join(parts), at + len(parts[-1])
        gap = _WRAP.match(text, m.end())
        if gap is None:
            return None
        at = gap.end()
    return None


def _digits64(size: int) -> int:
    return -(-size * 4 // 3)


def _padded(text: str, end: int) -> int:
    """The end behind at most two signs of padding."""
    return end + len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))


def _starts_key(text: str, at: int) -> bool:
    """Whether base64 may begin here: no letter or digit before, but for that of an
    escaped line end."""
    return at == 0 or not (text[at - 1].isascii() and text[at - 1].isalnum()) or text[max(at - 2, 0):at] in ("\\n", "\\r")


def _der_at(text: str, at: int, run: re.Pattern) -> int | None:
    """The end of the DER key in digits of ``run`` that begins here."""
    decode, digits = (_bytes_of, _digits64) if run is _RUN64 else (bytes.fromhex, lambda n: 2 * n)
    size = der_size(decode(text[at:at + 16]))
    got = size and _gather(text, at, run, digits(size))
    # base64 that goes on is longer than the key says
    if not got or run is _RUN64 and run.match(text, got[1], got[1] + 1):
        return None
    return got[1] if is_der_key(decode(got[0])) else None


def _ssh_at(text: str, at: int) -> int | None:
    """The end of the OpenSSH container in base64 that begins here."""
    size, whole = 12, False
    while not whole:
        got = _gather(text, at, _RUN64, _digits64(size))
        data = got and _bytes_of(got[0])
        if not data:
            return None
        size, whole = ssh_size(data)
    return got[1] if size == len(data) else None


def _pem_kind(body: str) -> str | None:
    """The kind of the key in a PEM block's body."""
    lines = [x.strip() for x in _LINE_END.split(body)]
    heads = [x for x in lines if ":" in x]
    data = _bytes_of("".join(x for x in lines if ":" not in x).replace("\\/", "/"))
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    iv = next((len(m[1]) // 2 for m in map(_DEK.match, heads) if m), 0)
    sealed = any(re.match(r"Proc-Type:\s*4,\s*ENCRYPTED\s*$", x) for x in heads)
    return "pem" if sealed and iv and data and len(data) >= LEAST_KEY and len(data) % iv == 0 else None


def _json_object(part: str) -> dict | None:
    data = _bytes_of(part)
    try:
        got = json.loads(data) if data and data[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """Signed tokens: each part between dots is tried as a header."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at, i = m[0].split("."), m.start(), 0
        while i + 2 < len(parts):
            end = at + len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
            start = next((h.start() for h in _HEADER.finditer(parts[i]) if len(parts[i]) - h.start() >= 8 and len(parts[i + 1]) >= 4
                          and "alg" in (_json_object(parts[i][h.start():]) or ())), None)
            if start is not None and _json_object(parts[i + 1]) is not None:
                found.append(("jwt", at + start, end))
                at, i = end + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1
    return found


def _starts(text: str, what: re.Pattern | str):
    """Positions of a pattern or a string, ascending."""
    if isinstance(what, re.Pattern):
        yield from (m.start() for m in what.finditer(text))
    else:
        at = text.find(what)
        while at >= 0:
            yield at
            at = text.find(what, at + 1)


def _bare_keys(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Keys in base64 and hex that don't begin within the spans ``taken``; the spans
    of each form are leftmost and don't overlap."""
    found = []
    for kind, what in (("der", _DER64), ("ssh", _SSH64), ("der", _DER16)):
        free, t = 0, 0
        for at in _starts(text, what):
            while t < len(taken) and taken[t][1] <= at:
                t += 1
            if at < free or t < len(taken) and taken[t][0] <= at or what is not _DER16 and not _starts_key(text, at):
                continue
            end = _ssh_at(text, at) if kind == "ssh" else _der_at(text, at, _RUN16 if what is _DER16 else _RUN64)
            if end is not None:
                free = end if what is _DER16 else _padded(text, end)
                found.append((kind, at, free))
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start and kind."""
    text = text or ""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += _tokens(text)
    taken = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            kind = _pem_kind(m[2])
            if kind:
                found.append((kind, *m.span()))
                taken.append(m.span())
    found += _bare_keys(text, taken)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(text: str | None) -> tuple:
    """n_assign, n_access, n_hex, n_confirmed, base_sha256, spans of one text."""
    found = find_spans(text)
    show = lambda rows: ",".join(f"{k}:{a}:{b}" for k, a, b in rows)
    base = [x for x in found if x[0] in BASE]
    counts = [sum(k == x[0] for x in found) for k in BASE]
    return *counts, len(found) - len(base), hashlib.sha256(show(base).encode()).hexdigest(), show(found)


def redacted(text: str | None) -> str | None:
    """The text with every span (overlapping ones merged) replaced by a mark."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            end, i = max(end, spans[i + 1][2]), i + 1
        out += [text[at:start], f"<secret:{kind}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of every document."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"]
    schema = docs.select("doc_id").schema
    for n, kind in zip(names[1:], ["long"] * 4 + ["string"] * 2, strict=True):
        schema = schema.add(n, kind)

    def run(batches):
        for b in slices(batches):
            got = list(zip(*(digest(t) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(g, k) for g, k in zip(got, kinds, strict=True))], names=names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """All documents and columns, with secrets in ``text`` replaced and ``n_chars``
    (where there is such a column) counted again."""
    def run(batches):
        for b in slices(batches):
            cols = [b.column(i) for i in range(b.num_columns)]
            at, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            old = cols[at].to_pylist()
            new = [redacted(t) for t in old]
            cols[at] = pa.array(new, b.schema.field(at).type)
            if n >= 0:
                cols[n] = pa.array([c if x == y else len(y) for c, x, y in zip(cols[n].to_pylist(), old, new, strict=True)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_arrow(docs, run, docs.schema)
