"""Secret scans with structural confirmation.

Pattern matches (assign, access, hex) are reported as they are. Long base64 and hex
candidates are reported as well if what they decode to is built like a secret:

- jwt: three base64url segments, of which the first decodes to a JSON object with ``alg``,
  the second to a JSON object, the third to any bytes;
- der: a private key in DER, opened down to its innermost element, every one of which has
  to fill its place: PKCS#1 (nine INTEGERs), SEC1 (a number of a curve's size, its curve and
  point), PKCS#8 with an algorithm's identifier and within its OCTET STRING a key of that
  algorithm, or an encrypted PKCS#8 (a scheme's identifier in a SEQUENCE, then an OCTET
  STRING);
- openssh: an ``openssh-key-v1`` container whose length-prefixed fields, public keys and
  private section included, end where it ends;
- pem: an armoured private key whose body is one of the two above, or which has headers
  that say it is encrypted.

Base64 may be broken over lines; line breaks may be escaped (as in JSON), quoted (as in mail)
or stand between string literals. A key may begin inside a run, after ``/``, ``_`` or ``-``
(a path or a name) or ``0x``, its hex bytes may be parted by colons, its base64 may be
percent-encoded, and base64 may hold base64 or armour once more (as in cluster manifests).
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh, table, with_columns

# The patterns of the base kinds.
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: a maximal run of 16 or more is what a longest match of 16 or more is
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "pem")

HINT = re.compile(rb"passw|secret|token|api_?key")
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])")
RUN = "[A-Za-z0-9+/_-]"
#: where a run may begin: not inside one; the letter of an escaped break isn't part of it
START = r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt])|(?<=\\)(?![nrt]))"
ENCODED = re.compile(START + RUN + "{40,}={0,2}")
#: a line break, escaped (once or more) or not
BREAK = r"[ \t]*(?:\\+r)?(?:\\+n|\\?\r?\n)[ \t]*"
LITERAL = r"""["'][ \t]*[+.,]?[ \t]*"""
#: a break before a key's next line: as above, quoted by mail, or from one string literal to the next
STEP = rf"""[ \t]*(?:(?:\\+r)?\\+n{LITERAL}\\?\r?\n|{LITERAL}\\?\r?\n|(?:\\+r)?(?:\\+n|\\?\r?\n))[ \t]*(?:["']|(?:>[ ]?)+)?"""
NEXT = re.compile(f"{STEP}({RUN}+={{0,2}})")
#: where a key may begin inside a run: base64 of the first bytes of a SEQUENCE or of MAGIC
INSIDE = re.compile("(?<=[/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjE)")
PREFIXED = re.compile("0[xX]((?:[0-9a-f]{2}|[0-9A-F]{2}){20,})")
COLONS = re.compile(r"(?<![0-9A-Za-z:])30:[0-9a-fA-F]{2}(?::(?:[ \t]*\r?\n[ \t]*)?[0-9a-fA-F]{2}){18,}(?![0-9A-Za-z])")
PERCENT = re.compile(r"(?<![A-Za-z0-9+/_%-])(?:[A-Za-z0-9+/_-]|%2[BbFf]|%0[AaDd]|%3[Dd]){40,}")
PEM = re.compile(rf"-----BEGIN ((?:[A-Z0-9]+ ){{0,3}})PRIVATE KEY-----((?:{BREAK}[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*)*)((?:[A-Za-z0-9+/=\s]|\\+[rn])+?)-----END \1PRIVATE KEY-----")
#: identifiers of password-based encryption (PKCS#5, PKCS#12) begin so
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
MAGIC = b"openssh-key-v1\0"


def decoded(run: str) -> bytes | None:
    """What a hex or base64 (standard or URL alphabet) run stands for."""
    if len(run) % 2 == 0 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run):
        return bytes.fromhex(run)
    return _base64(run)


def _base64(run: str) -> bytes | None:
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, begin and end of the content of the DER element at ``at``, if it fits before ``end``."""
    if at + 2 > end:
        return None
    tag, n, begin = data[at], data[at + 1], at + 2
    if n & 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or begin + more > end:
            return None
        n = int.from_bytes(data[begin : begin + more], "big")
        begin += more
    return (tag, begin, begin + n) if begin + n <= end else None


def _encrypted(data: bytes, outer: tuple[int, int, int]) -> bool:
    """Is the content an encryption scheme with its parameters, and an octet string to the end?"""
    scheme = _element(data, outer[1], outer[2])
    name = scheme and scheme[0] == 0x30 and _element(data, scheme[1], scheme[2])
    if not name or name[0] != 6 or not data[name[1] : name[2]].startswith(ENCRYPTIONS):
        return False
    sealed = _element(data, scheme[2], outer[2])
    return sealed is not None and sealed[0] == 4 and sealed[2] == outer[2]


# Object identifiers of key algorithms, by what PKCS#8 holds for them.
RSA_KEYS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
EC_KEYS = (bytes.fromhex("2a8648ce3d0201"),)
NUMBER_KEYS = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))
CURVE_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
#: bytes of a private number of the usual curves
CURVE_SIZES = (20, 21, 24, 28, 29, 30, 32, 36, 40, 48, 51, 64, 66, 72)
DEEPEST = 12


def _elements(data: bytes, begin: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements side by side from begin to end; None if they don't fill that place."""
    out, at = [], begin
    while at < end:
        part = _element(data, at, end)
        if part is None:
            return None
        out.append(part)
        at = part[2]
    return out


def _opens(data: bytes, part: tuple[int, int, int], depth: int = 0) -> bool:
    """Do all elements nested in a constructed one fill their places?"""
    if not part[0] & 0x20:
        return True
    inner = _elements(data, part[1], part[2])
    return inner is not None and depth < DEEPEST and all(_opens(data, x, depth + 1) for x in inner)


def _inner(data: bytes, tag: int) -> list[tuple[int, int, int]] | None:
    """The elements within the one that is all of data."""
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != tag or outer[2] != len(data):
        return None
    return _elements(data, outer[1], outer[2])


def _integer(data: bytes, part: tuple[int, int, int]) -> bool:
    """An INTEGER in its shortest form."""
    body = data[part[1] : part[2]]
    return part[0] == 2 and len(body) > 0 and not (len(body) > 1 and (body[0] == 0 and body[1] < 128 or body[0] == 255 and body[1] > 127))


def _version(data: bytes, part: tuple[int, int, int]) -> int:
    return data[part[1]] if part[0] == 2 and part[2] - part[1] == 1 else -1


def _rsa(data: bytes) -> bool:
    parts = _inner(data, 0x30)
    if not parts or len(parts) < 9 or not all(_integer(data, x) for x in parts[:9]):
        return False
    return _version(data, parts[0]) == 0 and len(parts) == 9 or _version(data, parts[0]) == 1 and len(parts) == 10 and parts[9][0] == 0x30 and _opens(data, parts[9])


def _ec(data: bytes) -> bool:
    parts = _inner(data, 0x30)
    if not parts or len(parts) < 2 or _version(data, parts[0]) != 1 or parts[1][0] != 4 or parts[1][2] - parts[1][1] not in CURVE_SIZES:
        return False
    tags = [x[0] for x in parts[2:]]
    return tags in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and all(_opens(data, x) for x in parts[2:])


def _pkcs8(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    if len(parts) < 3 or _version(data, parts[0]) not in (0, 1) or parts[1][0] != 0x30 or parts[2][0] != 4 or any(x[0] not in (0xA0, 0x81, 0xA1) for x in parts[3:]):
        return False
    scheme = _elements(data, parts[1][1], parts[1][2])
    if not scheme or scheme[0][0] != 6 or not all(_opens(data, x) for x in (*scheme, *parts[3:])):
        return False
    name, key = data[scheme[0][1] : scheme[0][2]], data[parts[2][1] : parts[2][2]]
    if name in RSA_KEYS:
        return _rsa(key)
    if name in EC_KEYS:
        return _ec(key)
    whole = _element(key, 0, len(key))
    if whole is None or whole[2] != len(key):
        return False
    if name in NUMBER_KEYS:
        return _integer(key, whole)
    return name in CURVE_KEYS and whole[0] == 4 and whole[2] - whole[1] == CURVE_KEYS[name]


def der_private_key(data: bytes) -> bool:
    outer = _element(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    if _encrypted(data, outer):
        return True
    parts = _elements(data, outer[1], outer[2])
    return parts is not None and (_rsa(data) or _ec(data) or _pkcs8(data, parts))


class Container:
    """An openssh-key-v1 container that is read as its bytes arrive; no byte is looked at twice.

    ``at``: bytes that it has at least; ``ended`` once that is all of it.
    """

    def __init__(self) -> None:
        self.data, self.at, self.left, self.fields, self.ended = bytearray(), len(MAGIC), 3, [], False

    def take(self, more: bytes) -> None:
        """left: fields before the number of keys, then a negative number of fields still to come."""
        self.data += more
        while not self.ended and self.at + 4 <= len(self.data):
            n = int.from_bytes(self.data[self.at : self.at + 4], "big")
            if self.left == 0:
                # public keys, private section
                self.at, self.left, self.keys = self.at + 4, -n - 1, n
                continue
            self.fields.append((self.at + 4, self.at + 4 + n))
            self.at += 4 + n
            self.left += 1 if self.left < 0 else -1
            self.ended = self.left == 0 and len(self.fields) > 3

    def private_key(self) -> bool:
        """Is it whole, and are its public keys and its private section built like such?"""
        if not self.ended or self.at != len(self.data) or not self.data.startswith(MAGIC) or self.keys < 1:
            return False
        for begin, end in self.fields[3:-1]:
            name = begin + 4 + int.from_bytes(self.data[begin : begin + 4], "big")
            if begin + 4 > end or name > end or not re.fullmatch(rb"[a-z0-9@.-]{4,64}", self.data[begin + 4 : name]):
                return False
        secret = self.data[slice(*self.fields[-1])]
        # a plain section begins with one number twice
        return len(secret) >= 16 and (self.data[slice(*self.fields[0])] != b"none" or secret[:4] == secret[4:8])


def openssh_private_key(data: bytes) -> bool:
    if not data.startswith(MAGIC):
        return False
    container = Container()
    container.take(data)
    return container.private_key()


def signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = (json.loads(decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    signed = isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"
    return signed and isinstance(body, dict) and bool(decoded(signature))


def _kind(data: bytes | None, nested: bool = True) -> str | None:
    """What decoded bytes are; ``nested``: they may be armour, or base64 once more, themselves."""
    if not data:
        return None
    if der_private_key(data):
        return "der"
    if openssh_private_key(data):
        return "openssh"
    if nested and data[:1] in b"-Mb" and data[:200].isascii():
        text = data.decode("latin-1").strip()
        if text.startswith("-----BEGIN "):
            m = PEM.fullmatch(text)
            return "pem" if m and _armoured(m) else None
        return _kind(decoded(re.sub(r"\s", "", text)), False) if text[:2] in ("MI", "MC", "MH", "b3") else None
    return None


def _armoured(m: re.Match) -> bool:
    data = decoded(re.sub(r"\s|\\+[rn]", "", m[3]))
    # with such a header the body is a cipher's output, built like nothing
    return bool(data) and ("Proc-Type:" in m[2] and "ENCRYPTED" in m[2] or _kind(data, False) is not None)


def _bytes_of(run: str, as_hex: bool) -> bytes:
    return bytes.fromhex(run) if as_hex else _base64(run) or b""


def _wrapped(text: str, start: int, end: int, limit: list[int]) -> tuple[str, int] | None:
    """Kind and end of a key whose first line is the run from start to end, and which has more lines.

    A DER key says its length at once, a container piece by piece; its lines end there. Every
    line is decoded once. limit: the end of a stretch of lines that was seen to end there, so
    that keys that would have to reach beyond it are refused unread.
    """
    first = text[start:end].rstrip("=")
    as_hex = re.fullmatch("[0-9a-f]+|[0-9A-F]+", first) is not None and first[:2] == "30"
    group = 2 if as_hex else 4
    cut = len(first) // group * group
    head = _bytes_of(first[:cut], as_hex)
    whole = _element(head, 0, 1 << 40) if head[:1] == b"\x30" and len(head) >= 6 else None
    if whole is None and not head.startswith(MAGIC):
        return None

    def room(size: int) -> int:
        return 2 * size if as_hex else -(-4 * size // 3)

    container = Container()
    container.take(head)
    parts, rest, at, size = [head], first[cut:], end, len(first)
    beyond = limit[0] if start < limit[0] else len(text)
    while True:
        need = room(whole[2] if whole else container.at)
        if need > beyond - start:
            return None
        if size >= need and (whole or container.ended):
            break
        line = NEXT.match(text, at)
        if not line:
            limit[0] = max(limit[0], at)
            return None
        bare = line[1].rstrip("=")
        at, size, rest = line.end(), size + len(bare), rest + bare
        cut = len(rest) // group * group
        try:
            data = _bytes_of(rest[:cut], as_hex)
        except ValueError:
            return None
        parts.append(data)
        if not whole:
            container.take(data)
        rest = rest[cut:]
    if at == end or size != need:
        return None
    last = _base64(rest) if rest else b""
    if last is None:
        return None
    if whole:
        return ("der", at) if der_private_key(b"".join([*parts, last])) else None
    container.take(last)
    return ("openssh", at) if container.private_key() else None


def _within(run: str, start: int, text: str, limit: list[int]) -> tuple[str, int, int] | None:
    """A key that begins inside a run (at start in text): after a name or path, or after 0x."""
    if m := PREFIXED.fullmatch(run):
        kind = _kind(bytes.fromhex(m[1]), False)
        if kind:
            return kind, start + 2, start + len(run)
    bare = len(run.rstrip("="))
    for m in INSIDE.finditer(run):
        # the first bytes tell how long it is, so most places are refused at once
        head = decoded(run[m.start() : m.start() + 8]) or b""
        whole = _element(head, 0, 1 << 40) if len(head) >= 6 else None
        if run.startswith("b3", m.start()) or whole and whole[0] == 0x30 and -(-4 * whole[2] // 3) == bare - m.start():
            if kind := _kind(decoded(run[m.start() :]), False):
                return kind, start + m.start(), start + len(run)
        if found := _wrapped(text, start + m.start(), start + len(run), limit):
            return found[0], start + m.start(), found[1]
    return None


def _inside(m: re.Match, spans: list[tuple[str, int, int]]) -> bool:
    return any(a <= m.start() < b for _, a, b in spans)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = []
    if HINT.search(text.encode().lower()):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "." in text:
        found += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if signed_token(*m.groups())]
    armoured = []
    if "-----BEGIN " in text:
        armoured = [("pem", m.start(), m.end()) for m in PEM.finditer(text) if _armoured(m)]
    found += armoured
    done, limit = 0, [0]
    for m in ENCODED.finditer(text):
        if m.start() < done:
            continue
        if kind := _kind(decoded(m[0])):
            key = kind, m.start(), m.end()
        elif _inside(m, armoured):
            continue
        elif more := _wrapped(text, m.start(), m.end(), limit):
            key = more[0], m.start(), more[1]
        else:
            key = _within(m[0], m.start(), text, limit)
        if key:
            done = key[2]
            found.append(key)
    if "30:" in text:
        found += [("der", m.start(), m.end()) for m in COLONS.finditer(text) if der_private_key(bytes.fromhex(re.sub(r"[:\s]", "", m[0])))]
    if re.search("%(?:2[BbFf]|3[Dd])", text):
        for m in PERCENT.finditer(text):
            if "%" in m[0] and (kind := _kind(decoded(re.sub(r"[\r\n]", "", unquote(m[0]))))):
                found.append((kind, m.start(), m.end()))
    found = list(dict.fromkeys(found))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``secrets``: array of (kind, start, end), in code points, end exclusive.

    A null or empty text has none. A column that is named secrets gives way. Texts are
    scanned whole, row by row, so repeated rows and ties give equal results.
    """
    rest = fresh(docs, "secrets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] if t else [] for t in texts]
            yield with_columns(batch, [("secrets", pa.list_(SPAN), spans)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(run, f"{schema}, secrets array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """docs without ``spans``, every span of it replaced by ``[secret]`` (overlaps by one)."""

    def clean(t: str | None, found: list[dict]) -> str | None:
        out, at = [], 0
        for s in found:
            if s["start"] >= at:
                out += [t[at : s["start"]], "[secret]"]
            at = max(at, s["end"])
        return "".join([*out, t[at:]]) if found else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            found = batch.column(batch.schema.get_field_index(spans)).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text))
            if any(found):
                texts = pa.array([clean(t, s) for t, s in zip(texts.to_pylist(), found, strict=True)], texts.type)
            names = [n for n in batch.schema.names if n != spans]
            yield pa.RecordBatch.from_arrays([texts if n == text else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != spans)
    return docs.mapInArrow(run, schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    of = lambda *kinds: F.filter("secrets", lambda s: s.kind.isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined(of(*KINDS[:3])), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


QUERIES = {"op3_secrets": query}
